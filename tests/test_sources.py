import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators.counts import Variables, families_of, family_counts
from arbora.plans import evaluation
from arbora.sources import archive, bif, files, tables

BIF = """
network unknown {}
// a comment
variable a { type discrete [ 2 ] { no, yes }; }
variable "b b" { type discrete [ 3 ] { x, y, z }; }
probability ( a ) { table 0.2, 0.8; }
probability ( "b b" | a ) { (no) 0.1, 0.2, 0.7; (yes) 2, 1, 1; }
"""


def test_bif():
    net = bif.parse_bif(BIF)
    assert net.names == ["a", "b b"] and net.parents == [[], [0]] and net.edges() == [(0, 1)]
    assert np.allclose(net.tables[1], [[0.1, 0.2, 0.7], [0.5, 0.25, 0.25]])
    assert net.info()["parameters"] == 5
    with pytest.raises(ValueError):
        bif.parse_bif(BIF.replace("(yes) 2, 1, 1;", ""))


def test_sampling_and_divergence(spark):
    net = bif.parse_bif(BIF.replace('"b b"', "b"))
    rows = evaluation.sample(spark, net, 20000, 3)
    vs = Variables(("a", "b"), (2, 3))
    fitted = evaluation.fit(rows, [(0, 1)], vs)
    assert evaluation.kl_divergence(spark, net, fitted).first().kl < 0.001
    assert evaluation.kl_divergence(spark, net, evaluation.fit(rows, [], vs)).first().kl > 0.01


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\tb\n0\t1\n1\t0\n1\t1\n")
    df = tables.read_discrete(spark, str(tmp_path / "m.tsv"))
    assert sorted(map(tuple, df.collect())) == [(0, 1), (1, 0), (1, 1)]
    vs = Variables(("a", "b"), (2, 2))
    families = families_of([(0, 1)], 2)
    counts = family_counts(df, families, vs)
    tables.write_counts(counts, families, vs, str(tmp_path / "c"))
    again = tables.read_counts(spark, str(tmp_path / "c"))
    key = lambda d: sorted(map(tuple, d.select("v", "j", "k", "n").collect()))
    assert key(again) == key(counts)
    (tmp_path / "e.txt").write_text("# edges\nu v\n0 1\n1,0\n0\t1\n")
    assert sorted(map(tuple, tables.read_edges(spark, str(tmp_path / "e.txt")).collect())) == [(0, 1), (1, 0)]
    (tmp_path / "n.txt").write_text("parent child\na b\n")
    assert [tuple(r) for r in tables.read_edges(spark, str(tmp_path / "n.txt"), vs).collect()] == [(0, 1)]


def test_separation():
    chain, collider = [(0, 1), (1, 2)], [(0, 1), (2, 1)]
    assert not evaluation.separated(3, chain, 0, 2, set()) and evaluation.separated(3, chain, 0, 2, {1})
    assert evaluation.separated(3, collider, 0, 2, set()) and not evaluation.separated(3, collider, 0, 2, {1})
    assert not evaluation.is_dag(2, [(0, 1), (1, 0)])


def test_streamed_counts(spark, tmp_path):
    from arbora.streaming.counts import current, maintain

    vs, families = Variables(("a", "b"), (2, 2)), families_of([(0, 1)], 2)
    rows = spark.createDataFrame([(i % 2, (i // 3) % 2) for i in range(40)], "a int, b int")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    maintain(stream, families, vs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda d: sorted(map(tuple, d.select("family", "v", "j", "k", "n").collect()))
    assert key(current(spark, str(tmp_path / "out"))) == key(family_counts(rows, families, vs))


def test_edges_that_are_none_raise(spark, tmp_path):
    vs = Variables(("a", "b"), (2, 2))
    for i, text in enumerate(("0 0\n", "0 2\n", "a c\n")):
        (tmp_path / f"{i}.txt").write_text(text)
        with pytest.raises(Exception, match="not an edge"):
            tables.read_edges(spark, str(tmp_path / f"{i}.txt"), vs).collect()
    (tmp_path / "mixed.txt").write_text("0 b\n")
    assert [tuple(r) for r in tables.read_edges(spark, str(tmp_path / "mixed.txt"), vs).collect()] == [(0, 1)]


def test_fitted_tables_come_back_with_their_structure(spark, tmp_path):
    vs = Variables(("a", "b", "c"), (2, 3, 2))
    families = families_of([(0, 2), (1, 2)], 3)
    df = spark.createDataFrame([(i % 2, i % 3, (i // 2) % 2) for i in range(50)], "a int, b int, c int")
    counts = family_counts(df, families, vs)
    tables.write_counts(counts, families, vs, str(tmp_path / "c"))
    again, f2, v2 = files.read_fitted(spark, str(tmp_path / "c"))
    assert (f2, v2) == (families, vs)
    t = files.conditional_table(again, f2, v2, 1.0)
    rows = {(r.node_id, r.j, r.k): r for r in t.collect()}
    assert len(rows) == 2 + 3 + 12 and rows[2, 5, 1].parent_values == [1, 2] and rows[2, 0, 0].parent_names == ["a", "b"] and rows[0, 0, 0].parent_ids == []
    files.write_conditional(t, str(tmp_path / "cpt"), per_node=True)
    back = spark.read.csv(str(tmp_path / "cpt"), sep="\t", header=True, inferSchema=True)
    assert {(r.node_id, r.j, r.k): r.prob for r in back.collect()} == pytest.approx({k: r.prob for k, r in rows.items()}, abs=1e-9)


def test_edge_tables_round_trip(spark, tmp_path):
    key = lambda d: sorted(map(tuple, d.collect()))
    freq = spark.createDataFrame([(1, 0, 1, 8, 0.8), (1, 1, 2, 5, 0.5), (20002, 0, 1, 9, 0.9)], "seed int, u int, v int, count long, prob double")
    files.write_bootstrap(freq, str(tmp_path / "b"))
    assert key(files.read_bootstrap(spark, str(tmp_path / "b"))) == key(freq)  # seeds that are equal modulo 10000 stay apart
    files.write_consensus(freq.drop("seed"), str(tmp_path / "k"))
    assert [r.prob for r in files.read_consensus(spark, str(tmp_path / "k")).collect()] == [0.9, 0.8, 0.5]
    imp = spark.createDataFrame([(0, 1, -1.0, 2.0, 0.5, -0.25, 1e-17, 0.125), (1, 2, -3.0, 0.1, 0.2, 0.3, -0.7, 0.9)], tables.IMPORTANCE)
    files.write_importance(imp, str(tmp_path / "i"))
    assert key(tables.read_importance(spark, str(tmp_path / "i"))) == key(imp)
    ranked = files.ranked_importance(imp, "d_loglik", Variables(("x", "y", "z"), (2, 2, 2)))
    assert [(r["rank"], r.u_name, r.importance) for r in ranked.collect()] == [(1, "y", 3.0), (2, "x", 1.0)]
    (tmp_path / "e.tsv").write_text("0\t1\n1\t2\n")
    (tmp_path / "n.tsv").write_text("x\ty\ny\tz\n")
    assert key(files.read_aligned(spark, str(tmp_path / "e.tsv"), str(tmp_path / "n.tsv"))) == [(0, 1, "x", "y"), (1, 2, "y", "z")]
    (tmp_path / "n.tsv").write_text("x\ty\n")
    with pytest.raises(Exception, match="differ in length"):
        files.read_aligned(spark, str(tmp_path / "e.tsv"), str(tmp_path / "n.tsv")).collect()
    v = spark.createDataFrame([("a", "b", "TP")], "u string, v string, status string")
    files.write_table(v, str(tmp_path / "v"))
    assert key(files.read_verdicts(spark, str(tmp_path / "v"))) == key(v)
    (tmp_path / "net").mkdir()
    (tmp_path / "net" / "edges.tsv").write_text("# c\n0\t1\n")
    assert key(files.discover(spark, str(tmp_path))) == [("net", 1, False)]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in (None, 0.1, float("inf"), 1e-9, 3.0)], "x double").select(files.general(F.col("x"))).collect()] == ["NA", "0.100000", "inf", "1.00000e-09", "3.00000"]


def test_expression_matrices(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("made by hand\nid\tname\tlen\ts1\ts2\tnote\ng1\tA\t1000\t1\tx\tu\ng2\tB\tbad\t3\t4\tv\n")
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    got = files.load_expression(spark, str(tmp_path / "m.tsv"), "id", name=1, length=2, header_row=1)
    assert key(got) == [("g1", "A", 1000.0, "s1", 1.0), ("g1", "A", 1000.0, "s2", 0.0), ("g2", "B", None, "s1", 3.0), ("g2", "B", None, "s2", 4.0)]
    turned = files.load_expression(spark, str(tmp_path / "m.tsv"), 0, drop=["name", "len", -1], genes_in_rows=False, header_row=1)
    assert {(r.gene, r["sample"], r.value) for r in turned.collect()} == {("s1", "g1", 1.0), ("s2", "g1", 0.0), ("s1", "g2", 3.0), ("s2", "g2", 4.0)}
    (tmp_path / "s.tsv").write_text("sample\tkind of cell\ns1\tT cell\ns2\t\n")
    assert [(r["sample"], r.group) for r in files.load_samples(spark, str(tmp_path / "s.tsv")).orderBy("ix").collect()] == [("s1", "T_cell"), ("s2", "NA")]
    hit, missing = files.match_list(got.select("gene", "gene_name").distinct(), spark.createDataFrame([("g1",), ("B",), ("none",)], "name string"))
    assert hit.count() == 2 and key(missing) == [("none",)]
    with pytest.raises(ValueError):
        files.resolve(["a", "b"], ["c"])
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/net1_a.tsv", '"Time"\t"g1"\t"g2"\n0\t1.5\t2\n')
        z.writestr("d/net1_b.tsv", '"g1"\t"g2"\n3\t4\n')
    both = archive.read_matrices(spark, str(tmp_path / "z.zip"), ["*net1_*.tsv"], drop=["Time"])
    assert key(both.select("g1", "g2", "member")) == [(1.5, 2.0, "d/net1_a.tsv"), (3.0, 4.0, "d/net1_b.tsv")]
    label = spark.createDataFrame([("/x/Lung.SmartSeq2.tsv",), ("Heart.csv",)], "p string").select(files.tissue_label(F.col("p")))
    assert [r[0] for r in label.collect()] == ["Lung", "Heart"]
