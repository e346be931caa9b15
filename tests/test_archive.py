"""Archives, folders of files and numbers of lines."""

import zipfile

import pytest
from pyspark.sql import functions as F

from arbora.operators import edges as sets
from arbora.operators import prep
from arbora.sources import archive, files


@pytest.fixture()
def dream(tmp_path):
    path = str(tmp_path / "dream.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        net = "DREAM4/DREAM4 training data/insilico_size3_1/insilico_size3_1"
        z.writestr(f"{net}_multifactorial.tsv", '"G1"\t"G2"\t"G3"\n0.1\t0.2\t0.3\n0.4\t0.5\t0.6\n')
        z.writestr(f"{net}_knockouts.tsv", '"G1"\t"G2"\t"G3"\n1\t2\t3\nbad\t2\t3\n1\t2\n')
        z.writestr(f"{net}_knockdowns.tsv", '"G1"\t"G2"\t"G3"\n4\t5\t6\n')
        z.writestr(f"{net}_timeseries.tsv", '"Time"\t"G1"\t"G2"\t"G3"\n0\t7\t8\t9\n\n10\t10\t11\t12\n')
        z.writestr(f"{net}_wildtype.tsv", '"G1"\t"G2"\t"G3"\n13\t14\t15\n')
        z.writestr("DREAM4/DREAM4 gold standards/insilico_size3_1_goldstandard.tsv", "G1\tG2\t1\nG2\tG3\t0\nG3\tG1\t1\nshort\tline\n")
        other = "DREAM4/DREAM4 training data/insilico_size3_2/insilico_size3_2"
        z.writestr(f"{other}_multifactorial.tsv", "G1\tG2\n1\t2\n")
        z.writestr(f"{other}_knockouts.tsv", "G2\tG1\n1\t2\n")
        z.writestr("DREAM4/DREAM4 gold standards/insilico_size3_2_goldstandard.tsv", "G1\tG2\t1\n")
        z.writestr("DREAM5/net3_expression_data.tsv", "A\tB\tC\n" + "".join(f"{i}\t{i + 1}\t{i + 2}\n" for i in range(9000)))
        z.writestr("DREAM5/net3_transcription_factors.tsv", "A\nC B\n")
        z.writestr("DREAM5/Network3/gold standard/g.tsv", "A\tB\t1\nA\tC\t0\nB\tC\n")
    return path


def test_parts_are_stacked_in_their_order(spark, dream, monkeypatch, tmp_path):
    data, gold = archive.read_dream4(spark, dream, "insilico_size3_1")
    assert data.columns == ["part", "member", "line", "G1", "G2", "G3"] and data.rdd.getNumPartitions() == 5
    rows = [tuple(r) for r in data.orderBy("part", "line").select("part", "line", "G1", "G3").collect()]
    assert rows == [(0, 0, 0.1, 0.3), (0, 1, 0.4, 0.6), (1, 0, 1, 3), (2, 0, 4, 6), (3, 0, 7, 9), (3, 1, 10, 12), (4, 0, 13, 15)]
    assert [tuple(r)[1:] for r in gold.orderBy("line").collect()] == [("G1", "G2", True), ("G2", "G3", False), ("G3", "G1", True)]
    some, _ = archive.read_dream4(spark, dream, "insilico_size3_1", ["timeseries", "nothing", "wildtype"])
    assert [r.G1 for r in some.orderBy("part", "line").collect()] == [7, 10, 13]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["dream.zip"]  # nothing was unpacked beside it
    with pytest.raises(Exception, match="other columns"):
        archive.read_dream4(spark, dream, "insilico_size3_2")[0].collect()
    with pytest.raises(ValueError, match="no training data"):
        archive.read_dream4(spark, dream, "insilico_size9_9")


def test_expression_regulators_and_gold_standard(spark, dream):
    data, regulators, gold = archive.read_dream5(spark, dream, 3)
    assert data.count() == 9000 and data.agg(F.sum("A"), F.max("C"), F.max("line")).first()[:] == (9000 * 8999 / 2, 9001, 8999)
    assert sorted(r.name for r in regulators.collect()) == ["A", "B", "C"]
    assert [tuple(r)[1:] for r in gold.orderBy("line").collect()] == [("A", "B", True), ("A", "C", False), ("B", "C", True)]
    kept = sets.within(gold.where("is_edge").select("u", "v"), spark.createDataFrame([("B",), ("C",)], "name string"))
    assert [tuple(r) for r in kept.collect()] == [("B", "C")]
    lines = archive.read_lines(spark, dream, ["*_transcription_factors.tsv"]).orderBy("line").collect()
    assert [(r.line, r.value) for r in lines] == [(0, "A"), (1, "C B")]
    with pytest.raises(Exception, match="no member"):
        archive.read_lines(spark, dream, ["nothing*"]).collect()


def test_priority_is_cut_by_variance(spark):
    stats = spark.createDataFrame([(f"g{i}", float(i)) for i in range(8)], "gene string, variance double")
    names = lambda df: sorted(r.gene for r in df.collect())
    assert names(prep.top_variance(stats, 3, ["g0", "g1"], including=True)) == ["g0", "g1", "g7"]
    assert names(prep.top_variance(stats, 2, ["g0", "g1", "g5"], including=True)) == ["g1", "g5"]
    assert names(prep.top_variance(stats, 2, ["g0", "g7"])) == ["g0", "g6", "g7"]


def test_placed_folder(spark, tmp_path):
    assert archive.read_placed(spark, str(tmp_path)) is None
    (tmp_path / "expression.tsv").write_text('"a"\tb\n1\t2.5\n3\t4\n')
    (tmp_path / "true_edges.tsv").write_text("a b extra\nb\ta\nlone\n")
    data, edges = archive.read_placed(spark, str(tmp_path))
    assert [tuple(r) for r in data.orderBy("a").collect()] == [(1.0, 2.5), (3.0, 4.0)]
    assert sorted(tuple(r) for r in edges.collect()) == [("a", "b"), ("b", "a")]


def test_tissues_are_concatenated_by_name(spark, tmp_path):
    (tmp_path / "Lung.smartseq2.tsv").write_text("g1\tg2\tx\n0\t1\t0\n1\t1\t0\n")
    (tmp_path / "Heart.10x.tsv").write_text("g1\tg2\tx\n0\t0\t0\n\n1\t0\t0\n2\t2\t2\n")
    found = archive.tissue_samples(spark, str(tmp_path / "*.tsv"), ["g1", "g2"], 5)
    assert [tuple(r) for r in found.orderBy("row_index").collect()] == [(0, "Heart_1", "Heart"), (1, "Heart_2", "Heart"), (2, "Heart_3", "Heart"), (3, "Lung_1", "Lung"), (4, "Lung_2", "Lung")]
    assert archive.tissue_samples(spark, str(tmp_path / "*.tsv"), ["g1", "g2"], 6) is None
    assert archive.tissue_samples(spark, str(tmp_path / "*.tsv"), ["g2", "g1"], 5) is None


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    n = 200_000
    (tmp_path / "e.tsv").write_text("# comment\n" + "".join(f"{i}\t{i + 1}\n" for i in range(n)))
    (tmp_path / "n.tsv").write_text("".join(f"a{i}\tb{i}\n{'' if i % 1000 else chr(10)}" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        both = files.read_aligned(spark, str(tmp_path / "e.tsv"), str(tmp_path / "n.tsv"))
        wrong = both.where((F.concat(F.lit("a"), F.col("u")) != F.col("u_name")) | (F.concat(F.lit("b"), F.col("v") - 1) != F.col("v_name")))
        assert both.count() == n and wrong.count() == 0
        plan = both._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan
        lines = files.numbered_lines(spark, str(tmp_path / "e.tsv"))
        assert lines.rdd.getNumPartitions() > 4 and lines.where("line > 0 AND cast(split(value, '\t')[0] AS long) <> line - 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "q.csv").write_text('made by hand\ngene,"a, b",c\n"x ""y""",1,2\nz,"3,5",\nw,4\n')
    wide = files.read_wide(spark, str(tmp_path / "q.csv"), header_row=1)
    assert wide.columns == ["gene", "a, b", "c"]
    got = [tuple(r) for r in wide.collect()]
    assert got[0] == ('x "y"', "1", "2") and got[1][:2] == ("z", "3,5") and got[2][:2] == ("w", "4") and got[2][2] is None
    with pytest.raises(ValueError, match="no line 9"):
        files.read_wide(spark, str(tmp_path / "q.csv"), header_row=9)


def test_bootstrap_files_and_seeds(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text("u\tv\tcount\tprob\textra\n0\t1\t3\t0.3\tz\n1\t2\t4\t0.4\n\n5\t6\n")
    (tmp_path / "s2.tsv").write_text("0\t9\t9\t0.9\n0\t1\t5\t0.5\n")
    got = files.read_bootstrap_files(spark, [str(tmp_path / "s1.tsv"), str(tmp_path / "s2.tsv")])
    assert sorted((r.file[-6:], r.u, r.v, r["count"], r.prob) for r in got.collect()) == [("s1.tsv", 0, 1, 3, 0.3), ("s1.tsv", 1, 2, 4, 0.4), ("s2.tsv", 0, 1, 5, 0.5)]
    rows = spark.createDataFrame([(2025, 0, 1, 1, 0.5), (12025, 0, 1, 2, 1.0)], "seed int, u int, v int, count long, prob double")
    files.write_bootstrap(rows, str(tmp_path / "b"))
    assert sorted((r.seed, r["count"]) for r in files.read_bootstrap(spark, str(tmp_path / "b")).collect()) == [(2025, 1), (12025, 2)]


def test_importance_of_unlisted_edges(spark):
    e = spark.createDataFrame([(0, 1), (1, 2)], "u int, v int")
    imp = spark.createDataFrame([(0, 1, -2.5), (5, 6, 1.0)], "u int, v int, importance double")
    assert sorted(map(tuple, sets.with_importance(e, imp).collect())) == [(0, 1, -2.5), (1, 2, 0.0)]
