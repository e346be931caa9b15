"""Groups, targets and settings."""

import pytest

from arbora.operators import groups as G
from arbora.operators import profile
from arbora.plans.settings import Settings


def rows(df):
    return sorted(tuple(r) for r in df.select("row_index", "group").collect())


def test_groups_three_ways(spark):
    want = [(0, "Lung_A"), (1, "Lung_A"), (2, "B"), (3, "B"), (4, "B")]
    samples = spark.createDataFrame([(2, "s2", "B"), (0, "s0", " Lung A"), (1, "s1", "Lung/A "), (4, "s4", "B"), (3, "s3", "B")], "row_index int, sample_id string, group string")
    assert rows(G.from_samples(samples, 5)) == want
    meta = spark.createDataFrame([(10, "Lung A"), (11, "Lung A"), (12, "B"), (13, "B"), (14, "B")], "ix int, kind string").repartition(3)
    assert rows(G.from_metadata(meta, 5, ["ix"], "kind")) == want
    assert rows(G.from_sizes(spark, ["Lung A", "B", "C"], [2, 3, 0], 5)) == want
    assert {tuple(r) for r in G.sizes(G.from_sizes(spark, ["Lung A", "B"], [1, 4], 5)).collect()} == {("Lung_A", 1, 0, False), ("B", 4, 1, True)}
    assert rows(G.from_sizes(spark, [], [], 0)) == []


def test_groups_that_do_not_cover_the_matrix(spark):
    samples = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b")], "row_index int, group string")
    for n in (2, 3, 4):  # too many, one place twice, too few
        with pytest.raises(ValueError, match="samples"):
            G.from_samples(samples, n)
    with pytest.raises(ValueError, match="metadata"):
        G.from_metadata(samples, 5, ["row_index"])
    for labels, sizes in ((["a"], [1, 4]), (["a", "b"], [1, 3]), (["a", "b"], [6, -1])):
        with pytest.raises(ValueError):
            G.from_sizes(spark, labels, sizes, 5)


def test_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# listed\nTP53\n\n  MYC  \nTP53\n")
    assert sorted(r.name for r in G.targets(spark, str(tmp_path / "t.txt")).collect()) == ["MYC", "TP53"]
    var_map = spark.createDataFrame([("TP53", 1), ("X", 0)], "gene_name string, whitelisted int")
    assert [r.name for r in G.targets(spark, None, var_map).collect()] == ["TP53"] and G.targets(spark).count() == 0
    nodes = spark.createDataFrame([("TP53__ENSG1",), ("MYC",), ("A__MYC",), (None,)], "name string")
    got = {r.name: r.target for r in G.with_target(nodes, G.targets(spark, str(tmp_path / "t.txt"))).collect()}
    assert got == {"TP53__ENSG1": True, "MYC": True, "A__MYC": False, None: False}


def test_settings(spark):
    s = Settings().with_options({"NORMALIZE": "cpm", "LOG2": "0", "TOP_VAR_GENES": "60", "VAR_QUANTILE": "0.25", "SCORE": "bic", "THRESHOLD_PROB": "", "ess": "2.5"})
    assert (s.normalise, s.log2, s.top_variance, s.variance_quantile, s.score, s.least_prob, s.ess) == ("cpm", False, 60, 0.25, "bic", 0.3, 2.5)
    assert Settings.from_json(s.to_json()) == s
    cfg = s.search(resample=True)
    assert (cfg.score, cfg.max_iter, cfg.top_k) == ("bic", 1500, 20) and s.search().max_iter == 5000
    for bad in ({"NOTHING": "1"}, {"NORMALIZE": "x"}, {"N_BINS": "1"}, {"SCORE": "aic"}):
        with pytest.raises(ValueError):
            Settings().with_options(bad)
    suggested = Settings.suggested(240, 2000, "raw_counts")
    assert suggested.normalise == "cpm" and suggested.log2 and suggested.bins == 3 and suggested.top_variance == 500


def test_kinds_of_values():
    kinds = [profile.value_kind(*x) for x in ((0, 2, True, 3), (0, 9000, True, 400), (0, 40, True, 30), (0, 14.5, False, 900), (0, 4000.5, False, 900), (-3, 3, False, 900), (None, None, True, 0))]
    assert kinds == ["discretized", "raw_counts", "continuous_unknown", "log_transformed", "linear_normalized", "continuous_unknown", "unknown"]
