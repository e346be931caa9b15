"""A fixture of twelve rows whose values were computed independently from the published formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions.math import chi2_tail, digits, lgamma, mixed_radix
from arbora.operators import assoc, scores
from arbora.operators.counts import Variables, count_cells, drop_parent, family_counts, pack, poisson, variables
from arbora.operators.importance import edge_importance
from arbora.plans import bootstrap as boot
from arbora.plans.search import Config, Graph, learn, score_network

ROWS = [tuple(map(int, r)) for r in "000 001 011 111 110 112 000 102 112 000 111 010".split()]
VS = Variables(("x0", "x1", "x2"), (2, 2, 3))
FAMILIES = [(0, ()), (1, ()), (2, ()), (1, (0,)), (2, (0,)), (2, (0, 1))]
EXPECTED = [
    (-8.3177661667, -9.5602194916, -9.3936614291, -8.7255939329),
    (-8.1503191919, -9.3927725168, -9.2395107493, -8.6302837531),
    (-12.9306759248, -15.4155825746, -14.7407689598, -13.8613689526),
    (-6.5224522630, -9.0073589128, -8.3916299684, -8.1398124975),
    (-9.8875105980, -14.8573238976, -13.4668037837, -13.2362613454),
    (-8.9102357795, -18.8498623787, -14.1235833201, -14.3116161567),
]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, "x0 int, x1 int, x2 int").cache()


def test_cardinalities(data):
    assert variables(data) == VS
    with pytest.raises(ValueError):
        variables(data.withColumn("x0", F.when(F.col("x1") == 0, F.col("x0"))))


def test_scores(data):
    found = {r.family: r for r in scores.score_families(data, FAMILIES, VS, 10.0).collect()}
    for i, want in enumerate(EXPECTED):
        got = found[i]
        assert (got.loglik, got.bic, got.k2, got.bdeu) == pytest.approx(want, abs=1e-9)


def test_scores_of_requests(data):
    """The same in numpy, from packed columns; rows with a weight count as often."""
    packed = pack(data, VS)
    found = {r.family: r for r in scores.score_requests(packed, [(None, f) for f in FAMILIES], 10.0).collect()}
    weighed = pack(data.groupBy(*VS.names).agg(F.count("*").alias("w")), VS, weight="w")
    again = {r.family: r for r in scores.score_requests(weighed, [(None, f) for f in FAMILIES], 10.0).collect()}
    for i, want in enumerate(EXPECTED):
        for got in (found[i], again[i]):
            assert (got.loglik, got.bic, got.k2, got.bdeu) == pytest.approx(want, abs=1e-9)
    cells = {(r.family, r.j, r.k): r.n for r in count_cells(packed, [(None, f) for f in FAMILIES]).collect()}
    assert cells == {(r.family, r.j, r.k): r.n for r in family_counts(data, FAMILIES, VS).collect()}


def test_resamples_are_poisson():
    h = np.random.Generator(np.random.PCG64(1)).integers(-(1 << 63), 1 << 63, 200_000, dtype=np.int64)
    w, x = poisson(h, 1), poisson(h, 2)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w, x)[0, 1]) < 0.01
    assert (poisson(h[::-1].copy(), 1)[::-1] == w).all()


def test_bootstrap_in_lockstep(spark):
    rows = spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 2 * (F.col("id") % 7 > 0).cast("int")).cast("int").alias("b"), (F.floor(F.col("id") / 3) % 2).cast("int").alias("c"))
    got = {(r.seed, r.u, r.v): r for r in boot.bootstrap(rows, ["id"], 5, (1, 2), Config(tabu_tenure=0)).collect()}
    for seed in (1, 2):
        assert sum(r["count"] for (s, u, v), r in got.items() if s == seed and {u, v} == {0, 1}) == 5
        assert all(r.prob == r["count"] / 5 for r in got.values())


def test_association(data):
    got = {(r.u, r.v): r for r in assoc.with_p(assoc.associations(data, VS)).collect()}
    for pair, mi, chi2, df, p in (((0, 1), 0.135655577411, 3.0857142857, 1, 0.0789825793), ((0, 2), 0.253597110566, 4.8, 2, 0.0907179533), ((1, 2), 0.052198147791, 1.2342857143, 2, 0.5394836195)):
        r = got[pair]
        assert (r.mi, r.chi2, r.df, r.p) == pytest.approx((mi, chi2, df, p), abs=1e-9)


def test_loglik_and_importance(data):
    families = [(0, ()), (1, (0,)), (2, (0, 1))]
    c = family_counts(data, families, VS)
    r = scores.data_loglik(c, c, families, VS, 1.0).first()
    assert tuple(r) == pytest.approx((-24.7379918722, -2.0614993227, -0.6871664409), abs=1e-9)
    got = {(r.u, r.v): r for r in edge_importance(data, [(0, 1), (0, 2), (1, 2)], VS, 1.0, 10.0).collect()}[0, 2]
    assert (got.d_loglik, got.d_bic, got.d_k2, got.d_bdeu) == pytest.approx((-3.3940623718, 1.5757509278, -0.8472978604, -0.0495747856), abs=1e-9)
    assert (got.mean_dlogl, got.std_dlogl, got.n_finite) == pytest.approx((-0.206591265709, 0.338221293888, 12), abs=1e-9)


def test_unseen_event_is_minus_infinity(spark, data):
    families = [(0, ())]
    fit = family_counts(data.where("x0 = 0"), families, VS)
    r = scores.data_loglik(family_counts(data, families, VS), fit, families, VS, 0.0).first()
    assert all(math.isinf(x) and x < 0 for x in r)


def test_marginalising_equals_recounting(data):
    c = family_counts(data, [(2, (0, 1))], VS)
    key = lambda df: sorted(map(tuple, df.select("j", "k", "n").collect()))
    for p, rest in ((0, (1,)), (1, (0,))):
        assert key(drop_parent(c, (2, (0, 1)), p, VS)) == key(family_counts(data, [(2, rest)], VS))


def test_lgamma_and_tails(spark):
    xs = [1e-6, 0.03, 0.5, 1.0, 2.5, 10.0, 123.4, 1e7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(lgamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-9, abs=1e-9)
    t = spark.createDataFrame([(3.841458820694124, 1.0), (0.0, 3.0), (50.0, 4.0), (5.0, 0.0)], "s double, d double").select(chi2_tail("s", "d")).collect()
    assert [r[0] for r in t] == pytest.approx([0.05, 1.0, math.exp(-25) * 26, 1.0], abs=1e-12)


def test_mixed_radix_round_trip(spark):
    df = spark.range(30).select(((F.col("id") / 10).cast("int")).alias("a"), ((F.col("id") % 10) / 5).cast("int").alias("b"), (F.col("id") % 5).cast("int").alias("c"))
    j = mixed_radix([F.col(x) for x in "abc"], [3, 2, 5])
    a, b, c = digits(j, [3, 2, 5])
    assert df.select(j.alias("j"), (a == F.col("a")) & (b == F.col("b")) & (c == F.col("c"))).where("j < 0").count() == 0
    assert all(r[0] for r in df.select((a == F.col("a")) & (b == F.col("b")) & (c == F.col("c"))).collect())


def test_graph_refuses_cycles():
    with pytest.raises(ValueError):
        Graph(3, [(0, 1), (1, 2), (2, 0)])
    with pytest.raises(ValueError):
        Graph(2, [(0, 0)])


@pytest.mark.parametrize("tabu", [0, 3])
def test_search_score_equals_recomputed_score(spark, data, tabu):
    for score in ("bic", "k2", "bdeu"):
        r = learn(data, Config(score=score, ess=10.0, tabu_tenure=tabu, max_iter=6), vs=VS)
        Graph(3, r.edges)
        again = score_network(data, r.edges, VS, 10.0).groupBy().sum(score).first()[0]
        assert again == pytest.approx(r.score, abs=1e-9)
