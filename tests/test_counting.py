"""Closure, resamples, tables of many runs and importance against plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora import catalog
from arbora.operators import counts as C
from arbora.operators import importance
from arbora.operators.importance import edge_importance
from arbora.operators.order import numbered
from arbora.operators.scores import score_requests
from arbora.plans import bootstrap as boot
from arbora.plans.search import Config, Gains, Graph, bits, climb, kept, learn, spark_scorer


def reachable(edges, n):
    out = [{v} for v in range(n)]
    for _ in range(n):
        for u, v in edges:
            out[u] |= out[v]
    return out


@pytest.mark.parametrize("n", [5, 9, 80])
def test_closure_of_random_moves(n):
    draw = random.Random(n)
    g, edges = Graph(n), set()
    for _ in range(400 if n < 20 else 150):
        u, v = draw.sample(range(n), 2)
        if (u, v) in edges:
            if draw.random() < 0.4:
                free = g.turns(u, v)
                rest = edges - {(u, v)}
                assert free == (v not in reachable(rest, n)[u])
                g.remove(u, v)
                edges = rest
                if free and draw.random() < 0.5:
                    g.add(v, u)
                    edges = edges | {(v, u)}
        elif not g.reaches(v, u):
            g.add(u, v)
            edges.add((u, v))
        want = reachable(edges, n)
        assert all(set(bits(g.below[x])) == want[x] for x in range(n))
        assert all(set(bits(g.above[x])) == {y for y in range(n) if x in want[y]} for x in range(n))
    with pytest.raises(ValueError, match="cycle"):
        Graph(3, [(0, 1), (1, 2), (2, 0)])


def test_draws_add_up_and_do_not_depend_on_the_task():
    for n in (1, 2, 1023, 1024, 1025, 5000, 10_000):
        for run in (0, 3, (2025 << 32) + 7):
            whole = C.Draws(n, run).of(np.arange(n))
            assert whole.sum() == n and whole.min() >= 0
            pieces = np.array_split(np.random.Generator(np.random.PCG64(1)).permutation(n), 7)
            own = np.empty(n, np.int64)
            for p in pieces:
                own[p] = C.Draws(n, run).of(p)
            assert (own == whole).all()
    many = np.concatenate([C.Draws(4000, r).of(np.arange(4000)) for r in range(200)])
    assert abs(many.var() - 1) < 0.02 and abs((many == 0).mean() - math.exp(-1)) < 0.003
    # The halves of the rows share the draws as a binomial does.
    halves = np.array([C.Draws(4000, r).of(np.arange(2000)).sum() for r in range(400)])
    assert abs(halves.mean() - 2000) < 10 and 0.8 < halves.var() / 1000 < 1.25


@pytest.fixture(scope="module")
def frame(spark):
    draw = random.Random(1)
    rows = []
    for i in range(500):
        a = draw.randrange(3)
        b = a if draw.random() < 0.8 else draw.randrange(3)
        c = (a + b) % 2 if draw.random() < 0.9 else draw.randrange(2)
        rows.append((i, a, b, c, draw.randrange(2), draw.choice(["x", "y", None])))
    return spark.createDataFrame(rows, "id long, a int, b int, c int, d int, grp string").repartition(5), rows


VS = C.Variables(("a", "b", "c", "d"), (3, 3, 2, 2))


def test_numbers_do_not_depend_on_partitions(spark, frame):
    df, _ = frame
    key = [F.xxhash64("id"), "id"]
    one, other = ({r.id: r.n for r in numbered(x, key, "n").collect()} for x in (df, df.repartition(2)))
    assert one == other and sorted(one.values()) == list(range(500))
    assert numbered(df.limit(0), key, "n").count() == 0 and numbered(df, ["a"], "N", 5).agg(F.min("n"), F.max("n")).first()[:] == (5, 504)


@pytest.mark.parametrize(("dense", "exact"), [(1 << 16, True), (4, True), (1 << 16, False)])
def test_tables_of_many_runs(spark, frame, monkeypatch, dense, exact):
    """One scan of all runs gives what counting each resample's rows by itself does."""
    monkeypatch.setattr(C, "DENSE", dense)
    df, rows = frame
    n = numbered(df, [F.xxhash64("id"), "id"], "key")
    if not exact:
        n = n.withColumn("key", F.xxhash64("id"))
    key = {r.id: r.key for r in n.collect()}
    data = kept(C.pack(n.select("a", "b", "c", "d", "key"), VS, key="key", draws=500 if exact else None))
    families = [(0, ()), (1, (0,)), (2, (0, 1)), (3, ()), (2, (0, 1, 3))]
    requests = [(run, f) for f in families for run in (None, 5, 6, 7)] + [(9, (0, (1,)))]
    random.Random(2).shuffle(requests)
    got = Counter({(r.family, r.j, r.k): r.n for r in C.count_cells(data, requests).collect()})
    want = Counter()
    keys = np.array([key[r[0]] for r in rows])
    for place, (run, (v, ps)) in enumerate(requests):
        w = np.ones(500, int) if run is None else C.Draws(500, run).of(keys) if exact else C.poisson(keys, run)
        for r, m in zip(rows, w.tolist(), strict=True):
            j = 0
            for p in ps:
                j = j * VS.cards[p] + r[1 + p]
            if m:
                want[place, j, r[1 + v]] += m
    assert got == want
    # Scores of dense and of listed tables agree with those of the cells.
    found = {r.family: r for r in score_requests(data, requests, 2.0).collect()}
    for place, (_, (v, ps)) in enumerate(requests):
        r, q = VS.cards[v], math.prod(VS.cards[p] for p in ps)
        cells = {(j, k): n for (f, j, k), n in want.items() if f == place}
        nj = Counter()
        for (j, _), n in cells.items():
            nj[j] += n
        loglik = sum(n * math.log(n / nj[j]) for (j, _), n in cells.items())
        k2 = sum(math.lgamma(n + 1) for n in cells.values()) + sum(math.lgamma(r) - math.lgamma(n + r) for n in nj.values())
        bdeu = sum(math.lgamma(n + 2 / q / r) - math.lgamma(2 / q / r) for n in cells.values()) + sum(math.lgamma(2 / q) - math.lgamma(2 / q + n) for n in nj.values())
        bic = loglik - 0.5 * (r - 1) * q * math.log(sum(nj.values()))
        assert (found[place].loglik, found[place].bic, found[place].k2, found[place].bdeu) == pytest.approx((loglik, bic, k2, bdeu), abs=1e-7)


def test_exact_bootstrap_is_the_same_on_other_partitions(spark, frame):
    df, _ = frame
    cfg = Config(tabu_tenure=3, max_iter=12, assoc_rows=0)
    one, other = ({(r.seed, r.u, r.v): r["count"] for r in boot.bootstrap(x, ["id"], 4, (1, 2), cfg, names=list("abcd")).collect()} for x in (df, df.repartition(1)))
    assert one == other and one


@pytest.mark.parametrize("ahead", [0, 12])
def test_looking_ahead_changes_no_move(spark, frame, ahead):
    df, _ = frame
    whole = learn(df, Config(tabu_tenure=5, max_iter=15, assoc_rows=0, ahead=0), names=list("abcd"))
    data = kept(C.pack(df.select(*"abcd"), VS))
    inner, asked = spark_scorer(data, "bic", 1.0), []

    def counted(families, soon):
        asked.append(len(families))
        return inner(families, soon)

    found = climb(4, [set(range(4)) - {v} for v in range(4)], counted, Config(tabu_tenure=5, max_iter=15, top_k=0, ahead=ahead))
    assert found.trace == [pytest.approx(t) if isinstance(t, float) else t for t in whole.trace] or [t[:4] for t in found.trace] == [t[:4] for t in whole.trace]
    assert set(found.edges) == set(whole.edges)


def test_families_soon_are_those_of_the_next_moves(spark):
    g = Graph(3)
    gains = Gains(g, [{1, 2}, {0, 2}, {0, 1}], Config())
    known = {f: float(-len(f[1])) for v in range(3) for f in gains.families(v)}
    known[1, (0,)] = 5.0
    for v in range(3):
        gains.update(v, known)
    assert set(gains.soon(1, [])) == {(1, (0,)), (1, (0, 2)), (1, ())}
    g.add(1, 0)  # now it would close a cycle
    assert (1, (2,)) in gains.soon(3, [])


def brute_importance(rows, edges, alpha, ess):
    parents = {v: sorted(u for u, w in edges if w == v) for _, v in edges}
    out = {}

    def parts(v, ps):
        n, nj = Counter(), Counter()
        for r in rows:
            j = tuple(r[1 + p] for p in ps)
            n[j, r[1 + v]] += 1
            nj[j] += 1
        r, q = VS.cards[v], math.prod(VS.cards[p] for p in ps)
        ll = sum(m * math.log(m / nj[j]) for (j, _), m in n.items())
        return {
            "d_loglik": ll,
            "d_bic": ll - 0.5 * (r - 1) * q * math.log(len(rows)),
            "d_k2": sum(math.lgamma(m + 1) for m in n.values()) + sum(math.lgamma(r) - math.lgamma(m + r) for m in nj.values()),
            "d_bdeu": sum(math.lgamma(m + ess / q / r) - math.lgamma(ess / q / r) for m in n.values()) + sum(math.lgamma(ess / q) - math.lgamma(ess / q + m) for m in nj.values()),
        }, lambda row: math.log((n[tuple(row[1 + p] for p in ps), row[1 + v]] + alpha / r) / (nj[tuple(row[1 + p] for p in ps)] + alpha))

    for u, v in edges:
        full, p_full = parts(v, parents[v])
        less, p_less = parts(v, [p for p in parents[v] if p != u])
        d = [p_less(r) - p_full(r) for r in rows]
        mean = sum(d) / len(d)
        std = math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1)) if len(d) > 1 else 0.0
        out[u, v] = (*[less[k] - full[k] for k in full], mean, std, len(d))
    return out


@pytest.mark.parametrize(("alpha", "dense"), [(0.0, 1 << 16), (1.5, 1 << 16), (1.0, 8)])
def test_importance(spark, frame, monkeypatch, alpha, dense):
    monkeypatch.setattr(C, "DENSE", dense)
    df, rows = frame
    edges = [(0, 1), (0, 2), (1, 2), (3, 2), (2, 0)][:4]
    names = ["d_loglik", "d_bic", "d_k2", "d_bdeu", "mean_dlogl", "std_dlogl", "n_finite"]
    got = {(r.u, r.v): tuple(r[c] for c in names) for r in edge_importance(df, edges, VS, alpha, 3.0).collect()}
    for e, want in brute_importance(rows, edges, alpha, 3.0).items():
        assert got[e] == pytest.approx(want, abs=1e-8)
    by = edge_importance(df.withColumn("g", F.col("grp")), edges, VS, alpha, 3.0, by=["g"]).collect()
    assert len(by) == 12
    for g, own in itertools.groupby(sorted(rows, key=lambda r: str(r[5])), key=lambda r: r[5]):
        want = brute_importance(list(own), edges, alpha, 3.0)
        for r in by:
            if r.g == g:
                assert tuple(r[c] for c in names) == pytest.approx(want[r.u, r.v], abs=1e-8)


def test_importance_of_one_sample_and_no_edges(spark, frame):
    df, _ = frame
    r = edge_importance(df.limit(1), [(0, 1)], VS).first()
    assert r.n_finite == 1 and r.std_dlogl == 0
    assert edge_importance(df, [], VS, by=["grp"]).columns[:3] == ["grp", "u", "v"]


@pytest.mark.parametrize("compact", [1 << 14, 0])
def test_rows_do_not_meet_by_group(spark, frame, monkeypatch, compact):
    """Groups are sent to the rows, and of few possible rows each group's different ones are counted first."""
    df, rows = frame
    edges = [(0, 1), (0, 2), (1, 2)]
    want = sorted(map(str, edge_importance(df, edges, VS, 1.0, 3.0, by=["grp"]).collect()))
    monkeypatch.setattr(importance, "COMPACT", compact)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = edge_importance(df, edges, VS, 1.0, 3.0, by=["grp"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
        assert sorted(map(str, out.collect())) == want and len(want) == 9
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("dense", [1 << 16, 4])
def test_resamples_of_few_possible_rows(spark, frame, monkeypatch, dense):
    """One scan counts the different rows of all resamples, and all their tables come from it."""
    monkeypatch.setattr(C, "DENSE", dense)
    df, rows = frame
    numbers = numbered(df, [F.xxhash64(*df.columns)], "number", 0)
    packed = C.pack(numbers.select(*VS.names, "number"), VS, key="number", draws=len(rows))
    runs = [7, 3, 5]
    small = C.resampled(packed, runs)
    asked = [(run, C.normal(v, ps)) for v, ps in [(0, ()), (1, (0, 2)), (2, (3,)), (3, (0, 1, 2))] for run in (3, 5, 7)]
    got = lambda data: sorted(tuple(r) for r in C.count_cells(data, asked).collect())
    assert got(small) == got(packed)
    with pytest.raises(ValueError, match="resamples"):
        C.count_cells(small, [(None, (0, ()))])
    kinds = small.rows.where("var = 0").collect()
    assert len(kinds) == 1 and len(kinds[0].states) <= math.prod(VS.cards)


def test_bootstrap_by_different_rows_changes_nothing(spark, frame, monkeypatch):
    df, _ = frame
    df = df.select(F.monotonically_increasing_id().alias("id"), *VS.names).localCheckpoint()
    run = lambda: sorted(map(tuple, boot.bootstrap(df, ["id"], 4, (1, 2), Config(tabu_tenure=0), names=list(VS.names)).collect()))
    got = run()
    monkeypatch.setattr(boot, "COMPACT", 0)
    assert got == run() and got


def test_lines_of_few_groups_are_written_out_by_many_tasks(spark, monkeypatch):
    lines = catalog._keyed(spark, "/root/testdata/sf0.001")
    whole = sorted(map(tuple, lines.collect()))
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    monkeypatch.setattr(catalog, "PIECE", 1)
    assert sorted(map(tuple, catalog._keyed(spark, "/root/testdata/sf0.001").collect())) == whole
    assert len({r[0] for r in whole}) == len(whole) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
