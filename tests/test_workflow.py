"""Studies from end to end, and evaluation against plain definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators.counts import Variables
from arbora.plans import evaluation, workflow
from arbora.plans.search import Config


def moral_separated(n, edges, a, b, given):
    """d-separation by its other definition: no path in the moral graph of the ancestors that avoids the given nodes."""
    kept = {a, b} | given
    while more := {u for u, v in edges if v in kept} - kept:
        kept |= more
    near = {frozenset(e) for e in edges if set(e) <= kept}
    near |= {frozenset((u, w)) for (u, v), (w, x) in itertools.combinations(edges, 2) if v == x and v in kept}
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for y in kept - seen - given:
            if frozenset((x, y)) in near:
                seen.add(y)
                todo.append(y)
    return b not in seen


def plain_sid(n, truth, pred):
    """Errors of node i by the adjustment criterion, pair by pair."""
    down = {v: {w for w in range(n) if any((x, w) in truth for x in [v])} for v in range(n)}
    below = {v: set() for v in range(n)}
    for _ in range(n):
        below = {v: down[v].union(*(below[c] for c in down[v])) for v in range(n)}
    out = {}
    for i in range(n):
        z, own = {u for u, v in pred if v == i}, {u for u, v in truth if v == i}
        wrong = 0
        for j in set(range(n)) - {i}:
            if z == own:
                continue
            first = {c for c in down[i] if c == j or j in below[c]}
            if z & first.union(*(below[c] for c in first)):
                wrong += 1
            elif j not in z:
                wrong += not moral_separated(n, [e for e in truth if e[0] != i or e[1] not in first], i, j, z)
        out[i] = wrong
    return out


def random_dag(draw, n):
    order = draw.sample(range(n), n)
    return [(order[i], order[j]) for i in range(n) for j in range(i + 1, n) if draw.random() < 0.35]


def test_separation_and_sid_against_their_definitions():
    draw = random.Random(1)
    for _ in range(60):
        n = draw.randint(2, 7)
        truth, pred = random_dag(draw, n), random_dag(draw, n)
        for a, b in itertools.permutations(range(n), 2):
            given = {x for x in range(n) if x not in (a, b) and draw.random() < 0.4}
            assert evaluation.separated(n, truth, a, b, given) == moral_separated(n, truth, a, b, given)
        (own, children), other = evaluation.neighbours(n, truth), evaluation.neighbours(n, pred)[0]
        below = [evaluation.closure({v}, children) for v in range(n)]
        got = {i: 0 if own[i] == other[i] else evaluation.wrong_effects(i, own, children, below, other[i]) for i in range(n)}
        assert got == plain_sid(n, truth, pred)


@pytest.fixture(scope="module")
def rows(spark):
    """c follows a or b, d is noise, e follows c."""
    x = spark.range(400).select("id", (F.xxhash64(F.lit(1), "id") % 2 == 0).cast("int").alias("a"), (F.xxhash64(F.lit(2), "id") % 2 == 0).cast("int").alias("b"), (F.xxhash64(F.lit(3), "id") % 2 == 0).cast("int").alias("d"), (F.xxhash64(F.lit(4), "id") % 9 == 0).alias("flip"))
    x = x.withColumn("c", F.greatest("a", "b")).withColumn("e", F.when(F.col("flip"), 1 - F.col("c")).otherwise(F.col("c")))
    return x.select("id", "a", "b", "c", "d", "e", F.when(F.col("d") == 1, "p").otherwise("q").alias("grp")).cache()


def test_stability(spark, rows):
    s = workflow.stability(rows, ["id"], Config(tabu_tenure=0), replicates=4, seeds=(1, 2), group="grp", names=list("abcde"))
    assert {frozenset((0, 2)), frozenset((1, 2)), frozenset((2, 4))} <= {frozenset(e) for e in s.edges}
    assert evaluation.is_dag(5, s.edges) and s.importance.count() == len(s.edges) and s.by_group.count() == 2 * len(s.edges)
    assert s.counts.where("family = 0").agg(F.sum("n")).first()[0] == 400
    none = workflow.stability(rows, ["id"], Config(tabu_tenure=0), replicates=2, least_prob=1.1, names=list("ad"))
    assert none.edges == [] and none.importance is None


def test_evaluation_record(spark, rows, tmp_path):
    vs = Variables(tuple("abc"), (2, 2, 2))
    net = evaluation.fit(rows, [(0, 2), (1, 2)], vs)
    r = workflow.evaluation_record(spark, 3, [(0, 2), (1, 2)], [(2, 0), (1, 2)], net, rows, extra={"name": "x"}).first()
    assert (r.name, r.shd, r.tp, r.true_is_dag, r.sid_max) == ("x", 1, 1, 1, 6) and r.sid > 0 and r.kl >= 0
    assert r.kl == pytest.approx(evaluation.kl_divergence(spark, net, evaluation.fit(rows, [(2, 0), (1, 2)], vs)).first().kl, abs=1e-9)
    same = workflow.evaluation_record(spark, 3, [(0, 2)], [(0, 2)])
    assert (same.first().sid, same.first().kl) == (0, None)
    workflow.append_record(same, str(tmp_path / "bench"))
    workflow.append_record(same, str(tmp_path / "bench"))
    assert spark.read.parquet(str(tmp_path / "bench")).count() == 2
    assert workflow.evaluation_record(spark, 3, [(0, 1), (1, 0)], []).first().sid is None


def test_sweep_and_tables(spark, rows):
    got = workflow.sweep(spark, {"toy": rows}, Config(tabu_tenure=0), truth={"toy": [(0, 2), (1, 2)]}, names=list("abc"), score=["bic", "bdeu"]).collect()
    assert [r.setting for r in got] == ["score=bic", "score=bdeu"] and all(r.n_edges >= 2 and r.shd is not None for r in got)
    assert workflow.loglik_of(rows, {"learned": [(0, 2)], "empty": []}, Variables(tuple("abc"), (2, 2, 2))).count() == 2
    assert workflow.iterations(50) == 2000 and workflow.iterations(5000) == 50000
    c = spark.createDataFrame([("b", 5, True), ("a", 9, True), ("x/1", 1, False)], "path string, n_edges long, has_importance boolean")
    assert workflow.default_network(c).first().path == "b" and workflow.default_network(c, "x/").first().path == "x/1"
    assert [r[0] for r in spark.createDataFrame([("b",), ("10",), ("9",)], "x string").orderBy(*workflow.mixed_order("x")).collect()] == ["9", "10", "b"]
    assert np.isfinite(workflow.dataset_info(spark, {"toy": (rows, [(0, 1)])}).first().n_samples)
