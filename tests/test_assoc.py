"""Pair tables summed in two steps, and candidates chosen where they are added."""

import numpy as np
import pandas as pd
import pytest

from arbora.operators import assoc
from arbora.operators.counts import Variables, pack


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    n, d = 900, 30
    x = np.zeros((n, d), np.int32)
    for i in range(d):
        noise = rng.integers(0, 3, n)
        x[:, i] = noise if i % 5 == 0 else np.where(rng.random(n) < 0.5, noise, x[:, i - 1])
    names = [f"g{i}" for i in range(d)]
    return spark.createDataFrame(pd.DataFrame(x, columns=names)), Variables(tuple(names), (3,) * d), x


def shuffled(df):
    """Bytes that the plan's exchanges wrote, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, total = [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("dataSize").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_shuffle_does_not_grow_with_input_partitions(spark, wide):
    df, vs, _ = wide
    few, many = (assoc.associations(pack(df.repartition(p), vs), vs) for p in (8, 160))
    a, b = shuffled(few), shuffled(many)
    # repartition() itself deals the rows, which are the same; the tables of all tasks are what is beyond.
    base = {p: shuffled(df.repartition(p).select("g0", *vs.names[1:])) for p in (8, 160)}
    assert (b - base[160]) <= 1.3 * (a - base[8])


@pytest.mark.parametrize(("metric", "k", "least", "p"), [("mi", 4, 0.0, 1.0), ("mi", 2, 0.05, 1.0), ("chi2", 3, 0.0, 0.2), ("mi", 0, 0.01, 1.0)])
def test_candidates_in_the_tasks(spark, wide, monkeypatch, metric, k, least, p):
    df, vs, _ = wide
    want = {(r.v, r.u): r.strength for r in assoc.candidates(assoc.associations(df, vs), metric, k, least, p).collect()}
    for held in (1 << 20, 16):
        monkeypatch.setattr(assoc, "HEAP", held)
        got = {(r.v, r.u): r.strength for r in assoc.top_candidates(df, vs, metric, k, least, p).collect()}
        assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e], abs=1e-9) for e in want)


def test_a_task_sends_each_nodes_strongest_only(monkeypatch):
    monkeypatch.setattr(assoc, "HEAP", 64)
    best, rng = assoc.Strongest(3), np.random.Generator(np.random.PCG64(1))
    every = []
    for _ in range(40):
        v, u, s = rng.integers(0, 10, 50), rng.integers(0, 1000, 50), rng.integers(0, 20, 50).astype(float)
        best.add(v, u, s)
        every += list(zip(v.tolist(), u.tolist(), s.tolist(), strict=True))
        assert best.held <= best.bound + 50
    v, u, s = best.cut()
    assert len(v) <= 30
    for node in range(10):
        own = sorted(((-x[2], x[1]) for x in every if x[0] == node))[:3]
        assert sorted((-c, b) for a, b, c in zip(v.tolist(), u.tolist(), s.tolist(), strict=True) if a == node) == own


def test_stripes_and_widths(spark, wide, monkeypatch):
    df, vs, x = wide
    whole = {(r.u, r.v): r.mi for r in assoc.associations(df, vs).collect()}
    monkeypatch.setattr(assoc, "STRIPE_BYTES", 20_000)
    striped = {(r.u, r.v): r.mi for r in assoc.associations(df, vs).collect()}
    assert whole.keys() == striped.keys() and all(striped[e] == pytest.approx(whole[e], abs=1e-12) for e in whole)
    counts = {(r.a, r.b): r.n for r in assoc.pair_counts(df, vs).where("u = 0 AND v = 7").collect()}
    assert counts == {(a, b): int(((x[:, 0] == a) & (x[:, 7] == b)).sum()) for a in range(3) for b in range(3)}
