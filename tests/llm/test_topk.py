"""Top-k search against all scores in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arbora.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k, asked):
    """(query_id, rank, vec_id, score) of every row that asked holds for."""
    out, ok = [], [(i, r[0], [math.floor(64 * x) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    for i, q, v in ok:
        if q is None or not asked(q):
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), c is None, c or 0, c) for j, c, w in ok if j != i and len(w) == len(v)]
        out += [(q, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()], key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    hot = [0.25] * 8  # a third of all rows: far more ties at the kth score than are wanted
    out = [(i, hot if i % 3 == 0 else [draw.choice([draw.uniform(-1, 1), 0.5, -1e-20]) for _ in range(8)], 1) for i in range(600)]
    out += [(5, hot, 1), (5, hot, 1), (20, out[20][1], 1), (None, [2.0] * 8, 1), (None, hot, 1)]  # repeated rows and ids, no id
    out += [(40, None, 1), (60, [None] * 8, 1), (80, [math.nan] * 8, 1), (100, [math.inf] * 8, 1)]
    return out + [(120, [1.0, -1.0], 1), (140, [0.5, 0.5], 1), (160, [], 1), (180, [], 1)]  # other lengths


@pytest.mark.parametrize(("k", "bins", "block_bytes"), [(20, 4096, 1 << 25), (3, 4, 1 << 25), (7, 16, 700), (1000, 64, 1 << 25)])
def test_search(spark, rows, k, bins, block_bytes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("row", "id", "v", "Asked", "score", "a.b", "query", "rank")})
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=k, bins=bins, block_bytes=block_bytes)
    assert found(got) == brute(rows, k, lambda q: q % 20 == 0)


def test_tasks_cut_ties_and_bins(spark, rows, monkeypatch):
    """A task holds and sends no more than what can win, whatever number of rows ties."""
    import numpy as np

    own = topk.Histogram(np.array([-100]), np.array([101]), 1, np.array([3]))
    for _ in range(50):
        own.add(np.array([0]), np.random.Generator(np.random.PCG64(1)).integers(-100, 101, (1, 1000)), None)
        own.settle()
    assert len(own.key) <= 3 and own.low[0] >= 99


@pytest.mark.parametrize("size", [1e6, 1e7])
def test_large_components(spark, size):
    """Scores that double precision can't hold are exact; those that 64 bits can't hold raise."""
    draw = random.Random(3)
    data = [(i, [size * draw.uniform(-1, 1) for _ in range(6)], 1) for i in range(60)]
    got = topk.search(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, k=5)
    assert found(got) == brute(data, 5, lambda q: q % 20 == 0)
    with pytest.raises(Exception, match="2\\*\\*61"):
        topk.search(spark.createDataFrame([(i, [1e15] * 6, 1) for i in range(30)], SCHEMA), F.col("vec_id") % 20 == 0)


def test_few_and_none(spark):
    assert topk.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.search(spark.createDataFrame([(20, [1.0], 1)], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    assert found(topk.search(spark.createDataFrame([(20, [1.0], 1), (3, [2.0], 1)], SCHEMA), F.col("vec_id") % 20 == 0)) == [(20, 1, 3, 8192)]
