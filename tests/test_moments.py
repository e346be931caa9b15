"""One-pass moments against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.operators import moments as M
from arbora.operators.counts import variables


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(3)
    n, d = 400, 300
    x = rng.normal(1e6, 1, (n, d))
    x[:, 0] = 7
    x[:, 1] = rng.integers(0, 3, n)
    x[:, 2] = np.nan
    x[rng.random((n, d)) < 0.05] = np.nan
    x[5, 3], x[6, 3] = np.inf, -np.inf
    x[:, 4] = np.where(rng.random(n) < 0.5, 0.0, -0.0)
    x[:, 10] = x[:, 11] = x[:, 12]
    names = [f"g{i}" for i in range(d - 1)] + ["a.b"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(7)
    got = {r.column: r for r in M.column_stats(df, names).collect()}
    assert len(got) == d
    for i, c in enumerate(names):
        v = x[:, i][np.isfinite(x[:, i])]
        r = got[c]
        assert (r.n, r.n_missing, r.n_nonzero) == (len(v), n - len(v), np.count_nonzero(v))
        if len(v):
            assert (r.mean, r.minimum, r.maximum) == pytest.approx((v.mean(), v.min(), v.max()), rel=1e-12)
            assert r.variance == pytest.approx(v.var(), rel=1e-9, abs=1e-12) and r.n_levels == len(np.unique(v)) and r.is_integer == bool((v == np.rint(v)).all())
        else:
            assert r.mean is None and r.variance is None and r.n_levels == 0
    assert M.duplicate_columns(M.column_stats(df, names)).first().columns == ["g10", "g11", "g12"]
    # Digests don't depend on the order of rows; a column that only has the same values elsewhere is another one.
    again = {r.column: r.digest for r in M.column_stats(df.orderBy("g7").repartition(3), names).collect()}
    assert again == {c: r.digest for c, r in got.items()}
    shuffled = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2, 3], "b": [2.0, 1, 3], "c": [1.0, 2, 3]}))
    assert [r.columns for r in M.duplicate_columns(M.column_stats(shuffled)).collect()] == [["a", "c"]]


def test_many_levels_are_estimated(spark):
    df = spark.range(0, 60_000, 1, 4).select(F.col("id").cast("double").alias("a"), (F.col("id") % 1000).alias("b"), (F.col("id") % 2000).alias("c"))
    got = {r.column: r.n_levels for r in M.column_stats(df).collect()}
    assert abs(got["a"] - 60_000) < 0.15 * 60_000 and got["b"] == 1000 and abs(got["c"] - 2000) < 300


def test_wide_tables_take_one_map_and_one_reduce_step(spark):
    names = [f"c{i}" for i in range(600)]
    df = spark.range(0, 200, 1, 4).select(*[(F.col("id") * (i % 7) % 5).alias(c) for i, c in enumerate(names)])
    stats = M.column_stats(df, names)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and stats.count() == 600
    assert variables(df, names).cards == tuple(5 if i % 7 % 5 else 1 for i in range(600))


def test_extremes(spark):
    df = spark.createDataFrame([(1, None), (-3, 4), (2, None)], "a int, `b.c` long")
    assert M.extremes(df, ["a", "b.c"]) == [(-3, 2, 0), (4, 4, 2)]
    assert M.extremes(df.limit(0), ["a"]) == [(None, None, 0)]


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, ""), (1, "x")], "a int, b string")
    assert {tuple(r) for r in M.duplicate_rows(df, ["a", "b"]).collect()} == {(3, 1, 3), (1, 2, 2)}
