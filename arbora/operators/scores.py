"""Decomposable scores of families, conditional probabilities and log-likelihoods of data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.math import lgamma, lgamma_array

from .counts import Family, Packed, Request, Table, Variables, configurations, family_counts, table_sums


def _shapes(families: Sequence[Family], vs: Variables, what: int) -> Column:
    """A family's number of states (0) or configurations (1), looked up by its place in the list."""
    values = [vs.cards[f[0]] if what == 0 else configurations(f, vs.cards) for f in families]
    return F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), F.col("family") + 1)


def score_counts(counts: DataFrame, families: Sequence[Family], vs: Variables, ess: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """by..., family, v, loglik, bic, k2, bdeu of counts (family, v, j, k, n).

    Natural logarithms; N is the number of rows counted (at least 1); a family has all its configurations, whether seen or
    not; what was not seen adds nothing to K2 and BDeu.
    """
    r, q = _shapes(families, vs, 0), _shapes(families, vs, 1)
    return score_cells(counts.withColumn("r", r).withColumn("q", q), ess, by)


def score_cells(cells: DataFrame, ess: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """score_counts() of counts that bring their families' numbers of states r and of configurations q."""
    keys = [*by, "family", "v"]
    n = F.col("n").cast("double")
    cells = cells.where("n > 0").withColumn("_r", F.col("r").cast("double")).withColumn("_q", F.col("q").cast("double"))
    a_j, a_jk = F.lit(float(ess)) / F.col("_q"), F.lit(float(ess)) / F.col("_q") / F.col("_r")
    rows = cells.groupBy(*keys, "j", "_r", "_q").agg(
        F.sum("n").cast("double").alias("nj"),
        F.sum(n * F.log(n)).alias("s"),
        F.sum(lgamma(n + 1)).alias("g"),
        F.sum(lgamma(n + a_jk) - lgamma(a_jk)).alias("b"),
    )
    rows = rows.groupBy(*keys, "_r", "_q").agg(
        F.sum("nj").alias("N"),
        F.sum(F.col("s") - F.col("nj") * F.log("nj")).alias("loglik"),
        F.sum(F.col("g") + lgamma(F.col("_r")) - lgamma(F.col("nj") + F.col("_r"))).alias("k2"),
        F.sum(F.col("b") + lgamma(a_j) - lgamma(a_j + F.col("nj"))).alias("bdeu"),
    )
    bic = F.col("loglik") - 0.5 * (F.col("_r") - 1) * F.col("_q") * F.log(F.greatest(F.col("N"), F.lit(1.0)))
    return rows.select(*keys, "loglik", bic.alias("bic"), "k2", "bdeu")


SCORED = "family int, loglik double, bic double, k2 double, bdeu double"


def table_scores(n: np.ndarray, q: float, ess: float = 1.0) -> np.ndarray:
    """loglik, bic, k2, bdeu (in the first axis) of tables of counts (..., configurations, states, runs) of q configurations in all; those
    that are not among the tables have no rows and add nothing."""
    n = n.astype(float)
    r = n.shape[-2]
    a = ess / q
    nj = n.sum(-2)
    log_n, log_nj = np.log(np.maximum(n, 1)), np.log(np.maximum(nj, 1))
    loglik = (n * log_n).sum((-3, -2)) - (nj * log_nj).sum(-2)
    k2 = lgamma_array(n + 1).sum((-3, -2)) + (lgamma_array(np.full(1, float(r))) - lgamma_array(nj + r)).sum(-2)
    bdeu = (lgamma_array(n + a / r) - lgamma_array(np.full(1, a / r))).sum((-3, -2)) + (lgamma_array(np.full(1, a)) - lgamma_array(a + nj)).sum(-2)
    bic = loglik - 0.5 * (r - 1) * q * np.log(np.maximum(nj.sum(-2), 1))
    return np.stack([loglik, bic, k2, bdeu])


def grid(table: Table) -> np.ndarray:
    """A table's counts as configurations x states x runs, with only the configurations that occur where the table lists its cells."""
    if table.ids is None:
        return table.n.reshape(table.q, table.r, -1)
    j, back = np.unique(table.ids // table.r, return_inverse=True)
    out = np.zeros((len(j), table.r, table.n.shape[1]), table.n.dtype)
    out[back, table.ids % table.r] = table.n
    return out


def score_requests(data: Packed, requests: Sequence[Request], ess: float = 1.0) -> DataFrame:
    """family (place in requests), loglik, bic, k2, bdeu of any number of families in one job of two stages. What score_cells() says
    in columns is said in numpy here, as a search asks for it so often that planning those columns takes longer than the counting."""

    def emit(tables: list[Table]) -> Iterator[pa.RecordBatch]:
        # Tables of one shape are scored together.
        shapes: dict[tuple, list[Table]] = {}
        for t in tables:
            shapes.setdefault((t.q, t.r, t.n.shape[1]) if t.ids is None else (t.family, -1, 0), []).append(t)
        for some in shapes.values():
            found = table_scores(np.stack([grid(t) for t in some]), float(some[0].q), ess).reshape(4, -1)
            seen = np.concatenate([t.n.sum(0) for t in some]) > 0  # a resample without any row has no scores
            place = np.array([p for t in some for p in t.places], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place[seen]), *[pa.array(x[seen]) for x in found]], [x.split()[0] for x in SCORED.split(", ")])

    return table_sums(data, requests, emit, SCORED)


def score_families(df: DataFrame, families: Sequence[Family], vs: Variables, ess: float = 1.0, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return score_counts(family_counts(df, families, vs, by, weight), families, vs, ess, by)


def dense(counts: DataFrame, families: Sequence[Family], vs: Variables) -> DataFrame:
    """counts with the cells that do not occur, as 0."""
    spark = counts.sparkSession
    shapes = spark.createDataFrame([(i, f[0], configurations(f, vs.cards), vs.cards[f[0]]) for i, f in enumerate(families)], "family int, v int, q long, r int")
    grid = shapes.select("family", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("j"), "r").select("family", "v", "j", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("k"))
    return grid.join(counts.select("family", "j", "k", "n"), ["family", "j", "k"], "left").select("family", "v", "j", "k", F.coalesce("n", F.lit(0)).alias("n"))


def probabilities(counts: DataFrame, families: Sequence[Family], vs: Variables, alpha: float = 0.0, per_cell: bool = False) -> DataFrame:
    """family, v, j, k, prob over all cells.

    alpha in total: (n + alpha / r) / (n_j + alpha); per_cell: (n + alpha) / (n_j + alpha r). A configuration that was not
    seen is uniform if alpha > 0 or per_cell, and else null.
    """
    cells = dense(counts, families, vs).withColumn("nj", F.sum("n").over(Window.partitionBy("family", "j")))
    r = _shapes(families, vs, 0)
    a, t = (F.lit(float(alpha)), alpha * r) if per_cell else (F.lit(float(alpha)) / r, F.lit(float(alpha)))
    p = F.when(F.col("nj") + t > 0, (F.col("n") + a) / (F.col("nj") + t))
    return cells.select("family", "v", "j", "k", (F.coalesce(p, 1.0 / r) if per_cell else p).alias("prob"))


def data_loglik(counts: DataFrame, fitted: DataFrame, families: Sequence[Family], vs: Variables, alpha: float = 0.0) -> DataFrame:
    """One row: total, per_sample, per_sample_variable of data given as counts under fitted counts.

    The data are aggregated before they meet the probabilities. A configuration without fitted rows is uniform if alpha > 0;
    an event of probability 0 makes all three minus infinity.
    """
    model = fitted.withColumn("nj", F.sum("n").over(Window.partitionBy("family", "j"))).select("family", "j", "k", F.col("n").alias("m"), "nj")
    totals = fitted.groupBy("family", "j").agg(F.sum("n").alias("nj"))
    r = _shapes(families, vs, 0)
    rows = counts.select("family", "v", "j", "k", "n").join(model.select("family", "j", "k", "m"), ["family", "j", "k"], "left").join(totals, ["family", "j"], "left")
    m, nj = F.coalesce("m", F.lit(0)), F.coalesce("nj", F.lit(0))
    p = F.when(nj + F.lit(alpha) > 0, (m + F.lit(float(alpha)) / r) / (nj + F.lit(float(alpha)))).otherwise(0.0)
    logp = F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))
    size = F.sum(F.when(F.col("family") == 0, F.col("n")))
    total = F.sum(F.col("n") * logp)
    return rows.agg(total.alias("total"), (total / size).alias("per_sample"), (total / size / len(families)).alias("per_sample_variable"))
