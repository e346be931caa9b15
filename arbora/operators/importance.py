"""What each edge of a network is worth, overall and in groups of samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.scratch import fresh, stored

from .counts import COMPACT, Table, Variables, families_of, pack, table_sums
from .scores import table_scores

WORTH = "g int, u int, v int, d_loglik double, d_bic double, d_k2 double, d_bdeu double, mean_dlogl double, std_dlogl double, n_finite long"


def _worth(n: np.ndarray, q: int, card: int, alpha: float, ess: float) -> tuple[np.ndarray, ...]:
    """Of counts (the other parents' configurations, the parent's states, the child's, groups) what the parent is worth in each group: the four differences of scores, then mean and deviation of the differences of log-probabilities, and how many are finite."""
    r, groups = n.shape[-2], n.shape[-1]
    less = n.sum(1)  # the family without the parent, from its counts alone
    deltas = table_scores(less.reshape(-1, r, groups), q / card, ess) - table_scores(n.reshape(-1, r, groups), float(q), ess)
    n, less = n.astype(float), less[:, None].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.log((less + alpha / r) / (less.sum(-2, keepdims=True) + alpha)) - np.log((n + alpha / r) / (n.sum(-2, keepdims=True) + alpha))
    w = np.where(np.isfinite(d), n, 0.0).reshape(-1, groups)
    d = np.where(w > 0, np.where(np.isfinite(d), d, 0.0).reshape(-1, groups), 0.0)
    total = w.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = (w * d).sum(0) / total
        spread = np.where(total > 1, np.sqrt((w * (d - mean) ** 2).sum(0) / (total - 1)), 0.0)
    return (*deltas, np.where(total > 0, mean, np.nan), np.where(total > 0, spread, np.nan), total.astype(np.int64))


def edge_importance(df: DataFrame, edges: Sequence[tuple[int, int]], vs: Variables, alpha: float = 0.0, ess: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """by..., u, v, d_loglik, d_bic, d_k2, d_bdeu, mean_dlogl, std_dlogl, n_finite.

    Each delta is the child's score without the edge less that with it, on these data; the per-sample mean and standard
    deviation (n - 1; 0 for one sample) are of the smoothed log-probabilities, over samples where they are finite. Packed columns are
    counted in one scan, a family for each child, with the group as one more variable; the families without each parent are
    marginals of that table, taken where it is added up. Of few possible rows only the different ones of each group and their numbers are
    kept, from one pass over df. Groups, as many as the samples' labels, are listed first and sent to all tasks, so that rows don't meet by group.
    """
    edges = sorted(set(edges))
    spark = df.sparkSession
    families = [f for f in families_of(edges, len(vs.names)) if f[1]]
    if not families:
        return spark.createDataFrame([], T.StructType([*df.select(*by).schema, *T.StructType.fromDDL(WORTH)[1:]]))
    code, weight = fresh([*df.columns, *by], "g", "rows")
    if np.prod([float(c) for c in vs.cards]) <= COMPACT:
        df = stored(df.groupBy(*by, *vs.names).agg(F.count("*").alias(weight)), "importance")
    else:
        weight = None
    count = [weight] if weight else []
    groups = df.select(*by).distinct().orderBy(*by).collect() if by else [()]
    names = [f"{code}_{i}" for i in range(len(by))]
    if by:
        fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.select(*by).schema, strict=True)]
        labels = spark.createDataFrame([(i, *r) for i, r in enumerate(groups)], T.StructType([T.StructField(code, T.IntegerType()), *fields]))
        same = [F.col(b).eqNullSafe(F.col(n)) for b, n in zip(by, names, strict=True)]
        labels = F.broadcast(labels)  # a row for each group
        rows = df.select(*by, *vs.names, *count).join(labels, same).select(*vs.names, code, *count)
    else:
        rows = df.select(*vs.names, *count).withColumn(code, F.lit(0))
    wide = Variables((*vs.names, code), (*vs.cards, max(1, len(groups))))
    d = len(vs.names)
    cards, m = vs.cards, wide.cards[-1]

    def emit(tables: list[Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            v, ps = t.family[0], t.family[1][:-1]  # the group is the last parent, the lowest digit of j
            cell = np.flatnonzero(t.n[:, 0]) if t.ids is None else t.ids
            n = t.n[:, 0][cell] if t.ids is None else t.n[:, 0]
            j, k = cell // t.r, cell % t.r
            g, j = j % m, j // m
            seen, own_g = np.unique(g, return_inverse=True)
            q = t.q // m
            for at, u in enumerate(ps):
                step = int(np.prod([cards[p] for p in ps[at + 1 :]], dtype=np.int64))
                rest, back = np.unique(j // (step * cards[u]) * step + j % step, return_inverse=True)
                table = np.zeros((len(rest), cards[u], t.r, len(seen)), np.int64)
                table[back, j // step % cards[u], k, own_g] = n
                found = _worth(table, q, cards[u], alpha, ess)
                columns = [pa.array(seen.astype(np.int32)), *[pa.array(np.full(len(seen), x, np.int32)) for x in (u, v)], *map(pa.array, found)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in WORTH.split(", ")])

    found = table_sums(pack(rows, wide, weight), [(None, (v, (*ps, d))) for v, ps in families], emit, WORTH)
    if by:
        found = found.withColumnRenamed("g", code).join(labels, code)
    labelled = [F.col(n).alias(b) for n, b in zip(names, by, strict=True)]
    value = F.when(~F.isnan("mean_dlogl"), F.col("mean_dlogl")).alias("mean_dlogl"), F.when(~F.isnan("std_dlogl"), F.col("std_dlogl")).alias("std_dlogl")
    return found.select(*labelled, "u", "v", "d_loglik", "d_bic", "d_k2", "d_bdeu", *value, "n_finite")
