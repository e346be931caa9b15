"""Pairwise association of variables and the candidate parents it gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.math import chi2_tail, tail

from .counts import WIDTHS, Packed, Variables, chunks, narrow, pack

_TINY = 1e-300
#: Bytes of the tables that a task sums at once; more columns are taken in stripes, each a scan of the columns from its first on.
STRIPE_BYTES = 256 << 20
#: Rows and columns of one matrix product.
ROWS, COLUMNS = 1024, 128
#: Pairs that a task holds before it keeps only each node's strongest.
HEAP = 1 << 20
CELLS = "u int, v int, a int, b int, n long"
TABLE = "u int, v int, mi double, chi2 double, df int"


def sample_rows(df: DataFrame, key: Sequence[Column], rows: int, seed: int = 2025) -> DataFrame:
    """About-the-first rows in the order of a keyed hash of each row's key: the same ones in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), F.xxhash64(F.lit(seed + 1), *key)).limit(rows)


def pair_mask(n: int, budget: int, seed: int = 2025) -> np.ndarray | None:
    """Which pairs u < v a budget leaves: at most so many partners drawn for each v. None: all."""
    if not 0 < budget < n - 1:
        return None
    out = np.zeros((n, n), bool)
    for v in range(n):
        u = np.random.Generator(np.random.PCG64([seed, v])).choice(n - 1, budget, replace=False)
        u += u >= v
        out[np.minimum(u, v), np.maximum(u, v)] = True
    return out


def _stripes(cards: Sequence[int]) -> list[tuple[int, int]]:
    """Ranges of variables whose tables with all later ones fit into STRIPE_BYTES."""
    out, first, size = [], 0, 0
    for u, r in enumerate(cards):
        own = r * sum(cards[u:]) * 8
        if size and size + own > STRIPE_BYTES:
            out.append((first, u))
            first, size = u, 0
        size += own
    return [*out, (first, len(cards))]


def _summed(cards: Sequence[int], first: int, last: int, all_cards: Sequence[int]):
    """Variables from a stripe's first on -> u (counted from that one), cells: states of u x states of the variables from u on.

    Rows become one-hot vectors, and the tables of all pairs are products of blocks of their matrix; sums are exact.
    """
    offset = np.concatenate([[0], np.cumsum(cards)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] = []
        blocks = [(a, min(a + COLUMNS, last)) for a in range(0, last, COLUMNS)]
        for held in chunks(batches, all_cards):
            states = np.stack([held[first + x] for x in range(len(cards))], 1).astype(np.int64)
            for i in range(0, len(states), ROWS):
                some = states[i : i + ROWS]
                hot = np.zeros((len(some), offset[-1]), np.float32)
                hot[np.arange(len(some))[:, None], some + offset[:-1]] = 1
                products = [hot[:, offset[a] : offset[b]].T @ hot[:, offset[a] :] for a, b in blocks]
                if not total:
                    total = [p.astype(np.float64) for p in products]
                else:
                    for t, p in zip(total, products, strict=True):
                        t += p
        for (a, b), t in zip(blocks, total, strict=False):
            for u in range(a, b):
                own = narrow(t[offset[u] - offset[a] : offset[u + 1] - offset[a], offset[u] - offset[a] :])
                yield pa.RecordBatch.from_arrays([pa.array([u], pa.int32()), pa.array([own.dtype.itemsize], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["u", "width", "cells"])

    return task


def _pairs(df: DataFrame | Packed, vs: Variables, mask: np.ndarray | None, begin: Callable, schema: str) -> DataFrame:
    """emit(u, table, offsets of the columns from u on, those that the mask leaves) for each variable, over tables summed for the whole of df,
    and at the end of a task end(); begin() gives a task both.

    Tables are added in two steps. Input partitions are first gathered into as many tasks as the cluster runs at a time, where Spark prefers those
    of one machine; each sums all that it reads and sends one table a variable, in bytes where they hold its counts, to where the
    variable's tables are added. So what is shuffled doesn't grow with the number of input partitions.
    """
    cards = [int(c) for c in vs.cards]
    parts = []
    data = df if isinstance(df, Packed) else pack(df, vs)
    for first, last in _stripes(cards):
        rows = data.rows.where((F.col("var") >= first) & (F.col("var") < len(cards))).coalesce(max(1, data.rows.sparkSession.sparkContext.defaultParallelism))
        parts.append(rows.mapInArrow(_summed(cards[first:], first, last - first, cards), "u int, width int, cells binary").withColumn("u", F.col("u") + first))
    tables = reduce(DataFrame.unionByName, parts)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, end = begin()

        def done() -> Iterator[pa.RecordBatch]:
            offset = np.concatenate([[0], np.cumsum(cards[u:])])
            kept = np.arange(u + 1, len(cards))
            if mask is not None:
                kept = kept[mask[u, u + 1 :]]
            if len(kept):
                yield from emit(u, total.reshape(cards[u], -1), offset, kept)

        u, total = -1, np.zeros(0, np.int64)
        for batch in batches:
            for x, width, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(cells.as_buffer(), WIDTHS[width])
                if x != u:
                    if u >= 0:
                        yield from done()
                    u, total = x, own.astype(np.int64)
                else:
                    total += own
        if u >= 0:
            yield from done()
        yield from end()

    return tables.repartition("u").sortWithinPartitions("u").mapInArrow(added, schema)


def pair_counts(df: DataFrame | Packed, vs: Variables, budget: int = 0, seed: int = 2025) -> DataFrame:
    """u, v, a, b, n of the cells that occur, for all pairs u < v (or those of a budget) in one scan."""

    def emit(u, total, offset, kept):
        for v in kept:
            own = total[:, offset[v - u] : offset[v - u + 1]]
            a, b = np.nonzero(own)
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x, np.int32)) for x in (u, v)] + [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(own[a, b])], ["u", "v", "a", "b", "n"])

    return _pairs(df, vs, pair_mask(len(vs.names), budget, seed), lambda: (emit, tuple), CELLS)


def _associated(cards: np.ndarray, u: int, total: np.ndarray, offset: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mutual information (nats), chi-square and degrees of freedom of u and each of the variables kept, from their summed tables."""
    n = total.sum(dtype=np.float64) / max(1, len(offset) - 1)
    na = total[:, : offset[1]].sum(1, dtype=np.float64)[:, None]
    nb = total.sum(0, dtype=np.float64)[None]
    seen = total > 0
    p = total / n
    with np.errstate(divide="ignore", invalid="ignore"):
        mi = np.where(seen, p * np.log((p + _TINY) / (na / n * nb / n + _TINY)), 0.0).sum(0)
        square = np.where(seen, total.astype(np.float64) ** 2 / (na * nb), 0.0).sum(0)
    mi, square = (np.add.reduceat(x, offset[:-1])[kept - u] for x in (mi, square))
    free = (cards[u] - 1) * (cards[kept] - 1)
    # Cells that do not occur add their expectation; the identity sums them without listing them.
    return mi, np.where(free > 0, np.maximum(n * (square - 1), 0.0), 0.0), free


def associations(df: DataFrame | Packed, vs: Variables, budget: int = 0, seed: int = 2025) -> DataFrame:
    """u, v, mi (nats), chi2, df of all pairs u < v (or those of a budget). No degrees of freedom: chi2 0."""
    cards = np.array(vs.cards)

    def emit(u, total, offset, kept):
        mi, chi2, free = _associated(cards, u, total, offset, kept)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(kept), u, np.int32)), pa.array(kept.astype(np.int32)), pa.array(mi), pa.array(chi2), pa.array(free.astype(np.int32))], ["u", "v", "mi", "chi2", "df"]
        )

    return _pairs(df, vs, pair_mask(len(vs.names), budget, seed), lambda: (emit, tuple), TABLE)


class Strongest:
    """The most partners of each node that have the greatest strengths (ties: the smaller partner), of all pairs added so far."""

    def __init__(self, most: int):
        self.most, self.parts, self.held, self.bound = most, [], 0, HEAP

    def add(self, v: np.ndarray, u: np.ndarray, strength: np.ndarray) -> None:
        self.parts.append((v, u, strength))
        self.held += len(v)
        if self.held > self.bound:
            self.cut()
            self.bound = max(HEAP, 2 * self.held)

    def cut(self) -> tuple[np.ndarray, ...]:
        v, u, strength = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((u, -strength, v))
        v, u, strength = v[order], u[order], strength[order]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
        nth = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
        kept = nth < self.most
        self.parts = [(v[kept], u[kept], strength[kept])]
        self.held = int(kept.sum())
        return self.parts[0]


def top_candidates(df: DataFrame | Packed, vs: Variables, metric: str = "mi", top_k: int = 50, mi_threshold: float = 0.0, p_threshold: float = 1.0, budget: int = 0, seed: int = 2025) -> DataFrame:
    """candidates() of associations(), with each node's top_k partners chosen where the pairs' tables are added: a task sends at most top_k
    rows for each node, and these are merged once."""
    if metric not in ("mi", "chi2"):
        raise ValueError("metric is mi or chi2")
    cards = np.array(vs.cards)
    names = ["v", "u", "strength"]

    def begin():
        best = Strongest(top_k if top_k > 0 else len(cards))

        def emit(u, total, offset, kept):
            mi, chi2, free = _associated(cards, u, total, offset, kept)
            if metric == "mi":
                ok, strength = mi >= mi_threshold, mi
            else:
                p = tail(chi2, free.astype(float))
                ok, strength = p <= p_threshold, -np.log(np.maximum(p, _TINY))
            v, strength = kept[ok], strength[ok]
            best.add(np.concatenate([v, np.full(len(v), u)]), np.concatenate([np.full(len(v), u), v]), np.concatenate([strength, strength]))
            yield from ()

        def end():
            v, u, strength = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(u.astype(np.int32)), pa.array(strength)], names)

        return emit, end

    found = _pairs(df, vs, pair_mask(len(vs.names), budget, seed), begin, "v int, u int, strength double")
    if top_k <= 0:
        return found
    w = Window.partitionBy("v").orderBy(F.col("strength").desc(), "u")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k).drop("_n")


def with_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p", chi2_tail(F.col("chi2").cast("double"), F.col("df").cast("double")))


def candidates(table: DataFrame, metric: str = "mi", top_k: int = 50, mi_threshold: float = 0.0, p_threshold: float = 1.0) -> DataFrame:
    """v, u, strength: for each v its top_k partners (0: all) past the threshold; ties go to the smaller u."""
    if metric not in ("mi", "chi2"):
        raise ValueError("metric is mi or chi2")
    if metric == "mi":
        scored = table.where(F.col("mi") >= mi_threshold).withColumn("strength", F.col("mi"))
    else:
        scored = with_p(table).where(F.col("p") <= p_threshold).withColumn("strength", -F.log(F.greatest("p", F.lit(_TINY))))
    both = scored.select("v", "u", "strength").unionByName(scored.select(F.col("u").alias("v"), F.col("v").alias("u"), "strength"))
    if top_k <= 0:
        return both
    w = Window.partitionBy("v").orderBy(F.col("strength").desc(), "u")
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k).drop("_n")
