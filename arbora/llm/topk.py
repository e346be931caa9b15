"""Operator 11: exact top-k search by inner product, the kth score found in global histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
SCALE = 64
#: Bins of a histogram; a score's bin is cut into as many again until a bin is one score.
BINS = 1 << 12
#: Bytes of query vectors that are sent to all tasks at once; more queries are taken block by block.
BLOCK_BYTES = 32 << 20
#: Queries and candidates of one matrix product.
TILE = (512, 4096)
#: Entries that a task holds before it adds up its histogram or cuts its ties.
HELD = 1 << 21
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
#: Scores of this size or more raise: differences of smaller ones fit 64 bits.
REACH = 1 << 61
_NO_ID = np.iinfo(np.int64).max


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double; null where the vector is null or has a null or non-finite component."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # From 2**53 on a double is whole by itself, where floor() would stop at 64 bits.
    return F.when(whole, F.transform(x, lambda c: F.when(F.abs(c * scale) < EXACT, F.floor(c * scale).cast("double")).otherwise(c * scale)))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; raises where one reaches REACH."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < EXACT:
        return (q @ c.T).astype(np.int64)
    if bound < REACH:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    out = whole(q) @ whole(c).T
    if max(abs(x) for x in out.flat) >= REACH:
        raise OverflowError("a score reaches 2**61")
    return out.astype(np.int64)


class Queries:
    """A block of queries by dimension: places in the block, row numbers (ascending) and vectors."""

    def __init__(self, rows: list[int], vectors: list[list[float]]):
        sizes = np.array([len(v) for v in vectors])
        self.n = len(rows)
        self.by = {int(d): (np.flatnonzero(sizes == d), np.array([r for r, v in zip(rows, vectors, strict=True) if len(v) == d]), np.array([v for v in vectors if len(v) == d], float).reshape(int((sizes == d).sum()), d)) for d in np.unique(sizes)}


def _tiles(block: Queries, batches: Iterator[pa.RecordBatch]):
    """places of queries, numbers of candidates' ids, scores and whether each counts (not the query's own row), tile by tile."""
    for batch in batches:
        rows, ids, v = batch.column(0).to_numpy(), batch.column(1).fill_null(_NO_ID).to_numpy(), batch.column(2)
        sizes = np.diff(v.offsets.to_numpy())
        flat, at = v.values.to_numpy(), v.offsets.to_numpy()
        for d in np.unique(sizes):
            if int(d) not in block.by:
                continue
            place, own, q = block.by[int(d)]
            which = np.flatnonzero(sizes == d)
            c = flat[at[which][:, None] + np.arange(d)]
            for j in range(0, len(which), TILE[1]):
                some = which[j : j + TILE[1]]
                for i in range(0, len(place), TILE[0]):
                    scores = _products(q[i : i + TILE[0]], c[j : j + TILE[1]])
                    counts = None
                    mine = own[i : i + TILE[0]]
                    hit = np.searchsorted(mine, rows[some])
                    found = np.flatnonzero((hit < len(mine)) & (mine[np.minimum(hit, len(mine) - 1)] == rows[some]))
                    if len(found):
                        counts = np.ones(scores.shape, bool)
                        counts[hit[found], found] = False
                    yield place[i : i + TILE[0]], ids[some], scores, counts


class Histogram:
    """Counts of (query, bin) with the lowest bin of each query that the task's own k highest scores leave possible."""

    def __init__(self, low: np.ndarray, high: np.ndarray, width: int, need: np.ndarray):
        self.low, self.high, self.width, self.need = low.copy(), high, width, need
        self.base = low
        self.bins = int(((high - low) // width).max(initial=0)) + 1
        self.key, self.count, self.parts, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, place, scores, counts) -> None:
        inside = (scores >= self.low[place][:, None]) & (scores < self.high[place][:, None])
        if counts is not None:
            inside &= counts
        a, b = np.nonzero(inside)
        if len(a):
            own = place[a]
            self.parts.append(own * self.bins + (scores[a, b] - self.base[own]) // self.width)
            self.held += len(a)
            if self.held > HELD:
                self.settle()

    def settle(self) -> None:
        """Adds up what is held; bins below the one in which a query already has all it needs can't hold its kth score."""
        if self.parts:
            new, n = np.unique(np.concatenate(self.parts), return_counts=True)
            key, back = np.unique(np.concatenate([self.key, new]), return_inverse=True)
            count = np.bincount(back, np.concatenate([self.count, n])).astype(np.int64)
            self.parts, self.held = [], 0
            query = key // self.bins
            last = np.append(query[1:] != query[:-1], True)
            upto = np.cumsum(count)
            # Scores in this bin and above it, of the same query.
            above = np.repeat(upto[last], np.diff(np.append(-1, np.flatnonzero(last)))) - upto + count
            enough = above - count >= self.need[query]
            self.key, self.count = key[~enough], count[~enough]
            query = query[~enough]
            first = np.append(True, query[1:] != query[:-1])
            full = above[~enough][first] >= self.need[query[first]]
            lowest = self.base[query[first]] + self.key[first] % self.bins * self.width
            self.low[query[first][full]] = lowest[full]


def _histogram(block: Broadcast, low: Broadcast, high: Broadcast, width: int, need: Broadcast):
    """Task: vectors -> query, bin, n."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Histogram(low.value, high.value, width, need.value)
        for place, _, scores, counts in _tiles(block.value, batches):
            own.add(place, scores, counts)
        own.settle()
        for a in range(0, len(own.key), 1 << 16):
            key = own.key[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((key // own.bins).astype(np.int32)), pa.array(key % own.bins), pa.array(own.count[a : a + (1 << 16)])], ["query", "bin", "n"])

    return task


def _winners(block: Broadcast, kth: Broadcast, need: Broadcast):
    """Task: vectors -> query, id, score: what lies above the kth score and, of what equals it, the smallest ids that can count."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kth_, need_ = kth.value, need.value
        ties: list = [[], []]

        def cut() -> None:
            query, ids = np.concatenate([np.zeros(0, np.int64), *ties[0]]), np.concatenate([np.zeros(0, np.int64), *ties[1]])
            order = np.lexsort((ids, query))
            query, ids = query[order], ids[order]
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
            nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
            kept = nth < need_[query]
            ties[:] = [[query[kept]], [ids[kept]]]

        def rows(query, ids, scores) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["query", "id", "score"])

        held = 0
        for place, ids, scores, counts in _tiles(block.value, batches):
            high = scores >= kth_[place][:, None]
            if counts is not None:
                high &= counts
            a, b = np.nonzero(high)
            more = scores[a, b] > kth_[place[a]]
            if more.any():
                yield rows(place[a[more]], ids[b[more]], scores[a[more], b[more]])
            ties[0].append(place[a[~more]])
            ties[1].append(ids[b[~more]])
            held += len(a)
            if held > HELD:
                cut()
                held = len(ties[0][0])
        cut()
        yield rows(ties[0][0], ties[1][0], kth_[ties[0][0]])

    return task


def _kth(histogram: DataFrame, need: DataFrame) -> list:
    """query, bin, above, n: the bin, counted from the top, in which a query's need is met, and how many scores lie in bins above it."""
    w = Window.partitionBy("query").orderBy(F.col("bin").desc())
    upto = histogram.groupBy("query", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w)).join(F.broadcast(need), "query")  # a row for each query of a block
    return upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("query", "bin", (F.col("upto") - F.col("n")).alias("above")).collect()


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, bins: int = BINS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that queries holds for, the k other rows of the highest scores (all, if fewer).

    A score is the integer inner product of floor(scale * x); ties go to the smaller id (nulls last). Every query meets every row
    but its own, in blocks of queries of at most block_bytes that are broadcast: each scan scores everything and adds a histogram of
    each query's scores, in which the bin of the kth score is cut into finer bins by the next scan, until a bin is one score. A last scan
    returns what lies above the kth score, and of what equals it as many of the smallest ids as are wanted; nothing else leaves a task,
    whatever number of rows ties. Scores are never stored.

    Rows without a vector, or with a null or non-finite component, take no part; vectors of different lengths have no score. Repeated rows and ids
    are rows of their own: a query's own row is told by its number, not by its id. A null id is never a query where queries is null for it. A score of 2**61 or more raises.
    An empty table gives an empty one. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    held = vectors.select(F.monotonically_increasing_id().alias("row"), quote(vec_id).cast("long").alias("id"), quantised(quote(vector), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    held = stored(held.where("v IS NOT NULL"), "topk-vectors")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    asked = held.where("asked").select("row", "id", "v", size.alias("size"))
    limits = held.agg(F.max(size).alias("all")).first()
    longest = limits["all"] or 0.0
    # Numbers of queries for blocks of bounded bytes: counted for each stored partition, so that nothing is sorted in one task.
    per = asked.groupBy(F.shiftright("row", 33).alias("p")).agg(F.count("*").alias("n"), F.sum(F.size("v") * 8 + 64).alias("bytes")).orderBy("p").collect()
    out = None
    for first, last, nth, of in _blocks(per, block_bytes):
        some = asked.where((F.shiftright("row", 33) >= first) & (F.shiftright("row", 33) <= last) & (F.pmod(F.xxhash64("row"), F.lit(of)) == nth))
        found = _block(spark, held, some, k, longest, bins)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _blocks(per: list, limit: int) -> list[tuple[int, int, int, int]]:
    """Ranges of partitions whose queries fit into limit bytes; a partition that doesn't fit is dealt by hash into equal parts: first, last, part, of."""
    out, first, last, size = [], None, None, 0
    for r in per:
        if r.bytes > limit:
            n = -(-2 * r.bytes // limit)
            out += [(r.p, r.p, i, n) for i in range(n)]
            continue
        if first is not None and size + r.bytes > limit:
            out.append((first, last, 0, 1))
            first, size = None, 0
        first, last, size = (r.p if first is None else first), r.p, size + r.bytes
    return [*out, (first, last, 0, 1)] if first is not None else out


def _block(spark, held: DataFrame, asked: DataFrame, k: int, longest: float, bins: int) -> DataFrame:
    rows = asked.orderBy("row").collect()  # at most block_bytes
    block = Queries([r.row for r in rows], [r.v for r in rows])
    n = block.n
    sent = spark.sparkContext.broadcast(block)
    data = held.select("row", "id", "v")
    # Cauchy and Schwarz: no score lies beyond the product of the lengths (with room for their rounding).
    reach = np.array([int(min(r.size * longest * (1 + 1e-9) + 1, float(REACH))) for r in rows], np.int64)
    low, high, need = -reach, reach + 1, np.full(n, k, np.int64)
    width = 1
    while n and int((high - low).max()) > width * bins:
        width *= bins
    few = np.zeros(n, bool)
    while n:
        given = [spark.sparkContext.broadcast(x) for x in (low, high, need)]
        counted = data.mapInArrow(_histogram(sent, given[0], given[1], width, given[2]), "query int, bin long, n long")
        found = _kth(counted, spark.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "query int, need long"))
        known = np.zeros(n, bool)
        for r in found:
            known[r.query] = True
            start = int(low[r.query]) + r.bin * width
            low[r.query], high[r.query] = start, min(start + width, int(high[r.query]))
            need[r.query] -= r.above
        # Fewer rows than k: all of them are wanted.
        few |= ~known
        low[few], high[few] = np.iinfo(np.int64).min, np.iinfo(np.int64).min
        if width == 1:
            break
        width = max(1, width // bins)
    kth, wanted = (spark.sparkContext.broadcast(x) for x in (low, need))
    best = data.mapInArrow(_winners(sent, kth, wanted), "query int, id long, score long")
    names = spark.createDataFrame([(i, r.id) for i, r in enumerate(rows)], "query int, query_id long")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(F.broadcast(names), "query")  # a row for each query of a block
    return stored(best.select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "topk-found")
