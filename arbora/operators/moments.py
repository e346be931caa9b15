"""Moments, levels and digests of the columns of wide matrices, in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values of a column that are counted exactly; beyond, the smallest hashes of so many tell their number.
LEVELS = 1 << 10
#: Columns that a task holds as numbers at once.
STRIPE = 256
PARTS = "place int, n long, missing long, nonzero long, fractional long, mean double, m2 double, least double, most double, levels binary, digest long"
STATS = "place int, n long, n_missing long, n_nonzero long, mean double, variance double, minimum double, maximum double, is_integer boolean, n_levels long, digest long"
_NAMES = [x.split()[0] for x in PARTS.split(", ")]


def hashed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of doubles; all that compare equal have one, and so do all that are no numbers."""
    h = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)  # -0 becomes 0
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift)) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(factor)
    return h


class Part:
    """What is known of some rows of a column: it can be added to that of others, in any order."""

    def __init__(self) -> None:
        self.n = self.missing = self.nonzero = self.fractional = self.digest = 0
        self.mean = self.m2 = 0.0
        self.least, self.most, self.levels = np.inf, -np.inf, np.zeros(0, np.uint64)

    def add(self, n, missing, nonzero, fractional, mean, m2, least, most, levels, digest) -> None:
        self.missing, self.digest = self.missing + missing, (self.digest + digest) % (1 << 64)
        if n:
            d, total = mean - self.mean, self.n + n
            self.mean += d * n / total
            self.m2 += m2 + d * d * self.n * n / total
            self.n, self.nonzero, self.fractional = total, self.nonzero + nonzero, self.fractional + fractional
            self.least, self.most = min(self.least, least), max(self.most, most)
            self.levels = np.unique(np.concatenate([self.levels, levels]))[:LEVELS]

    def count(self) -> int:
        """Distinct values: as many as there are, or an estimate by the largest of the smallest hashes."""
        if len(self.levels) < LEVELS:
            return len(self.levels)
        return round((LEVELS - 1) / ((float(self.levels[-1]) + 1) / 2.0**64))


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >= 1 << 63 else x


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n, n_missing, n_nonzero, mean, variance (of the population), minimum, maximum, is_integer, n_levels, digest of numeric columns.

    Missing are nulls, NaN and infinities; n counts the others, and the figures are of these (null if there are none). n_levels is exact up to LEVELS
    - 1 distinct values and an estimate beyond. digest: a sum over rows of hashes of the row's other values and the column's own, so
    columns of equal digests are equal in every row whatever the order of rows, and others differ in all likelihood. Each task
    keeps one mergeable record a column, and those are what is shuffled: the plan has one map and one reduce step however many columns there are.
    """
    columns = list(columns or df.columns)
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    rows = df.select(*[F.col(q).cast("double").alias(f"c{i}") for i, q in enumerate(quoted)])

    def numbers(batch: pa.RecordBatch, a: int) -> np.ndarray:
        return np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[a : a + STRIPE]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part() for _ in columns]
        for batch in batches:
            # The hash of a whole row tells rows apart in any order; a cell's part in its column's digest depends on it.
            key = np.zeros(batch.num_rows, np.uint64)
            for a in range(0, len(columns), STRIPE):
                place = hashed(np.arange(a, min(a + STRIPE, len(columns)), dtype=float))
                key += ((hashed(numbers(batch, a)) ^ place[:, None]) * np.uint64(0x9E3779B97F4A7C15)).sum(0, dtype=np.uint64)
            for a in range(0, len(columns), STRIPE):
                x = numbers(batch, a)
                ok = np.isfinite(x)
                n = ok.sum(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    clean = np.where(ok, x, 0.0)
                    mean = clean.sum(1) / n
                    m2 = np.where(ok, (clean - mean[:, None]) ** 2, 0.0).sum(1)
                    digest = ((hashed(x) ^ key[None]) * np.uint64(0xD6E8FEB86659FD93)).sum(1, dtype=np.uint64)
                nonzero, fractional = (clean != 0).sum(1), (clean != np.rint(clean)).sum(1)
                least, most = np.where(ok, x, np.inf).min(1, initial=np.inf), np.where(ok, x, -np.inf).max(1, initial=-np.inf)
                for i in range(len(x)):
                    values = clean[i][ok[i]]
                    levels = np.unique(hashed(values))[:LEVELS]
                    parts[a + i].add(int(n[i]), int(x.shape[1] - n[i]), int(nonzero[i]), int(fractional[i]), float(mean[i]), float(m2[i]), float(least[i]), float(most[i]), levels, int(digest[i]))
        for a in range(0, len(parts), STRIPE):
            some = parts[a : a + STRIPE]
            rows_ = [(a + i, p.n, p.missing, p.nonzero, p.fractional, p.mean, p.m2, p.least, p.most, p.levels.tobytes(), _signed(p.digest)) for i, p in enumerate(some)]
            yield _batch(rows_, PARTS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Part] = {}
        for batch in batches:
            for place, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rest[-2], rest[-1] = np.frombuffer(rest[-2], np.uint64), rest[-1] % (1 << 64)
                known.setdefault(place, Part()).add(*rest)
        out = []
        for place, p in known.items():
            some = p.n > 0
            out.append((place, p.n, p.missing, p.nonzero, p.mean if some else None, p.m2 / p.n if some else None, p.least if some else None, p.most if some else None, p.fractional == 0 if some else None, p.count(), _signed(p.digest)))
        if out:
            yield _batch(out, STATS)

    found = rows.mapInArrow(task, PARTS).repartition("place").mapInArrow(merge, STATS)
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "place int, column string")  # a row for each column
    return found.join(F.broadcast(names), "place").select("column", *[x.split()[0] for x in STATS.split(", ")[1:]])


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, _TYPES[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def extremes(df: DataFrame, columns: Sequence[str]) -> list[tuple[int | None, int | None, int]]:
    """Least and greatest value and the number of nulls of integer columns, in their order; one record a column and task is all that is sent."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list = [None] * len(columns)
        most, nulls = list(least), [0] * len(columns)
        for batch in batches:
            for i, c in enumerate(batch.columns):
                nulls[i] += c.null_count
                lo, hi = pc.min_max(c).as_py().values()
                if lo is not None:
                    least[i], most[i] = min(lo, least[i] if least[i] is not None else lo), max(hi, most[i] if most[i] is not None else hi)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(columns), dtype=np.int32)), pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array(nulls, pa.int64())], ["place", "least", "most", "nulls"])

    rows = df.select(*[F.col(q).cast("long").alias(f"c{i}") for i, q in enumerate(quoted)])
    found = rows.mapInArrow(task, "place int, least long, most long, nulls long").groupBy("place").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("nulls").alias("nulls"))
    by = {r.place: (r.least, r.most, r.nulls) for r in found.collect()}
    return [by.get(i, (None, None, 0)) for i in range(len(columns))]


def duplicate_columns(stats: DataFrame) -> DataFrame:
    """columns (two or more, by name), digest: the columns of column_stats() that are equal in every row."""
    return stats.groupBy("digest", "n", "n_missing").agg(F.sort_array(F.collect_list("column")).alias("columns")).where(F.size("columns") > 1).select("columns", "digest")


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """copies, n_contents, n_rows: how many different rows occur so often, by a digest of all their values. What meets is a digest and a number."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    values = F.concat_ws("\u0001", *[F.coalesce(F.col(q).cast("string"), F.lit("\u0000")) for q in quoted])
    copies = df.select(F.sha2(values, 256).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"))
    return copies.groupBy("copies").agg(F.count("*").alias("n_contents"), F.sum("copies").alias("n_rows"))
