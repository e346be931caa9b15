"""Shared helpers: scratch tables, flat views of Arrow strings, rolling hashes of words and spans."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.scratch import clear_scratch, fresh, scratch_path, set_aside, shared_dir, stored

__all__ = ["clear_scratch", "fresh", "scratch_path", "set_aside", "shared_dir", "stored"]

#: Bytes of text that one vectorised step handles at once (a longer document is a step of its own).
CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOL = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, bucketed and sorted by key, so that joins on key need not shuffle it; and the table's
    name, by which the caller drops it from the catalogue."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", scratch_path(spark, name)).option("compression", "zstd").bucketBy(parts, key).sortBy(key).saveAsTable(table)
    return spark.table(table), table


#: A key that more than this share of all rows hold is hot. There are at most 1000 such keys, whatever the data.
HOT_SHARE = 0.001


def spread_join(rows: DataFrame, table: DataFrame, key: str, copies: str, values: list[str]) -> DataFrame:
    """rows left-joined to table by a string, binary or non-negative long key (one row for each key that is not null, with the
    number of rows that hold it); values are null where there is none.

    Rows of hot keys never meet in one task: the table's rows of hot keys, at most 1 / HOT_SHARE of them, are broadcast, and
    the rows that they serve get a key of their own for the shuffled join, which then finds nothing.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    return spread(rows, table, key, values, table.where(F.col(copies) > max(1, int(total * HOT_SHARE))))


def spread(rows: DataFrame, table: DataFrame, key: str, values: list[str], hot: DataFrame) -> DataFrame:
    """spread_join() where the caller names the table's hot rows, none or more; their number and size must have a bound, as they are broadcast."""
    hot_key, hit, other, *hot_values = fresh([*rows.columns, key, *values], "hot_key", "hit", "other", *[f"hot_{v}" for v in values])
    # A function of the row, so that a repeated task deals it to the same place; it equals no key.
    kind, own = rows.schema[key].dataType, F.xxhash64(*rows.columns)
    own = own.bitwiseOR(F.lit(-1 << 63)) if kind.simpleString() == "bigint" else F.concat(F.lit("~"), F.hex(own)).cast(kind)
    hot = hot.select(F.col(key).alias(hot_key), F.lit(True).alias(hit), *[F.col(v).alias(h) for v, h in zip(values, hot_values, strict=True)])
    joined = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")  # bounded, see above
    joined = joined.withColumn(other, F.when(F.col(hit).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own))
    rest = table.select(F.col(key).alias(hot_key), *values)
    out = joined.drop(hot_key).join(rest.hint("merge"), F.col(other) == F.col(hot_key), "left")
    return out.select(*rows.columns, *[F.when(F.col(hit), F.col(h)).otherwise(F.col(v)).alias(v) for v, h in zip(values, hot_values, strict=True)])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after another, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (a, b) that hold at most limit bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def powers(kind: str, n: int) -> np.ndarray:
    if len(_POW[kind]) < n:
        m = max(n, CHUNK_BYTES + 2)
        step = np.full(m, BASE if kind == "up" else BASE_INV, np.uint64)
        step[0] = 1
        _POW[kind] = np.cumprod(step)
    return _POW[kind][:n]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes modulo 2**64, n + 1 of them, over random odd symbols."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SYMBOL[raw] * powers("up", len(raw)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end], wherever it stands."""
    return (prefix[end] - prefix[start]) * powers("down", len(prefix))[start]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Byte tables: ASCII letters lower-cased; ASCII white space; bytes of words (letters, digits, all beyond ASCII).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the table marks: starts, ends, and each row's n + 1 places among them. Runs end at row ends."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    on = inside[raw]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] = on[edge]
    last[edge - 1] = on[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(raw), start, end) + (end - start).astype(np.uint64))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring word hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + h[i : i + n]
    return mix(out)
