"""Operator 4: SimHash fingerprints and their neighbours by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, flat, mix, shingle_hashes, spread_join, steps, stored, word_hashes, words

BITS = 128
#: Blocks that a fingerprint is cut into; each table is keyed by BLOCKS - radius of them.
BLOCKS = 5
RADIUS = 3
#: Parts of a block key's fingerprints, each compared by itself with those that are asked.
SALTS = 8
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_WORD = ~SPACE


def fingerprints(column: pa.Array) -> np.ndarray:
    """BITS bits (as uint8 0 or 1) for each row of a string column.

    Terms are pairs of neighbouring words, lower-cased (the word itself in a text of one word); a term votes on each bit
    with its frequency, for or against by its hash's bit. Ties and texts without words give 0 bits.
    """
    raw, offsets = flat(column)
    out = np.zeros((len(column), BITS), np.uint8)
    for a, b in steps(offsets):
        part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, place = words(part, off, _WORD)
        h = word_hashes(LOWER[part], start, end)
        n = np.diff(place)
        row = np.repeat(np.arange(b - a), n)
        pair = shingle_hashes(h, 2)
        inside = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
        term = np.concatenate([pair[inside], h[place[:-1][n == 1]]])
        owner = np.concatenate([row[1:][inside] if len(row) > 1 else np.zeros(0, np.int64), np.flatnonzero(n == 1)])
        votes = np.bincount(owner, minlength=b - a)
        for half in range(BITS // 64):
            word = mix(term + np.uint64(0x51ED2701 * (half + 1)))
            for byte in range(8):
                value = ((word >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
                count = np.bincount(owner * 256 + value, minlength=(b - a) * 256).reshape(b - a, 256) @ _BIT
                at = half * 64 + byte * 8
                out[a:b, at : at + 8] = 2 * count > votes[:, None]
    return out


def to_hex(bits: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in np.packbits(bits, axis=1)]


def with_next(docs: DataFrame, task, schema: str) -> DataFrame:
    """Runs task(iterator of (doc_id, text, next text)) -> rows over docs in ascending doc_id, each with its successor.

    The ids are cut at quantiles into pieces (a few for each shuffle partition); a piece is found by binary search among the
    cuts. Each piece also gets the first document of the next, so that a task needs no other piece; the first document
    follows the last. Equal ids stand in the order of their texts' hashes; null ids come last, in that order too, and are
    cut by it. Texts are moved once; only the cuts and the pieces' first ids reach the driver, a few for each partition.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("c")).first().c or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right").astype(np.int32))

    by_hash = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * n).cast("int")
    docs = docs.withColumn("piece", F.when(F.col("doc_id").isNull(), by_hash + len(cuts) + 1).otherwise(place(F.coalesce("doc_id", F.lit(0).cast("long")))))
    first = F.min(F.struct("doc_id", "h")).alias("first")
    heads = [(r.piece, r.first.doc_id, r.first.h) for r in docs.groupBy("piece").agg(first).orderBy("piece").collect()]
    if not heads:
        return spark.createDataFrame([], schema)
    before = [(p, first, h, heads[i - 1][0]) for i, (p, first, h) in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(before, "p int, first long, first_h long, to int"))  # a row for each piece
    at_head = (F.col("piece") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h"))
    tails = docs.join(table, at_head).dropDuplicates(["piece"]).select("doc_id", "text", "h", F.col("to").alias("piece"), F.lit(1).alias("tail"))
    rows = docs.withColumn("tail", F.lit(0)).unionByName(tails)
    rows = rows.repartition(n, "piece").sortWithinPartitions("piece", "tail", F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "text", "piece", "tail")

    def pairs(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            for doc_id, text, piece, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and piece == held[2]:
                    yield held[0], held[1], text
                held = (doc_id, text, piece) if not tail else None

    return rows.mapInArrow(lambda batches: task(pairs(batches)), schema)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text and how alike they are, and how alike the next one's is.

    Edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    Likeness: the share of equal bits. Null texts count as empty; a lone document is its own successor.
    """

    def task(rows) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0
        for row in rows:
            kept.append(row)
            size += len(row[1]) + len(row[2])
            if size > 1 << 21 or len(kept) >= 2000:
                yield _compare(kept)
                kept, size = [], 0
        if kept:
            yield _compare(kept)

    return with_next(docs, task, COMPARED)


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, nexts = zip(*rows, strict=True)
    halves = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + x[:h] for t, x, h in zip(texts, nexts, halves, strict=True)]
    # Rows mostly follow each other, so a successor's fingerprint is the next row's unless it belongs to another piece.
    own = fingerprints(pa.array([*texts, nexts[-1]], pa.large_string()))
    follows = np.array([nexts[i] == texts[i + 1] for i in range(len(rows) - 1)] + [True])
    after = own[1:].copy()
    if not follows.all():
        after[~follows] = fingerprints(pa.array([nexts[i] for i in np.flatnonzero(~follows)], pa.large_string()))
    own = own[:-1]
    new = fingerprints(pa.array(edited, pa.large_string()))
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(to_hex(own)), pa.array(to_hex(new)), pa.array((own == new).mean(1)), pa.array((own == after).mean(1)),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in COMPARED.split(", ")])


def _words(fingerprint: Column) -> Column:
    """A hex fingerprint as 32-bit numbers."""
    return F.array(*[F.conv(F.substring(fingerprint, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(BITS // 32)])


def _edges(blocks: int) -> list[int]:
    """Where the blocks of a fingerprint begin, in hex digits, and its end."""
    return [round(i * BITS / 4 / blocks) for i in range(blocks + 1)]


def _tables(rows: DataFrame, radius: int, blocks: int) -> DataFrame:
    """rows (fingerprint, ...) once for each table: table, key (a hash of the blocks that the table puts to the front), w."""
    edge = _edges(blocks)
    keys = [F.xxhash64(*[F.substring("fingerprint", edge[i] + 1, edge[i + 1] - edge[i]) for i in c]) for c in combinations(range(blocks), blocks - radius)]
    return rows.select("*", _words(F.col("fingerprint")).alias("w"), F.posexplode(F.array(*keys)).alias("table", "key"))


def _near(radius: int, blocks: int) -> tuple[Column, Column]:
    """Of rows a and b that met under a key: their distance, and whether they are near and this is the first table in which they
    agree, so that each pair is found once without being compared with other pairs."""
    edge, choices = _edges(blocks), list(combinations(range(blocks), blocks - radius))
    distance = sum(F.bit_count(F.col("a.w")[i].bitwiseXOR(F.col("b.w")[i])) for i in range(BITS // 32))
    equal = sum((F.substring("a.fingerprint", edge[i] + 1, edge[i + 1] - edge[i]) == F.substring("b.fingerprint", edge[i] + 1, edge[i + 1] - edge[i])).cast("int") * (1 << i) for i in range(blocks))
    mine = F.element_at(F.array(*[F.lit(sum(1 << i for i in c)) for c in choices]), F.col("a.table") + 1)
    upto = F.element_at(F.array(*[F.lit((2 << c[-1]) - 1) for c in choices]), F.col("a.table") + 1)
    return distance.cast("int"), (distance <= radius) & (equal.bitwiseAND(upto) == mine)


def _checked(radius: int, blocks: int) -> None:
    if not 0 <= radius < blocks:
        raise ValueError("blocks must exceed radius")


def near_pairs(found: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs a < b of distinct fingerprints within the Hamming radius, with their distance.

    found: fingerprint (hex; nulls and repeats are dropped first, so copies cost nothing). Fingerprints are cut into blocks;
    two within the radius agree on at least blocks - radius of them, so each choice of so many blocks is a table whose key
    is those blocks, permuted to the front. Pairs are compared within the join and kept once, from the first table in
    which they agree. blocks must exceed radius. The result is as large as the number of near pairs; near_counts() is not.
    """
    _checked(radius, blocks)
    tables = _tables(found.where("fingerprint IS NOT NULL").select("fingerprint").distinct(), radius, blocks)
    distance, near = _near(radius, blocks)
    a, b = tables.alias("a"), tables.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.table") == F.col("b.table"))
    return a.join(b, same & (F.col("a.fingerprint") < F.col("b.fingerprint")) & near).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"), distance.alias("distance"))


def near_counts(found: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS, salts: int = SALTS) -> DataFrame:
    """fingerprint, copies, n_near: for each distinct fingerprint of the rows that are asked, how many rows of found hold it, and
    how many other rows hold it or one within the radius.

    found: fingerprint (hex, nulls are passed over), and what asked needs. Copies are counted before anything meets. The asked
    fingerprints are looked up in the block tables of all; each block key is dealt to so many tasks, to all of which its
    asked fingerprints go, so that a key that many fingerprints share is compared in parts.
    """
    _checked(radius, blocks)
    own = found.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("n"), F.max(F.coalesce(asked, F.lit(False)).cast("int")).alias("asked"))
    own = stored(own, "simhash-distinct")
    b = _tables(own.select("fingerprint", "n"), radius, blocks).withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)).cast("int")).alias("b")
    a = _tables(own.where("asked = 1").select("fingerprint"), radius, blocks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("a")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.table") == F.col("b.table")) & (F.col("a.salt") == F.col("b.salt"))
    counts = b.join(a.hint("merge"), same & _near(radius, blocks)[1]).groupBy(F.col("a.fingerprint").alias("fingerprint")).agg((F.sum("b.n") - 1).alias("n_near"))
    return counts.join(own.select("fingerprint", F.col("n").alias("copies")).hint("merge"), "fingerprint")


def with_neighbours(docs: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """compare(docs) with n_near, for the rows that are asked (a condition on compare()'s columns) the number of other rows of which
    the fingerprint is within the radius, and else null."""
    found = stored(compare(docs), "simhash")
    counts = stored(near_counts(found, asked, radius, blocks), "simhash-near")
    return spread_join(found, counts, "fingerprint", "copies", ["n_near"]).withColumn("n_near", F.when(asked, F.col("n_near")))
