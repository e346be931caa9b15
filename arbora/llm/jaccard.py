"""Operator 10: exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

Sets of at least 3 are put in size bands [l, 4 l / 3]. Two sets whose Jaccard similarity is 0.75 or more lie in one band or
in neighbouring ones, and if the smaller one's band ends at u they differ in at most H = floor(u / 3) elements. For that
scheme each set hashes its elements into m > H segments and indexes every segment that is not empty, by its content. In a
few segments it also indexes the one-deletion neighbourhood, so that there only two differing elements spoil a match.

Pigeonhole with allocation: a segment of a set is worth 1 (exact), or 2 (with deletions, from two elements on), an empty one
nothing. A set whose segments are worth H + 1 + 2 c shares at least 1 + c indexed keys with each set it links with. The few
sets that are worth less index their empty segments too, and so find each other; all others find them anyway.
The numbers below are chosen by cost: deletions cost a key for each element, empty segments would be hot.

Keys that many sets share (more than SMALL) are not expanded to pairs. As a pair shares 1 + c keys, each set may leave out
its c most shared ones, which removes keys that a common passage alone makes; what is left is joined by
stars of two levels. Sets that are then still in different components get new keys in place of the hot one: the elements that come
first when all are ordered by how many such sets hold them, rarest first, as many as a set can miss and one more. Sets that
link have one of these in common (prefix filter), and a passage that many sets share gives none as long as they have rarer
elements. Only sets of different components that share such a key are compared, by sketch and block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import HOT_SHARE, LOWER, SPACE, bucketed, flat, fresh, mix, set_aside, shingle_hashes, spread, spread_join, steps, stored, word_hashes, words
from .components import components

NGRAM = 5
#: Links need NUMERATOR * union <= DENOMINATOR * intersection: 0.75.
NUMERATOR, DENOMINATOR = 75, 100
SMALL = 16
#: About so many sets of a hot key are compared with so many others in one go.
BLOCK = 1024
#: Sketches and packed texts up to this size are broadcast to the pairs of a set that very many pairs name.
HOT_BYTES = 1 << 16
#: Cells in which the elements of sets under hot keys are counted: a table of this many numbers, whatever the data.
CELLS = 1 << 18
_WORD = ~SPACE
ROWS = "doc_id long, n_shingles long, digest binary"
TEXTS = "doc_id long, n_shingles long, digest binary, sketch binary, packed binary"
KEYS = "bucket int, base long, keys binary"
MET = "hot boolean, key long, scheme int, a long, b long, n long"


@cache
def bands() -> np.ndarray:
    """First sizes of the bands, far beyond any document."""
    out = [3]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 4 // 3 + 1)
    return np.array(out, np.int64)


def scheme(k: int) -> tuple[int, int, int, int]:
    """H, segments m, segments with deletions q, spare keys c."""
    u = int(bands()[k + 1]) - 1
    h = u // 3
    c, q = h // 50, h // 25 + 1
    return h, h + 1 + 2 * c + math.ceil(0.3 * h) + 3, q, c


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row."""
    raw, offsets = flat(column)
    out: list[np.ndarray] = []
    for a, b in steps(offsets):
        part, off = LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        start, end, place = words(part, off, _WORD)
        h = word_hashes(part, start, end)
        g = shingle_hashes(h, NGRAM)
        for i in range(b - a):
            lo, hi = place[i], place[i + 1]
            if hi - lo >= NGRAM:
                out.append(np.unique(g[lo : hi - NGRAM + 1]))
            elif hi > lo:
                out.append(mix(shingle_hashes(h[lo:hi], hi - lo) + np.uint64(hi - lo)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketch(s: np.ndarray) -> bytes:
    """Whether an odd number of elements falls into each of 2**k cells, at least four cells to an element."""
    cells = max(512, 1 << (4 * max(1, len(s)) - 1).bit_length())
    odd = (np.bincount((mix(s + np.uint64(77)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch with fewer cells: those that become one add up."""
    return x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def may_link(x: bytes, y: bytes, n: int, m: int) -> bool:
    """False only if sizes or sketches show that sets of n and m elements differ in more elements than a link allows."""
    if min(n, m) * DENOMINATOR < max(n, m) * NUMERATOR:
        return False
    size = min(len(x), len(y)) // 8
    odd = folded(np.frombuffer(x, np.uint64), size) ^ folded(np.frombuffer(y, np.uint64), size)
    return int(np.bitwise_count(odd).sum()) * (NUMERATOR + DENOMINATOR) <= (n + m) * (DENOMINATOR - NUMERATOR)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All index keys of the sets, and whose they are. The top bits of a key choose its bucket."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(bands(), sizes, "right") - 1
    keys, owners = [], []
    for own in (0, 1):
        for k in np.unique(band[band - own >= 0] - own):
            if k < 0:
                continue
            h, m, q, c = scheme(int(k))
            rows = np.flatnonzero(band - own == k)
            x = np.concatenate([sets[r] for r in rows])
            who = np.repeat(np.arange(len(rows)), sizes[rows])
            seg = (mix(x + np.uint64(int(k) * 0x9E37)) % np.uint64(m)).astype(np.int64)
            value = mix(x * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1))
            cell = who * m + seg
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
            total = np.add.reduceat(value, first) if len(first) else value
            count = np.diff(np.append(first, len(cell)))
            at = cell[first]

            def key(content: np.ndarray, n: np.ndarray, s: np.ndarray, k=k) -> np.ndarray:
                return mix(content + mix(s.astype(np.uint64) + np.uint64(int(k) << 40)) + n.astype(np.uint64))

            keys.append(key(total, count, at % m))
            owners.append(rows[at // m])
            # One-deletion neighbourhoods of the first q segments.
            which = np.repeat(np.arange(len(first)), count)
            d = np.flatnonzero((cell % m < q) & (count[which] > 1))
            keys.append(key(total[which[d]] - value[d], count[which[d]] - 1, cell[d] % m))
            owners.append(rows[cell[d] // m])
            worth = np.bincount(at // m, np.where((at % m < q) & (count > 1), 2, 1), len(rows))
            poor = np.flatnonzero(worth < h + 1 + 2 * c)
            if len(poor):
                full = np.zeros((len(poor), m), bool)
                slot = np.full(len(rows), -1)
                slot[poor] = np.arange(len(poor))
                mine = slot[at // m] >= 0
                full[slot[at[mine] // m], at[mine] % m] = True
                r, s = np.nonzero(~full)
                keys.append(key(np.zeros(len(r), np.uint64), np.zeros(len(r), np.int64), s))
                owners.append(rows[poor[r]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _described(packed: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            columns = [batch.column(0), [len(s) for s in sets], [_digest(s) for s in sets]]
            if packed:
                raw, off = flat(batch.column(1))
                columns.append([sketch(s) for s in sets])
                columns.append([squeeze.compress(LOWER[raw[off[i] : off[i + 1]]].tobytes()) for i in range(len(sets))])
            yield _batch(TEXTS if packed else ROWS, *columns)

    return task


def _unpack(column: pa.Array) -> pa.Array:
    loose = zstandard.ZstdDecompressor()
    return pa.array([loose.decompress(x) for x in column.to_pylist()], pa.large_binary())


def _index(buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            a = 0
            while a < len(ids):
                # A packed key holds its owner as a 16-bit distance from the base.
                near = (ids[a : a + 4096] >= ids[a]) & (ids[a : a + 4096] - ids[a] < 1 << 16)
                b = a + (len(near) if near.all() else int(np.argmin(near)))
                keys, owner = _keys(shingle_sets(_unpack(batch.column(1).slice(a, b - a))))
                bucket = (keys >> np.uint64(32)).astype(np.int64) % buckets
                packed = (keys << np.uint64(16)) | (ids[a:b][owner] - ids[a]).astype(np.uint64)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                packed = packed[order]
                full = np.flatnonzero(np.diff(edge))
                if len(full):
                    yield _batch(KEYS, full, np.full(len(full), ids[a]), [packed[edge[i] : edge[i + 1]].tobytes() for i in full])
                a = b

    return task


def _meet(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Pairs that meet under a key of few sets, and the rows of keys of many. Buckets come one after another."""
    held: list[tuple[int, int, bytes]] = []
    pairs: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        packed = [np.frombuffer(x, np.uint64) for _, _, x in held]
        ids = np.concatenate([(p & np.uint64(0xFFFF)).astype(np.int64) + base for p, (_, base, _) in zip(packed, held, strict=True)])
        keys = np.concatenate([p >> np.uint64(16) for p in packed])
        bucket = np.concatenate([np.full(len(p), b, np.int64) for p, (b, _, _) in zip(packed, held, strict=True)])
        held, size = [], 0
        order = np.lexsort((ids, keys, bucket))
        ids, keys, bucket = ids[order], keys[order], bucket[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1]))
        # A set may index the same key twice (its own content and a deletion).
        once = new | np.append(True, ids[1:] != ids[:-1])
        ids, keys, bucket, new = ids[once], keys[once], bucket[once], new[once]
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(ids)))
        for gap in range(1, small):
            s = start[(count > gap) & (count <= small)]
            n = count[(count > gap) & (count <= small)]
            if not len(s):
                break
            i = np.repeat(s, n - gap) + np.arange((n - gap).sum()) - np.repeat(np.cumsum(n - gap) - (n - gap), n - gap)
            pairs.append(np.stack([ids[i], ids[i + gap]], 1))
            if sum(map(len, pairs)) > 1 << 20:
                pairs[:] = [np.unique(np.concatenate(pairs), axis=0)]
        hot = np.repeat(count > small, count)
        if hot.any():
            name = (mix(bucket[hot].astype(np.uint64)) ^ keys[hot]).view(np.int64)
            n = np.repeat(count, count)[hot]
            yield _batch(MET, np.ones(len(n), bool), name, np.zeros(len(n), np.int32), ids[hot], np.repeat(ids[start], count)[hot], n)

    for batch in batches:
        for bucket, base, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][0] != bucket and size > 1 << 20:
                yield from flush()
            held.append((bucket, base, blob))
            size += len(blob) // 8
    if held:
        yield from flush()
    if pairs:
        met = np.unique(np.concatenate(pairs), axis=0)
        for i in range(0, len(met), 1 << 16):
            p = met[i : i + (1 << 16)]
            yield _batch(MET, np.zeros(len(p), bool), np.zeros(len(p), np.int64), np.zeros(len(p), np.int32), p[:, 0], p[:, 1], np.full(len(p), 2))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in range(0, len(a), 512):
            x, y = shingle_sets(_unpack(batch.column(2).slice(i, 512))), shingle_sets(_unpack(batch.column(3).slice(i, 512)))
            good = []
            for j, (s, t) in enumerate(zip(x, y, strict=True)):
                both = len(s) + len(t) - len(np.union1d(s, t))
                if DENOMINATOR * both >= NUMERATOR * (len(s) + len(t) - both):
                    good.append(i + j)
            if good:
                yield _batch("u long, v long", a[good], b[good])


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb, sa, sb, da, db = (c.to_pylist() for c in batch.columns)
        good = [i for i in range(len(a)) if may_link(sa[i], sb[i], na[i], nb[i])]
        if good:
            yield _batch("a long, b long, da binary, db binary", *[[c[i] for i in good] for c in (a, b, da, db)])


def _hot(pairs: DataFrame, key: str, table: DataFrame, size: str) -> DataFrame:
    """The rows of table that more than a thousandth of all pairs name, so 1000 at most, and are no longer than HOT_BYTES each.
    There may be none: the pairs then go the same way."""
    least = max(SMALL, int(pairs.count() * HOT_SHARE))
    named = [r[0] for r in pairs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(key).collect()]
    return table.where(F.col(key).isin(named) & (F.octet_length(size) <= HOT_BYTES))


def _links(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Those of the pairs (a, b) of ids that link, stored: sifted by sketches, and the rest verified.

    The texts' table is bucketed by digest, so that only pairs, and the first text of each, are shuffled. A set that very many
    pairs name is broadcast to them instead (see _hot), so that its pairs do not meet in one task.
    """
    known = texts.select("id", "n_shingles", "sketch", "digest")
    one = known.withColumnsRenamed({"id": "a", "n_shingles": "na", "sketch": "sa", "digest": "da"})
    two = known.withColumnsRenamed({"id": "b", "n_shingles": "nb", "sketch": "sb", "digest": "db"})
    fits = F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR
    pairs = stored(pairs, f"{name}-pairs")
    met = spread(pairs, one, "a", ["na", "sa", "da"], _hot(pairs, "a", one, "sa"))
    met = met.join(two.hint("merge"), "b").where(fits).select("a", "b", "na", "nb", "sa", "sb", "da", "db")
    met = stored(met.mapInArrow(_sift, "a long, b long, da binary, db binary"), f"{name}-sifted")
    own = texts.select(F.col("digest").alias("da"), F.col("packed").alias("x"))
    other = texts.select(F.col("digest").alias("db"), F.col("packed").alias("y"))
    both = spread(met, own, "da", ["x"], _hot(met, "da", own, "x")).join(other.hint("merge"), "db").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_verify, "u long, v long"), name)


def distinct_sets(docs: DataFrame) -> tuple[DataFrame, str]:
    """One row for each distinct set that is not empty: id, digest, n_shingles, least doc_id, copies, packed text; and the name of
    the table that holds them. Copies meet before the shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_described(True), TEXTS)
    once = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("packed").alias("packed"))
    return bucketed(once.withColumn("id", F.monotonically_increasing_id()), "jaccard_sets", "digest")


def _apart(named: DataFrame, block: int) -> DataFrame:
    """Of key, id, root, the keys whose sets are in more than one component, with the number of blocks that their sets make."""
    keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return named.join(keys.where("lo < hi").select("key", "blocks"), "key")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's sets hold an element of each cell."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for s in shingle_sets(_unpack(batch.column(0))):
            total += np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(total)
    yield _batch("cell int, n long", at, total[at])


def _prefixes(counts: np.ndarray):
    """Each set's rarest elements as keys: as many as a linked set can lack, and one more. Any order that is the same for all sets
    will do, so the counts of cells do."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sets = shingle_sets(_unpack(batch.column(2)))
            first = [s[np.lexsort((s, counts[(s & np.uint64(CELLS - 1)).astype(np.int64)]))][: len(s) + (-len(s) * NUMERATOR) // DENOMINATOR + 1] for s in sets]
            size = [len(x) for x in first]
            for i in range(0, len(sets), 256):
                k = slice(i, i + 256)
                yield _batch("key long, id long, root long", np.concatenate(first[k]).view(np.int64), np.repeat(ids[k], size[k]), np.repeat(roots[k], size[k]))

    return task


def link_sets(texts: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """distinct_sets() -> verified links (u, v) of ids that connect all that any links connect: stored."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = texts.where("n_shingles >= 3").select("id", "packed").mapInArrow(_index(2 * parts), KEYS)
    met = stored(keys.repartitionById(parts, F.expr(f"bucket % {parts}")).sortWithinPartitions("bucket").mapInArrow(lambda batches: _meet(batches, small), MET), "jaccard-met")
    few = met.where("NOT hot").select("a", "b")
    hot = _kept(met.where("hot").select("key", F.col("a").alias("id"), "n"), texts)
    # Stars of two levels, about sqrt(n) of them under a key of n sets, so that no set is in many pairs.
    hot = hot.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.ceil(F.sqrt("n"))))
    heads = stored(hot.groupBy("key", "salt").agg(F.min("id").alias("a")), "jaccard-heads")
    tops = heads.join(heads.groupBy("key").agg(F.min("a").alias("top")), "key").select(F.col("top").alias("a"), F.col("a").alias("b"))
    star = hot.join(heads, ["key", "salt"]).select("a", F.col("id").alias("b")).unionByName(tops).where("a < b")
    links = _links(few.unionByName(star).distinct(), texts, "jaccard-links")
    if hot.isEmpty():
        return links
    # Sets under a hot key that the links so far leave apart meet again under rarer keys, and are compared there.
    root = components(links)
    named = hot.join(root.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    lone = _apart(named, block).select("id", "root").distinct()
    sets = stored(lone.join(texts.select("id", "n_shingles", "sketch", "packed"), "id"), "jaccard-apart")
    counts = np.zeros(CELLS, np.int64)
    for r in sets.select("packed").mapInArrow(_held, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # CELLS rows at most
        counts[r.cell] = r.n
    keys = stored(sets.select("id", "root", "packed").mapInArrow(_prefixes(counts), "key long, id long, root long"), "jaccard-prefixes")
    left = _apart(keys, block).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    left = stored(left.join(sets.select("id", "n_shingles", "sketch"), "id"), "jaccard-left")
    # Each pair of a key's blocks is compared by itself: a task holds two blocks, however many sets share the key.
    dealt = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rest = dealt.select("key", "lo", "hi", "block", "root", "id", "n_shingles", "sketch").repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "root", "id").mapInArrow(_across, "a long, b long").distinct()
    return links.unionByName(_links(rest, texts, "jaccard-across"))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across components, between two blocks under one hot key, whose sizes and sketches allow a link; rows come sorted by
    key and blocks.

    Sketches are compared as blocks of bits, so no pair that is ruled out is ever a row.
    """
    out: set[tuple[int, int]] = set()

    def compare(rows: list[dict]) -> None:
        if len(rows) < 2:
            return
        n = np.array([r["n_shingles"] for r in rows], np.int64)
        root = np.array([r["root"] for r in rows], np.int64)
        ids = np.array([r["id"] for r in rows], np.int64)
        block = np.array([r["block"] for r in rows], np.int64)
        within = rows[0]["lo"] == rows[0]["hi"]
        size = min(len(r["sketch"]) for r in rows) // 8
        bits = np.stack([folded(np.frombuffer(r["sketch"], np.uint64), size) for r in rows])
        step = max(1, (1 << 21) // (len(rows) * size))
        for i in range(0, len(rows), step):
            k = slice(i, i + step)
            fits = (np.minimum(n[k, None], n) * DENOMINATOR >= np.maximum(n[k, None], n) * NUMERATOR) & (root[k, None] < root) & (within | (block[k, None] != block))
            odd = np.bitwise_count(bits[k, None] ^ bits).sum(-1, dtype=np.int64)
            x, y = np.nonzero(fits & (odd * (NUMERATOR + DENOMINATOR) <= (n[k, None] + n) * (DENOMINATOR - NUMERATOR)))
            u, v = ids[x + i], ids[y]
            out.update(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and any(held[-1][c] != r[c] for c in ("key", "lo", "hi")):
                compare(held)
                held = []
                if len(out) >= 1 << 17:
                    yield _batch("a long, b long", *zip(*sorted(out), strict=True))
                    out.clear()
            held.append(r)
    compare(held)
    if out:
        yield _batch("a long, b long", *zip(*sorted(out), strict=True))


def _kept(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of hot keys without each set's most shared ones, as many as it can spare in each of its schemes' sums."""
    n = texts.select("id", "n_shingles")
    order = Window.partitionBy("id").orderBy(F.col("n").desc(), "key")
    # The lower of its two schemes has the fewer spare keys, floor(floor(u / 3) / 50), and there u >= 3 n / 4 - 1.
    spare = F.floor(F.floor((F.col("n_shingles") * 3 / 4 - 1) / 3) / 50)
    ranked = hot.join(n, "id").withColumn("place", F.row_number().over(order))
    return stored(ranked.where(F.col("place") > spare).select("key", "id", "n"), "jaccard-hot")


def join(docs: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text), by links of Jaccard similarity 0.75 or more.

    Words are maximal runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct shingles of five
    words, or all words as one shingle if there are fewer. Equal sets are one node; null and empty texts are linked with
    nothing and keep their own doc_id. component_id is the smallest doc_id reachable (null ids are passed over: a
    component of null ids alone has none). Repeated rows stay. Exact up to collisions of 64-bit shingle hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_described(False), ROWS)
    # Empty sets need no class, and rows of a set that very many rows hold do not meet in one task.
    rows = rows.withColumn("digest", F.when(F.col("n_shingles") > 0, F.col("digest")))
    named = spread_join(rows, _classes(docs, small, block), "digest", "copies", ["component_id"])
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(docs: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """digest, copies, component_id and leader (the digest of the component's first set) of each distinct set: stored."""
    texts, table = distinct_sets(docs)
    root = components(link_sets(texts, small, block))
    member = texts.select("id", "digest", "copies", F.col("doc_id").alias("least")).join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Most components are one set or a few; those of very many sets are reduced before they are shuffled.
    first = member.groupBy("root").agg(F.count("*").alias("members"), F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "digest")).getField("digest").alias("leader"))
    out = spread_join(member, stored(first, "jaccard-roots"), "root", "members", ["component_id", "leader"])
    out = stored(out.select("digest", "copies", "component_id", "leader"), "jaccard-classes")
    docs.sparkSession.sql(f"DROP TABLE {table}")
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component of join(), that of its smallest doc_id, and all rows without words, which are linked with nothing.

    Of repeated rows with that id one is kept. Only the leaders' ids and digests are joined to the texts. Columns of docs are
    kept whatever their names.
    """
    docs, back = set_aside(docs, ["doc_id", "text"])
    digest, least = fresh(docs.columns, "digest", "least")
    leaders = _classes(docs).where("digest = leader").select(F.col("digest").alias(digest), F.col("component_id").alias(least))
    fields = StructType([*docs.schema, StructField(digest, BinaryType())])
    at = docs.columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())], [*batch.schema.names, digest])

    rows = docs.mapInArrow(add, fields)
    bare = rows.where(F.col(digest).isNull()).select(docs.columns)
    # Only rows with a leader's own id go into the join, so copies with other ids stay where they are.
    led = rows.join(leaders.hint("merge"), (rows[digest] == leaders[digest]) & F.col("doc_id").eqNullSafe(F.col(least))).drop(leaders[digest])
    return back(led.dropDuplicates([digest]).select(docs.columns).unionByName(bare))
