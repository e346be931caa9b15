"""Operator 12: collocations, counted exactly after merged count-min sketches have told what can't be frequent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, LOWER, flat, mix, spread, steps, stored, word_hashes, words

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
#: Share (percent) of a phrase's occurrences inside one longer phrase from which on it is dropped.
SUBSUMED = 50
#: Rows of a sketch, places of a cell that are counted apart, and occurrences that fall on average on a cell for each wanted count of 10, where
#: there is room and where there is not. A place is so seldom shared that one row is enough: a cell has its bit for phrases that are frequent.
DEPTH, PLACES = 1, 128
LOAD, CROWDED = 8, 32
#: Cells of a row of a sketch at least and at most, and bytes of the cells' bits that are sent to all tasks at once: only a sketch that would be
#: CROWDED is cut by hash into slices, each a scan of its own (some 27 GB of text a slice, with a count of 10). Beyond MAX_SLICES the cells get
#: fuller, so that more rare phrases are counted and dropped.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 29
SLICE_BYTES, MAX_SLICES = 64 << 20, 16
#: Blocks of a line of a sketch's slice, the pieces that tasks send and add up. What a task adds up holds the different places of one block.
BLOCKS = 1024
#: Phrases (or words, or so many times 16 bytes of words) that a task holds before it sends what it has, and bytes of text that it takes at a
#: time: a task's memory is a few times each of these, whatever the lengths of texts and batches.
HELD = 1 << 20
STEP_BYTES = 1 << 20
#: Bytes that end a piece of a text, and bytes that stand in no word.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~ENDS
_WORD[[0x20, 0x09]] = False
SKETCH = "slice int, line int, block long, size int, counts binary"
COUNTS = "lang string, phrase string, size int, n long"
#: Buckets of phrases by hash. Tasks send one piece a bucket, of phrases after their languages and a tab, and counts.
BUCKETS = 512
PIECES = "bucket int, size int, bytes int, counts binary"


class Words(NamedTuple):
    """Words of some texts: lower-cased bytes, starts and ends, whether each but the last goes on with the next one, languages by number, and their names."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    on: np.ndarray
    lang: np.ndarray
    langs: list[bytes]

    def hashes(self, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of 1, 2, ... words that begin with each word: their hashes, the same in every task, and which of them are there."""
        of = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        one = mix(word_hashes(self.raw, self.start, self.end) + of[self.lang])
        h, going = one, np.ones(len(one), bool)
        for m in range(max_words):
            if m:
                h = mix(h[:-1] * BASE + one[m:])
                going = going[:-1] & self.on[m - 1 : m - 1 + len(h)]
            yield h, going

    def spelled(self) -> pa.Array:
        bounds = np.append(0, np.cumsum(self.end - self.start)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(bounds), pa.py_buffer(self.raw[_WORD[self.raw]])])


def read(texts: pa.Array, langs: pa.Array) -> Iterator[Words]:
    """The words of texts, STEP_BYTES of text at a time."""
    raw, offsets = flat(texts)
    lang = langs.fill_null("und").dictionary_encode()
    lang_of, names = lang.indices.to_numpy(), [x.encode() for x in lang.dictionary.to_pylist()]
    for a, b in steps(offsets, STEP_BYTES):
        part, off = LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        start, end, place = words(part, off, _WORD)
        if not len(start):
            continue
        owner = np.repeat(np.arange(b - a), np.diff(place))
        # A word goes on with the next one if no end of a piece or text stands between them.
        ends = np.flatnonzero(ENDS[part])
        on = (owner[1:] == owner[:-1]) & (np.diff(np.searchsorted(ends, start)) == 0)
        yield Words(part, start, end, on, lang_of[a:b][owner], names)


def release() -> None:
    """Gives back what Arrow's pool keeps of freed memory, which a worker would hold on to between tasks too."""
    pa.default_memory_pool().release_unused()


class Counter:
    """Phrases of a task, counted as 64-bit keys: the codes of their words, each of bits bits from the lowest on, 0 for none.

    A word's code stands for its language and itself, so that phrases of languages stay apart; equal keys are equal phrases. Codes hold from
    one take() to the next."""

    def __init__(self, max_words: int):
        self.max_words, self.bits = max_words, 63 // max_words
        self.room = min(HELD, (1 << self.bits) - 1)
        self.forget()

    def forget(self) -> None:
        # Words one after another with the numbers of their languages; by size, which of them begin a phrase.
        self.words: list[pa.Array] = []
        self.langs: list[np.ndarray] = []
        self.starts: list[list[np.ndarray]] = [[] for _ in range(self.max_words)]
        self.known: dict[bytes, int] = {}
        self.n_words = self.n_bytes = self.n_phrases = 0

    def add(self, text: Words, kept: list[np.ndarray]) -> Iterator[None]:
        """Collects the phrases of 1, 2, ... words that begin where kept says; yields whenever the caller should take() them."""
        spelled, length = text.spelled(), text.end - text.start
        step = max(1, self.room // 2 - self.max_words)  # so many words always have codes
        for i in range(0, len(length), step):
            here = [those[i : i + step] for those in kept]
            used = np.zeros(len(length[i : i + step + self.max_words - 1]), bool)
            for m, those in enumerate(here):
                for j in range(m + 1):
                    used[j : j + len(those)] |= those
            n, size = int(used.sum()), int(length[i : i + len(used)][used].sum())
            if self.n_words and (self.n_words + n > self.room or self.n_bytes + size > 16 * HELD):
                yield
            number = np.array([self.known.setdefault(x, len(self.known)) for x in text.langs], np.int64)
            place = np.cumsum(used) + (self.n_words - 1)
            self.words.append(spelled.slice(i, len(used)).filter(pa.array(used)))
            self.langs.append(number[text.lang[i : i + len(used)][used]])
            for starts, those in zip(self.starts, here, strict=True):
                starts.append(place[: len(those)][those].astype(np.int32))
                self.n_phrases += len(starts[-1])
            self.n_words, self.n_bytes = self.n_words + n, self.n_bytes + size
            if self.n_phrases > HELD:
                yield

    def take(self) -> Iterator[tuple[pa.Array, pa.Array, int, np.ndarray]]:
        """The phrases collected since the last time, each once: languages, phrases, their words' number, how often each occurs."""
        names = pa.concat_arrays([pa.array([], pa.binary()), *self.words]).dictionary_encode()
        lang = np.concatenate([np.zeros(0, np.int64), *self.langs])
        word = pa.array(lang * len(names.dictionary) + names.indices.to_numpy()).dictionary_encode()
        spelled, langs, of = names.dictionary.cast(pa.string()), pa.array([x.decode() for x in self.known], pa.string()), word.dictionary.to_numpy()
        code = word.indices.to_numpy().astype(np.int64) + 1
        keys = [np.zeros(0, np.int64)]
        for m, starts in enumerate(self.starts):
            start = np.concatenate([np.zeros(0, np.int32), *starts])
            keys.append(sum(code[start + j] << np.int64(self.bits * j) for j in range(m + 1)))
        self.forget()
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        # Shorter phrases have smaller keys.
        ends = [*np.searchsorted(key, [1 << self.bits * m for m in range(1, self.max_words)]).tolist(), len(key)]
        for m, (first, last) in enumerate(zip([0, *ends], ends, strict=False), 1):
            for a in range(first, last, 1 << 16):
                some = key[a : min(last, a + (1 << 16))]
                at = [of[(some >> np.int64(self.bits * i) & np.int64((1 << self.bits) - 1)) - 1] for i in range(m)]
                phrase = pc.binary_join_element_wise(*[spelled.take(pa.array(x % len(spelled))) for x in at], " ")
                yield langs.take(pa.array(at[0] // len(spelled))), phrase, m, count[a : a + len(some)]


def _places(h: np.ndarray, line: int, cells: int) -> np.ndarray:
    """Places of hashes in a line, PLACES neighbouring ones a cell."""
    h = mix(h + np.uint64(line * 0xD1B54A32D192ED03 % (1 << 64))) if line else h
    return (h & np.uint64(cells * PLACES - 1)).astype(np.int64)


def _slice(h: np.ndarray, slices: int) -> np.ndarray | int:
    return ((h >> np.uint64(40)) % np.uint64(slices)).astype(np.int64) if slices > 1 else 0


def _sketches(max_words: int, cells: int, slices: int, most: int):
    """Task: texts and languages -> its sketch, by blocks: the places that aren't 0, and their counts (most at most)."""
    wide = cells // BLOCKS * PLACES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            for line in range(DEPTH if held else 0):
                every = np.concatenate(parts[line])
                parts[line].clear()
                every.sort()
                begin = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
                n = np.minimum(np.diff(begin, append=len(every)), most)
                place = every[begin]
                block = place // wide
                first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                last = np.append(first[1:], len(place))
                # Distances of places and counts are small numbers: byte by byte, the higher ones compress to nothing.
                step = np.diff(place, prepend=0)
                step[first] = place[first] % wide
                planes = np.empty((6, len(place)), np.uint8)
                planes[:4], planes[4:] = step.astype("<u4").view(np.uint8).reshape(-1, 4).T, n.astype("<u2").view(np.uint8).reshape(-1, 2).T
                for i in range(0, len(first), 512):
                    spans = list(zip(first[i : i + 512].tolist(), last[i : i + 512].tolist(), strict=True))
                    at = block[first[i : i + 512]]
                    counts = [pa.compress(planes[:, a:b].tobytes(), "zstd", asbytes=True) for a, b in spans]
                    columns = [(at // BLOCKS).astype(np.int32), np.full(len(at), line, np.int32), at, np.array([b - a for a, b in spans], np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(counts, pa.binary())], [x.split()[0] for x in SKETCH.split(", ")])

        for batch in batches:
            for text in read(batch.column(0), batch.column(1)):
                for h, going in text.hashes(max_words):
                    h = h[going]
                    for line in range(DEPTH):
                        parts[line].append(_slice(h, slices) * (cells * PLACES) + _places(h, line, cells))
                    held += len(h)
                if held > HELD:
                    yield from send()
                    held = 0
                    release()
            del batch  # before the next one comes
            release()
        yield from send()
        release()

    return task


def _distinct(both: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places and counts, each pair one number (16 bits the count), sorted in place: the different places and their counts (most at most)."""
    both.sort()
    place = both >> 16
    begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[begin], np.minimum(np.add.reduceat(both & 65535, begin), most)


def _added(most: int, block_cells: int):
    """Task: blocks of sketches, sorted by slice, line and block -> slice, line, block, the bits of the cells with a place that reaches most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, known = None, [], 0, 0

        def done() -> pa.RecordBatch:
            place, n = _distinct(np.concatenate(parts), most)
            full = np.zeros(block_cells, bool)
            full[place[n >= most] // PLACES] = True
            bits = np.packbits(full, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([at[2]], pa.int64()), pa.array([bits], pa.binary())], ["slice", "line", "block", "bits"])

        for batch in batches:
            for s, line, block, m, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (s, line, block) != at:
                    if at is not None:
                        yield done()
                    at, parts, held, known = (s, line, block), [], 0, 0
                planes = np.frombuffer(pa.decompress(counts, m * 6, "zstd", asbytes=True), np.uint8).reshape(6, m)
                place = np.cumsum(planes[:4].T.copy().view("<u4")[:, 0], dtype=np.int64)
                parts.append(place << 16 | planes[4:].T.copy().view("<u2")[:, 0])
                held += m
                if held > HELD + 2 * known:
                    place, n = _distinct(np.concatenate(parts), most)
                    parts, held, known = [place << 16 | n], len(place), len(place)
        if at is not None:
            yield done()

    return task


def _survivors(max_words: int, cells: int, slices: int, which: int, sent):
    """Task: texts and languages -> lang, phrase, size, n of what the sketch leaves possible; with which 0, also each language's words as phrase ''."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(max_words)
        names = [x.split()[0] for x in COUNTS.split(", ")]
        total: dict[bytes, int] = {}

        def possible(h: np.ndarray, going: np.ndarray) -> np.ndarray:
            some = np.flatnonzero(going & (_slice(h, slices) == which))
            for line in range(DEPTH):
                c = _places(h[some], line, cells) // PLACES
                some = some[(sent.value[line][c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0]
            out = np.zeros(len(h), bool)
            out[some] = True
            return out

        def send() -> Iterator[pa.RecordBatch]:
            for lang, phrase, m, count in own.take():
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(count), m, np.int32)), pa.array(count)], names)

        for batch in batches:
            for text in read(batch.column(0), batch.column(1)):
                for lang, n in zip(text.langs, np.bincount(text.lang, minlength=len(text.langs)).tolist(), strict=True):
                    total[lang] = total.get(lang, 0) + n
                for _ in own.add(text, [possible(h, going) for h, going in text.hashes(max_words)]):
                    yield from send()
                    release()
            del batch  # before the next one comes
            release()
        yield from send()
        release()
        if which == 0:
            found = {lang.decode(): n for lang, n in total.items() if n}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([""] * len(found), pa.string()), pa.array(np.zeros(len(found), np.int32)), pa.array(list(found.values()), pa.int64())], names)

    return task


def _dealt(task):
    """Task: what task yields, rows of COUNTS, as pieces of buckets."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        buckets: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            bucket = np.concatenate([np.zeros(0, np.int32), *buckets])
            order = np.argsort(bucket, kind="stable")
            raw, offsets = flat(pa.concat_arrays([pa.array([], pa.string()), *ids]).take(pa.array(order)))
            n = np.concatenate([np.zeros(0, np.int64), *counts])[order]
            for x in (ids, counts, buckets):
                x.clear()
            bucket = bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            last = np.append(first[1:], len(bucket))[: len(first)]
            # Lengths and counts byte by byte, then the phrases.
            planes = np.empty((8, len(n)), np.uint8)
            planes[:4], planes[4:] = (x.astype("<u4").view(np.uint8).reshape(-1, 4).T for x in (np.diff(offsets), n))
            pieces = [planes[:, a:b].tobytes() + raw[offsets[a] : offsets[b]].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            columns = [bucket[first], (last - first).astype(np.int32), np.array(list(map(len, pieces)), np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([pa.compress(x, "zstd", asbytes=True) for x in pieces], pa.binary())], [x.split()[0] for x in PIECES.split(", ")])

        for lang, phrase, _, n in (b.columns for b in task(batches)):
            ids.append(pc.binary_join_element_wise(lang, phrase, "\t"))
            raw, offsets = flat(ids[-1])
            buckets.append((word_hashes(raw, offsets[:-1], offsets[1:]) % np.uint64(BUCKETS)).astype(np.int32))
            counts.append(n.to_numpy())
            if sum(map(len, buckets)) >= HELD // 2:
                yield from send()
                release()
        yield from send()
        release()

    return dealt


def _summed(min_count: int):
    """Task: pieces, sorted by bucket -> id, n of the phrases that occur min_count times or more, and of languages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held, known = None, [], 0, 0

        def summed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).group_by("id", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            return pa.record_batch([rows["id"].chunk(0), rows["n_sum"].chunk(0)], ["id", "n"])

        def done() -> pa.RecordBatch:
            rows = summed()
            return rows.filter(pc.or_(pc.greater_equal(rows["n"], min_count), pc.ends_with(rows["id"], "\t")))

        for batch in batches:
            for bucket, m, size, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != at:
                    if at is not None:
                        yield done()
                        release()
                    at, parts, held, known = bucket, [], 0, 0
                raw = pa.decompress(piece, size, "zstd")
                length, n = (np.frombuffer(raw[: 8 * m], np.uint8).reshape(2, 4, m)[i].T.copy().view("<u4")[:, 0] for i in (0, 1))
                bounds = np.append(0, np.cumsum(length)).astype(np.int32)
                ids = pa.Array.from_buffers(pa.string(), m, [None, pa.py_buffer(bounds), raw.slice(8 * m)])
                parts.append(pa.record_batch([ids, pa.array(n.astype(np.int64))], ["id", "n"]))
                held += m
                if held > HELD // 2 + 2 * known:
                    parts = [summed()]
                    held = known = len(parts[0])
        if at is not None:
            yield done()
            release()

    return task


def shape(occurrences: int, min_count: int) -> tuple[int, int]:
    """Cells of a row and slices of a sketch for so many occurrences: enough that few cells have a frequent phrase, and few slices."""
    wanted = max(LEAST_CELLS, occurrences * 10 // (LOAD * max(1, min_count)))
    bound = min(MOST_CELLS, SLICE_BYTES * 8 // DEPTH)
    slices = min(MAX_SLICES, -(-wanted * LOAD // (CROWDED * bound)))
    cells = LEAST_CELLS
    while cells < wanted / slices and 2 * cells <= bound:
        cells *= 2
    return cells, slices


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, size, n of all phrases of up to max_words words that occur min_count times or more, and, with phrase '', each language's words.

    The first scan adds up a count-min sketch of all phrases: each task sends the cells that it has touched, which are added block by block and
    end as one bit a cell: whether it reaches min_count. A cell counts every phrase that falls on it, so a frequent phrase never lacks a bit. The
    second scan counts, by the phrases themselves, only those that have all their bits; the rare ones among them are dropped then. What the
    sketch lets through costs time only: counts are exact at any size.
    """
    spark = docs.sparkSession
    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(F.coalesce(quote(text), F.lit("")).alias("text"), quote(lang).alias("lang"))
    # A word takes two bytes at least, with what ends it, and five or more in most languages.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, slices = shape(size // 5 * max_words, min_count)
    most = min(min_count, 65535)
    blocks = rows.mapInArrow(_sketches(max_words, cells, slices, most), SKETCH)
    bits = stored(blocks.repartition("slice", "line", "block").sortWithinPartitions("slice", "line", "block").mapInArrow(_added(most, cells // BLOCKS), "slice int, line int, block long, bits binary"), "phrases-sketch")
    out = None
    for s in range(slices):
        table = np.zeros((DEPTH, cells // 8), np.uint8)
        for r in bits.where(F.col("slice") == s).toLocalIterator():  # at most SLICE_BYTES
            at = r.block % BLOCKS * (cells // BLOCKS) // 8
            table[r.line, at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        own = rows.mapInArrow(_dealt(_survivors(max_words, cells, slices, s, spark.sparkContext.broadcast(table))), PIECES)
        out = own if out is None else out.unionByName(own)
    counted = out.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_summed(min_count), "id string, n long")
    # No phrase holds a tab, and no word a space.
    phrase = F.substring_index("id", "\t", -1)
    counted = counted.select(F.expr("left(id, length(id) - length(substring_index(id, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("size"), "n")
    return stored(counted, "phrases-frequent")


def _id(lang: Column, phrase: Column) -> Column:
    """A language and a phrase as one string: no phrase holds a tab."""
    return F.concat(lang, F.lit("\t"), phrase)


def _looked_up(rows: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """rows with value, the count of the phrase that key names. Phrases that a thousandth of all rows ask for are broadcast."""
    asked = rows.groupBy(key).agg(F.count("*").alias("asked"))
    total = asked.agg(F.sum("asked")).first()[0] or 0
    hot = asked.where(F.col("asked") > max(1, total // 1000)).withColumnRenamed(key, "hot_key")  # under 1000 rows
    counts = table.select(F.col("id").alias(key), F.col("n").alias(value))
    hot = counts.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left_semi")
    return spread(rows, counts, key, [value], hot)


def collocations(counts: DataFrame, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """Of the table of frequent(): lang, rank, phrase, a, l, r, n, score of each language's first phrases of two words or more.

    a is the phrase's count; each cut gives the counts l and r of its two parts and the score floor(1000000 a a / (l r)), and the lowest one counts
    (ties: the shortest first part). A phrase is dropped if a longer frequent one holds it and occurs subsumed percent as often or more. Ranked by
    score, a and phrase. Every part of a frequent phrase is frequent, so that all its counts are in the table.
    """
    table = counts.where("size > 0").select("lang", "phrase", "size", "n", _id(F.col("lang"), F.col("phrase")).alias("id"))
    phrases = table.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), "id", F.split("phrase", " ").alias("words"))
    inner = F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))
    longer = phrases.where("size > 2").select("lang", "a", F.explode(F.array_distinct(F.flatten(inner))).alias("part"))
    longer = longer.select(_id(F.col("lang"), F.col("part")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longest"))
    left = phrases.join(longer, "id", "left").where(F.col("longest").isNull() | (100 * F.col("longest") < subsumed * F.col("a")))
    cuts = left.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda first, n: _id(F.col("lang"), F.array_join(F.slice("words", first, n), " "))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.size("words")).alias("tail"))
    cuts = stored(cuts, "phrases-cuts")
    cuts = _looked_up(_looked_up(cuts, "head", table, "l"), "tail", table, "r")
    # Whole numbers of 38 digits: exact for counts under 10**15.
    whole = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    square = (whole["a"] * whole["a"] * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", square).withColumn("under", (whole["l"] * whole["r"]).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    words_ = counts.where("size = 0").select("lang", "n")
    return best.join(words_, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """The collocations of each language of docs.

    Texts have A-Z lower-cased and are cut at . , ; : ! ? and line breaks into pieces, these at spaces and tabs into words; phrases don't
    leave their piece, and occurrences may overlap. A null language counts as und, a null or empty text has no words, and a language without words
    has no row; a repeated row counts again; ties are ranked by phrase. Other columns, whatever their names, are not read.
    """
    return collocations(frequent(docs, text, lang, max_words, min_count), top, subsumed)
