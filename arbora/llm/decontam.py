"""Operator 8: benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD, flat, mix, set_aside, shingle_hashes, steps, word_hashes, words

#: A span of words matches an item if it is within this share of the item's words in edits: replaced, dropped or added.
MAX_EDITS = 0.2
#: Items of fewer words are allowed no edit: they match where their word sequence stands unchanged.
MIN_WORDS = math.ceil(1 / MAX_EDITS)
#: Random walks, tables of each, sampled symbols in a table. tests/llm hold their recall at the largest edit distance, and the README
#: gives it.
WALKS, TABLES, SAMPLED = 4, 8, 3
#: Bytes of benchmark text that are sent to the executors at once; a larger benchmark is taken in as many passes as it needs.
BLOCK_BYTES = 16 << 20
FOUND = "doc_id long, item_id long, start_word int, n_words int, edits int, start_byte int, end_byte int"
_PAD = np.uint64(0x0BADC0DE0BADC0DE)


def _walk_seeds(steps_: int, walk: int) -> np.ndarray:
    return mix(np.arange(steps_, dtype=np.uint64) + np.uint64((walk + 1) << 32)) | np.uint64(1)


def cgk_keys(windows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LSH keys (one row for each window, WALKS * TABLES columns) of windows x n tokens, of which the first length count.

    The walk emits 3 n symbols: at step j the current token (a pad beyond the end), and then moves on or not by a random
    bit of that token and j, so that equal tails fall into step again after an edit. A table's key hashes the symbols at
    SAMPLED random steps.
    """
    k, n = windows.shape
    total, lane = 3 * n, np.arange(k)
    keys = np.zeros((WALKS * TABLES, k), np.uint64)
    for walk in range(WALKS):
        odd = _walk_seeds(total, walk)
        rng = np.random.Generator(np.random.PCG64(1000 * n + walk))
        at_step: list[list[int]] = [[] for _ in range(total)]
        for t in range(TABLES):
            for j in rng.choice(total, min(SAMPLED, total), replace=False):
                at_step[j].append(walk * TABLES + t)
        last = max((j for j in range(total) if at_step[j]), default=-1)
        i = np.zeros(k, np.int64)
        for j in range(last + 1):
            on = i < length
            symbol = np.where(on, windows[lane, np.minimum(i, n - 1)], _PAD)
            for t in at_step[j]:
                keys[t] = mix(keys[t] + symbol + np.uint64(j))
            i += on & ((symbol * odd[j]) >> np.uint64(63)).astype(bool)
    return keys.T


def edit_distance(a: np.ndarray, b: np.ndarray, b_length: np.ndarray, most: int) -> np.ndarray:
    """Levenshtein distances of rows of tokens: a (k x n) and b (k x m, of which the first b_length count); above most, most + 1.

    Only the band of the table within most of its diagonal is filled: elsewhere the distance is larger.
    """
    k, n = a.shape
    far = most + 1
    width = 2 * most + 1
    lane = np.arange(width, dtype=np.int16)
    # Column d of row i stands for j = i + d - most; b is padded so that the band never leaves it.
    padded = np.zeros((k, n + width), np.uint64)
    m = min(b.shape[1], n + most)
    padded[:, most : most + m] = b[:, :m]
    row = np.full((k, width), far, np.int16)
    row[:, most:] = lane[: most + 1]
    for i in range(1, n + 1):
        new = row + (padded[:, i - 1 : i - 1 + width] != a[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        if i <= most:
            new[:, : most - i] = far
            new[:, most - i] = i
        row = np.minimum(np.minimum.accumulate(new - lane, axis=1) + lane, far)
    d = b_length - n + most
    return np.where((d >= 0) & (d < width), row[np.arange(k), np.clip(d, 0, width - 1)], far).astype(np.int32) if k else np.zeros(0, np.int32)


def best_spans(a: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the span of each row of b (k x m, of which the first b_length count) that is closest to the
    same row of a (k x n): the first such start, and then the length nearest to n. Spans of any length are considered.
    """
    (k, n), m = a.shape, b.shape[1]
    # A cell holds the edits times one, a number beyond every place, plus the first start that reaches it with so few.
    one = 1 << int(m).bit_length()
    kind = np.int32 if (n + m + 1) * one < 1 << 31 else np.int64
    lane = np.arange(m + 1, dtype=kind)
    row = np.tile(lane, (k, 1))
    for i in range(n):
        new = row + kind(one)
        np.minimum(new[:, 1:], row[:, :-1] + (b != a[:, i : i + 1]) * kind(one), out=new[:, 1:])
        new -= lane * kind(one)
        np.minimum.accumulate(new, axis=1, out=new)
        new += lane * kind(one)
        row = new
    row[lane > b_length[:, None]] = np.iinfo(kind).max
    least = row.min(axis=1, keepdims=True)
    edits, start = (least // one).ravel(), (least % one).ravel()
    off_n = np.where(row == least, np.abs(lane - start[:, None] - n), n + m + 1)
    return edits.astype(np.int64), start.astype(np.int64), off_n.argmin(axis=1)


@dataclass
class Items:
    """A block of benchmark items, ready to be looked up."""

    ids: np.ndarray
    tokens: list[np.ndarray]
    lengths: list[int] = field(default_factory=list)
    grams: np.ndarray | None = None
    masks: np.ndarray | None = None
    bitmap: np.ndarray | None = None
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: Of items under MIN_WORDS, by length: the hashes of their sequences, ascending, and which items they are.
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lengths = sorted({len(t) for t in self.tokens if len(t) >= MIN_WORDS})
        for n in sorted({len(t) for t in self.tokens if len(t) < MIN_WORDS}):
            own = np.array([i for i, t in enumerate(self.tokens) if len(t) == n])
            keys = np.concatenate([shingle_hashes(self.tokens[i], n) for i in own])
            order = np.argsort(keys, kind="stable")
            self.short[n] = keys[order], own[order]
        pairs: dict[int, int] = {}
        for t in self.tokens:
            if len(t) < MIN_WORDS:
                continue
            for g in shingle_hashes(t, 2).tolist():
                pairs[g] = pairs.get(g, 0) | 1 << (self.lengths.index(len(t)) % 64)
        self.grams = np.array(sorted(pairs), np.uint64)
        self.masks = np.array([pairs[g] for g in self.grams.tolist()], np.uint64)
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        for n in self.lengths:
            own = np.array([i for i, t in enumerate(self.tokens) if len(t) == n])
            stack = np.concatenate([self.tokens[i] for i in own])
            # Each item's own pairs of words: the pair and the item's place in own, ascending.
            of = np.repeat(np.arange(len(own)), n - 1)
            pair = np.concatenate([shingle_hashes(self.tokens[i], 2) for i in own])
            fresh = np.unique(np.stack([pair, of.astype(np.uint64)]), axis=1)
            self.by_length[n] = own, cgk_keys(stack.reshape(-1, n), np.full(len(own), n)), fresh[0], fresh[1].astype(np.int64)


def allowed(n: int) -> int:
    return math.floor(MAX_EDITS * n)


def needed(n: int) -> int:
    """Pairs of neighbouring words that a span shares with an item of n words within the allowed edits: each edit spoils two at most."""
    return max(1, n - 1 - 2 * allowed(n))


def prepare(rows: list[tuple[int, str]]) -> Items | None:
    raw, offsets = flat(pa.array([t for _, t in rows], pa.string()))
    start, end, place = words(raw, offsets, WORD)
    h = word_hashes(LOWER[raw], start, end)
    kept = [(i, h[place[k] : place[k + 1]]) for k, (i, _) in enumerate(rows) if place[k + 1] > place[k]]
    return Items(np.array([i for i, _ in kept]), [t for _, t in kept]) if kept else None


def _windows(items: Items, g: np.ndarray, h_end: np.ndarray):
    """(length, starts) where a span of that length and the allowed edits shares enough pairs of words with the items of that
    length. g: hash of the pair at each place, 0 where it would cross documents; h_end: where each place's document ends.
    Nothing within the allowed edits is lost: a span has allowed(n) words more than the item at most."""
    hit = items.bitmap[(g >> np.uint64(42)).astype(np.int64)]
    at = np.flatnonzero(hit)
    if not len(at):
        return
    slot = np.minimum(np.searchsorted(items.grams, g[at]), len(items.grams) - 1)
    true = items.grams[slot] == g[at]
    at, mask = at[true], items.masks[slot[true]]
    longest, least = items.lengths[-1] + allowed(items.lengths[-1]), min(map(needed, items.lengths))
    # Places from which a span of the greatest length holds enough pairs of any item; only these are looked at further.
    near = np.zeros(len(g) + 1, bool)
    if len(at) < least:
        return
    dense = at[: len(at) - least + 1][at[least - 1 :] - at[: len(at) - least + 1] < longest]
    edge = np.zeros(len(g) + longest + 2, np.int32)
    np.add.at(edge, np.maximum(dense - longest, 0), 1)
    np.add.at(edge, dense + 1, -1)
    near = np.flatnonzero(np.cumsum(edge)[: len(g)] > 0)
    if not len(near):
        return
    for c, n in enumerate(items.lengths):
        own = at[(mask >> np.uint64(c % 64)) & np.uint64(1) == 1]
        if len(own) < needed(n):
            continue
        last = np.minimum(near + n + allowed(n), h_end[near])
        room = last - near >= n - allowed(n)
        count = np.searchsorted(own, last - 1) - np.searchsorted(own, near)
        good = near[room & (count >= needed(n))]
        if len(good):
            yield n, good


def _equal(items: Items, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(words, row, item, place) where the word sequence of an item under MIN_WORDS stands."""
    for n, (keys, own) in items.short.items():
        g = shingle_hashes(h, n)
        at = np.flatnonzero(row[: len(g)] == row[n - 1 : n - 1 + len(g)])
        lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
        for p, x, y in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for k in own[x:y].tolist():
                if (items.tokens[k] == h[p : p + n]).all():
                    yield n, int(row[p]), k, p


def _search(items: Items, column: pa.Array, ids: list, exact: bool = False) -> list[tuple]:
    raw, offsets = flat(column)
    # Windows are gathered by length over all rows of the batch, and then embedded and verified together.
    gathered: dict[int, list[tuple]] = {}
    best: dict[tuple[int, int], tuple] = {}
    for a, b in steps(offsets):
        part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, place = words(part, off, WORD)
        if not len(start):
            continue
        h = word_hashes(LOWER[part], start, end)
        row = np.repeat(np.arange(b - a), np.diff(place))
        for n, r, k, s in _equal(items, h, row):
            best.setdefault((r + a, k), (0, s - int(place[r]), 0, n))  # places ascend, so the first counts
        if not items.lengths or len(h) < 2:
            continue
        g = shingle_hashes(h, 2)
        g[row[1:] != row[:-1]] = 0
        h_end = place[1:][row]
        for n, at in _windows(items, g, h_end):
            length = np.minimum(n, h_end[at] - at)
            tokens = h[np.minimum(at[:, None] + np.arange(n), len(h) - 1)]
            # Windows that start within the same allowed(n) + 1 words share a stretch, which holds every span that starts or
            # ends within the allowed edits of one of them.
            e, r = allowed(n), row[at]
            piece = (at - place[r]) // (e + 1)
            fresh = np.ones(len(at), bool)
            fresh[1:] = (r[1:] != r[:-1]) | (piece[1:] != piece[:-1])
            r, piece = r[fresh], piece[fresh] * (e + 1) + place[r[fresh]]
            lo, hi = np.maximum(piece - e, place[r]), np.minimum(piece + n + 2 * e, place[r + 1])
            stretch = h[np.minimum(lo[:, None] + np.arange(n + 3 * e), len(h) - 1)]
            inner = lo[:, None] + np.arange(n + 3 * e - 1)
            pairs = np.where(inner < hi[:, None] - 1, g[np.minimum(inner, len(g) - 1)], 0)
            gathered.setdefault(n, []).append((tokens, length, fresh, stretch, pairs, hi - lo, r + a, lo - place[r]))
    for n, parts in gathered.items():
        tokens, length, fresh, stretch, pairs, width, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, item_keys, item_pairs, of = items.by_length[n]
        met = _met(cgk_keys(tokens, length), item_keys, np.cumsum(fresh) - 1)
        if exact:
            met = np.union1d(met, _sharing(pairs, item_pairs, of, len(own), needed(n)))
        mine = np.stack([items.tokens[x] for x in own])
        for some in np.array_split(met, len(met) * stretch.shape[1] // (1 << 19) + 1):
            w, k = some // len(own), some % len(own)
            d, first, last = best_spans(mine[k], stretch[w], width[w])
            for x in np.flatnonzero(d <= allowed(n)):
                key, s = (int(row[w[x]]), int(own[k[x]])), int(place[w[x]])
                m = int(last[x] - first[x])
                best[key] = min(best.get(key, (1 << 30,)), (int(d[x]), s + int(first[x]), abs(m - n), m))
    out, seen = [], -1
    for (r, k), (d, s, _, m) in sorted(best.items()):
        if r != seen:
            (start, end, _), seen = words(raw[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]), WORD), r
        out.append((ids[r], items.ids[k], s, m, d, int(start[s]), int(end[s + m - 1])))
    return out


def _met(keys: np.ndarray, item_keys: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Pairs (stretch * items + item, ascending) of which a window of the stretch and the item have a key in common."""
    met = []
    for t in range(keys.shape[1]):
        order = np.argsort(item_keys[:, t], kind="stable")
        lo, hi = (np.searchsorted(item_keys[order, t], keys[:, t], side) for side in ("left", "right"))
        reps = hi - lo
        k = order[np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(lo, reps)]
        met.append(np.unique(np.repeat(stretch, reps) * len(item_keys) + k))
    return np.unique(np.concatenate(met))


def _sharing(pairs: np.ndarray, item_pairs: np.ndarray, of: np.ndarray, n_items: int, least: int) -> np.ndarray:
    """Pairs (stretch * items + item, ascending) that share at least least pairs of words: none within the allowed edits shares fewer."""
    out = [np.zeros(0, np.int64)]
    size = max(1, (1 << 19) // pairs.shape[1])
    for a in range(0, len(pairs), size):
        some = pairs[a : a + size].ravel()
        lo = np.searchsorted(item_pairs, some, "left")
        hit = np.flatnonzero(item_pairs[np.minimum(lo, len(item_pairs) - 1)] == some)
        lo = lo[hit]
        reps = np.searchsorted(item_pairs, some[hit], "right") - lo
        k = of[np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(lo, reps)]
        both, count = np.unique(np.repeat(hit // pairs.shape[1] + a, reps) * n_items + k, return_counts=True)
        out.append(both[count >= least])
    return np.concatenate(out)


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, exact: bool = False) -> DataFrame:
    """The benchmark items that stand in a document: doc_id, item_id, start_word, n_words, edits, start_byte, end_byte.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. Item-sized windows from
    every word of every whole text are considered; those where a span of the item's length and the allowed edits shares too
    few pairs of neighbouring words with the items of that length are left out, as no span from there can be within the
    allowed edits; the others are embedded (CGK) and looked up in the tables of sampled symbols. Where one meets an
    item there, all spans around it, shorter and longer ones too, are verified by edit distance. One row for each document row and
    item, its closest and then first span. The tables are many enough to find 99 of 100 spans at the largest edit distance of any item, and nearly
    all closer ones; with exact, all that shares enough pairs of words with an item is verified too, which adds those that they miss. Items
    of under MIN_WORDS words, which allow no edit, are found where their word sequence stands. Null and empty texts and items, and items with a null item_id, find nothing; repeated rows
    are each reported. The benchmark is measured first and sent out in blocks of bounded size.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for sent in _blocks(docs.sparkSession, benchmark, block_bytes):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _search(sent.value, batch.column(1), batch.column(0).to_pylist(), exact)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.int64()] * 2 + [pa.int32()] * 5, strict=True)], [x.split()[0] for x in FOUND.split(", ")]
                    )

        one = rows.mapInArrow(search, FOUND)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def mark(docs: DataFrame, benchmark: DataFrame, column: str = "n_leaks", block_bytes: int = BLOCK_BYTES, exact: bool = False) -> DataFrame:
    """docs with the number of benchmark items in each row, found as find() does; rows keep their places and nothing is shuffled.

    Items with a null item_id, which find() can't report, are counted too.
    """
    docs, back = set_aside(docs, ["text"], [column])
    out = docs.withColumn(column, F.lit(0))
    for sent in _blocks(docs.sparkSession, benchmark, block_bytes, unnamed=True):

        def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _search(sent.value, batch.column(batch.schema.get_field_index("text")), list(range(batch.num_rows)), exact)
                total = np.bincount([r[0] for r in found], minlength=batch.num_rows) + batch.column(batch.num_columns - 1).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.int32())], batch.schema.names)

        out = out.mapInArrow(add, out.schema)
    return back(out)


def _blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int, unnamed: bool = False):
    """The benchmark as broadcast blocks of bounded size; with unnamed, items with a null item_id are among them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    if not unnamed:
        items = items.where("item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(1.5 * size / block_bytes)) if size > block_bytes else 1
    for p in range(passes):
        block = prepare([(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()])
        if block is not None:
            yield spark.sparkContext.broadcast(block)
