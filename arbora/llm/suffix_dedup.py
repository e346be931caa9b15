"""Operator 5: removal of byte strings that repeat anywhere, by hash-compared suffix sorts.

A string of LENGTH bytes is represented by its anchor, the leftmost of its K-byte grams with the least hash, which depends on
the string alone: equal strings have equal anchors at equal offsets. Consecutive strings with one anchor are a run, and a
run's bytes are its context. Runs meet under their anchor's gram. There are three ways from there:

- A run whose whole context equals another's repeats entirely. Contexts are equal if the 128-bit BLAKE2b digests of their bytes are.
- The other runs that share a gram are compared by suffix sorts of what follows and what precedes the anchor: prefix polynomial
  hashes and binary search give the common extension of two suffixes in logarithmic time, a mergesort orders them, and the
  neighbours' common lengths are verified byte by byte. A string at offset o repeats if two runs agree on o bytes before and
  LENGTH - o bytes after the anchor.
- A gram with more than CROWD different contexts would be one large sort. Its strings are taken one by one instead: those that repeat
  within a task are found by two polynomial hashes and verified byte by byte, and one of each goes on, under the 128-bit BLAKE2b
  digest of its bytes, to meet those of other tasks. So a string that very many texts hold is a few rows for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mix, prefix_hash, span_hash, spread_join, steps, stored

LENGTH = 200
K = 32
#: A document is searched for anchors in pieces of at most so many strings; a run cut there is still compared exactly.
PIECE = 1 << 22
#: Runs of one gram with more different contexts than this are compared string by string instead, spread by their hashes.
CROWD = 256
TEXTS = "sha binary, n_bytes long, packed binary"
KEYS = "bucket int, base long, keys binary"
DEALT = "found boolean, bucket int, base long, keys binary"
MET = "kind int, gram long, id long, first int, before int, span int"
SPANS = "id long, start int, stop int"
CONTEXTS = "gram long, ask boolean, id long, first int, before int, context binary"
RESULT = "id long, n_removed long, n_spans long, kept_sha256 string"
FULL, ASK, PARTNER, CROWD_ASK, CROWD_PARTNER = range(5)
RUN = np.dtype([("gram", "<u8"), ("context", "<u8", 2), ("first", "<u4"), ("before", "u1"), ("span", "u1"), ("owner", "<u2")])
SPOT = np.dtype([("owner", "<i8"), ("start", "<u4")])
STRING = np.dtype([("digest", "<u8", 2), ("owner", "<i8"), ("start", "<u4"), ("ask", "<u4")])
_PLACE = np.uint64((1 << 24) - 1)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w neighbouring values, by minima from both ends of blocks of w."""
    n = len(values)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of raw[start:end], as pairs of numbers."""
    view = memoryview(np.ascontiguousarray(raw))
    found = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2).copy()


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a chunk of documents (RUN records, owner = row; first = byte place of its first string in the row)."""
    none = np.zeros(0, RUN)
    if len(raw) < LENGTH:
        return none
    w = LENGTH - K + 1
    prefix = prefix_hash(raw)
    at = np.arange(len(raw) - K + 1)
    gram = mix(span_hash(prefix, at, at + K))
    if len(gram) > int(_PLACE):
        raise ValueError("chunk too large")
    least = _least((gram & ~_PLACE) | at.astype(np.uint64), w)
    anchor = (least & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[: len(least)] == row[LENGTH - 1 : LENGTH - 1 + len(least)])
    if not len(start):
        return none
    a = anchor[start]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (row[start[1:]] != row[start[:-1]])))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    a = a[new]
    out = np.zeros(len(new), RUN)
    out["gram"] = mix(gram[a] + np.uint64(1))
    out["before"], out["span"] = a - first, last - first
    out["context"] = _digests(raw, first, last + LENGTH)
    # Contexts are equal only if their anchors and numbers of strings are, too.
    out["context"][:, 0] ^= mix((out["before"].astype(np.uint64) << np.uint64(8)) + out["span"])
    out["owner"], out["first"] = row[first], first - offsets[row[first]]
    return out


def _pieces(raw: np.ndarray, offsets: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """runs() of all rows, long rows in overlapping pieces."""
    for a, b in steps(offsets):
        lo, hi = offsets[a], offsets[b]
        if hi - lo <= piece:
            found = runs(raw[lo:hi], offsets[a : b + 1] - lo)
            found["owner"] += np.uint16(a)
            yield found
            continue
        if b - a > 1:  # several rows that are a step together, under a small piece
            for i in range(a, b):
                found = np.concatenate([*_pieces(raw, offsets[i : i + 2], piece), np.zeros(0, RUN)])
                found["owner"] += np.uint16(i)
                yield found
            continue
        for cut in range(lo, hi - LENGTH + 1, piece):
            part = raw[cut : min(hi, cut + piece + LENGTH - 1)]
            found = runs(part, np.array([0, len(part)]))
            found["owner"] += np.uint16(a)
            found["first"] += np.uint32(cut - lo)
            yield found


def _groups(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most 2048 rows whose ids fit in 16 bits above the first's."""
    a = 0
    while a < len(ids):
        near = (ids[a : a + 2048] >= ids[a]) & (ids[a : a + 2048] - ids[a] < 1 << 16)
        b = a + (len(near) if near.all() else int(np.argmin(near)))
        yield a, b
        a = b


def _unpack(column: pa.Array) -> pa.Array:
    loose = zstandard.ZstdDecompressor()
    return pa.array([loose.decompress(x) for x in column.to_pylist()], pa.large_binary())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [t.encode() for t in batch.column(0).to_pylist()]
        yield _batch(TEXTS, [hashlib.sha256(t).digest() for t in texts], [len(t) for t in texts], [squeeze.compress(t) for t in texts])


def _dealt(records: np.ndarray, bucket: np.ndarray, buckets: int, base: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    records = records[order]
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        yield _batch(KEYS, full, np.full(len(full), base), [records[edge[i] : edge[i + 1]].tobytes() for i in full])


def _index(buckets: int, piece: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in _groups(ids):
                raw, offsets = flat(_unpack(batch.column(1).slice(a, b - a)))
                found = np.concatenate([*_pieces(raw, offsets, piece), np.zeros(0, RUN)])
                found["owner"] = (ids[a:b] - ids[a])[found["owner"]]
                yield from _dealt(found, (found["gram"] >> np.uint64(32)).astype(np.int64) % buckets, buckets, int(ids[a]))

    return task


def _buckets(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Records and owners' ids of whole buckets, some at a time; buckets come one after another."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        records = [np.frombuffer(x, dtype) for _, _, x in held]
        return np.concatenate(records), np.concatenate([r["owner"].astype(np.int64) + base for r, (_, base, _) in zip(records, held, strict=True)])  # STRING: base 0

    for batch in batches:
        for bucket, base, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][0] != bucket and size > 1 << 19:
                yield joined()
                held, size = [], 0
            held.append((bucket, base, blob))
            size += len(blob) // dtype.itemsize
    if held:
        yield joined()


def _meet(crowd: int):
    """Runs that repeat entirely, and those to compare with others of their gram."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids in _buckets(batches, RUN):
            order = np.lexsort((r["context"][:, 1], r["context"][:, 0], r["gram"]))
            r, ids = r[order], ids[order]
            gram = np.append(True, r["gram"][1:] != r["gram"][:-1])
            context = gram | np.append(True, (r["context"][1:] != r["context"][:-1]).any(1))
            at = np.flatnonzero(context)
            copies = np.repeat(np.diff(np.append(at, len(r))), np.diff(np.append(at, len(r))))
            group = np.cumsum(gram) - 1
            different = np.bincount(group, context)[group]
            single = np.bincount(group, copies == 1)[group] > 0
            kind = np.full(len(r), -1)
            kind[copies > 1] = FULL
            asks = (copies == 1) & (different > 1)
            kind[asks] = np.where(different[asks] > crowd, CROWD_ASK, ASK)
            partner = context & (copies > 1) & (different > 1) & single
            for own, what in ((np.flatnonzero(kind >= 0), kind), (np.flatnonzero(partner), np.where(different > crowd, CROWD_PARTNER, PARTNER))):
                for i in range(0, len(own), 1 << 16):
                    k = own[i : i + (1 << 16)]
                    yield _batch(MET, what[k], r["gram"][k].view(np.int64), ids[k], r["first"][k].astype(np.int64), r["before"][k].astype(np.int64), r["span"][k].astype(np.int64))

    return task


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column; no row becomes a Python object."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values


def _asked(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """gram, first, before, span, kind of what each row asks for (see _request)."""
    offsets, values = _lists(column)
    gram, code = (values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        c = code[a:b]
        yield gram[a:b], c >> 20, (c >> 12) & 255, (c >> 4) & 255, c & 15


def _request():
    """A run's gram, and the rest of it as one number."""
    return F.struct("gram", (F.shiftleft(F.col("first").cast("long"), 20) + F.shiftleft("before", 12) + F.shiftleft("span", 4) + F.col("kind")).alias("code"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that a document's runs ask for."""
    loose = zstandard.ZstdDecompressor()
    for batch in batches:
        for id_, packed, (gram, first, before, span, kind) in zip(batch.column(0).to_pylist(), batch.column(1), _asked(batch.column(2)), strict=True):
            text = loose.decompress(packed.as_py())
            for i in range(0, len(gram), 4096):
                k = slice(i, i + 4096)
                contexts = [text[a : a + n + LENGTH] for a, n in zip(first[k].tolist(), span[k].tolist(), strict=True)]
                yield _batch(CONTEXTS, gram[k], kind[k] == ASK, np.full(len(contexts), id_), first[k], before[k], contexts)


def common_length(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common lengths, up to most, of the suffixes that start at x and y, by binary search over hashes."""
    lo, hi = np.zeros(len(x), np.int64), most.astype(np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_] + 1) >> 1
        u, v = x[open_], y[open_]
        same = span_hash(prefix, u, u + mid) == span_hash(prefix, v, v + mid)
        lo[open_] = np.where(same, mid, lo[open_])
        hi[open_] = np.where(same, hi[open_], mid - 1)
    return lo


def suffix_order(raw: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings raw[start : start + length] within their groups (which are contiguous), and each one's common
    length with the one before it in that order (0 for a group's first).

    A bottom-up mergesort of all groups at once: an element's place in the merged run is its own place plus its rank in the
    other run, found by binary search with common_length(). The common lengths of neighbours are then verified byte by
    byte; should a hash have lied, that group is sorted by its bytes instead.
    """
    n = len(start)
    prefix = prefix_hash(raw)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    base, count = np.repeat(first, size), np.repeat(size, size)
    order = np.arange(n)
    ends = np.append(raw, 0)

    def before(x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether string x comes before string y; equal strings as given."""
        most = np.minimum(length[x], length[y])
        c = common_length(prefix, start[x], start[y], most)
        over = c == most
        a, b = ends[start[x] + np.where(over, 0, c)], ends[start[y] + np.where(over, 0, c)]
        return np.where(over, np.where(length[x] == length[y], equal, length[x] < length[y]), a < b)

    width = 1
    while (active := np.flatnonzero(count > width)).size:
        local = active - base[active]
        run = local // width
        other = np.minimum((run ^ 1) * width, count[active])
        lo, hi = other.copy(), np.minimum(other + width, count[active])
        me = order[active]
        late = (run & 1).astype(bool)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            y = order[base[active[open_]] + mid]
            ahead = before(y, me[open_], late[open_])
            lo[open_] = np.where(ahead, mid + 1, lo[open_])
            hi[open_] = np.where(ahead, hi[open_], mid)
        place = base[active] + (run & ~1) * width + local % width + (lo - other)
        order[place] = me
        width *= 2
    lcp = np.zeros(n, np.int64)
    inner = np.flatnonzero(np.append(True, group[1:] != group[:-1]) == 0) if n else np.zeros(0, np.int64)
    x, y = order[inner - 1], order[inner]
    lcp[inner] = common_length(prefix, start[x], start[y], np.minimum(length[x], length[y]))
    # Verification, and the next byte must differ in the order's sense.
    for i in range(0, len(inner), 1 << 14):
        k = inner[i : i + (1 << 14)]
        if not len(k):
            break
        lane = np.arange(max(1, int(lcp[k].max())))
        u, v = order[k - 1], order[k]
        inside = lane < lcp[k][:, None]
        bad = (inside & (ends[np.minimum(start[u][:, None] + lane, len(raw))] != ends[np.minimum(start[v][:, None] + lane, len(raw))])).any(1)
        for g in np.unique(base[k[bad]]):
            own = np.arange(g, g + count[g])
            text = {j: raw[start[j] : start[j] + length[j]].tobytes() for j in own}
            order[own] = sorted(own, key=lambda j: (text[j], j))
            for j in own[1:]:
                s, t = text[order[j - 1]], text[order[j]]
                lcp[j] = next((c for c, (p, q) in enumerate(zip(s, t)) if p != q), min(len(s), len(t)))
    return order, lcp


def repeated(contexts: list[bytes], before: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each context (rows; groups are contiguous) and offset o up to LENGTH - K whether the string that starts o bytes
    before the anchor also stands in another context of its group."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    at = np.cumsum(size) - size + before
    after = size - before
    forward, ahead = suffix_order(raw, at, after, group)
    turned = raw[::-1].copy()
    backward, behind = suffix_order(turned, len(raw) - at, before, group)
    edge = np.append(True, group[1:] != group[:-1])
    out = np.zeros((len(contexts), LENGTH - K + 1), bool)
    left, right = np.empty(len(contexts), np.int64), np.empty(len(contexts), np.int64)
    for o in range(LENGTH - K + 1):
        own = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(own) < 2:
            continue
        left[backward] = np.cumsum(edge | (behind < o))
        right[forward] = np.cumsum(edge | (ahead < LENGTH - o))
        # A run holds all strings with its anchor, so an offset outside it belongs to another anchor.
        _, inverse, count = np.unique(left[own] * (len(contexts) + 1) + right[own], return_inverse=True, return_counts=True)
        out[own, o] = count[inverse] > 1
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram -> the repeated spans of those that ask."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, ask, ids, first, before, contexts = zip(*rows, strict=True)
        before = np.array(before)
        found = repeated(list(contexts), before, np.unique(np.array(gram), return_inverse=True)[1])
        found[~np.array(ask)] = False
        i, o = np.nonzero(found)
        if len(i):
            # Neighbouring offsets are neighbouring strings: one span for each stretch of them.
            new = np.append(True, (i[1:] != i[:-1]) | (o[1:] != o[:-1] + 1))
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(i)) - 1
            at = np.array(first)[i[lo]] + before[i[lo]]
            yield _batch(SPANS, np.array(ids)[i[lo]], at - o[hi], at - o[lo] + LENGTH)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= 4096 and row[0] != held[-1][0]:
                yield from flush(held)
                held = []
            held.append(row)
    if held:
        yield from flush(held)


def _same(a: np.ndarray, b: np.ndarray, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings raw[at : at + LENGTH] by their hashes a and b, and in that order, the place of the first string with the same bytes."""
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))[: len(order)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    windows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    for i in range(0, len(order), 1 << 14):
        k = slice(i, i + (1 << 14))
        lied = (windows[at[order[k]]] != windows[at[order[first[k]]]]).any(1)
        first[k][lied] = np.arange(i, i + len(lied))[lied]  # one that only looked equal stands for itself
    return order, first


def _strings(buckets: int):
    """The strings of the crowded runs: those that repeat within a task, dealt by their documents (found), and one of each, dealt by its digest."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            raws, ids, starts, asks, one, two = zip(*held, strict=True)
            held.clear()
            size = [len(x) for x in starts]
            raw, base = np.concatenate(raws), np.cumsum([0, *map(len, raws[:-1])])
            owner, start, ask = np.repeat(np.array(ids, np.int64), size), np.concatenate(starts), np.concatenate(asks)
            at = start + np.repeat(base, size)
            order, first = _same(np.concatenate(one), np.concatenate(two), raw, at)
            many = np.bincount(first, minlength=len(order))
            again = order[(many[first] > 1) & ask[order]]
            spots = np.zeros(len(again), SPOT)
            spots["owner"], spots["start"] = owner[again], start[again]
            yield from _flagged(True, _dealt(spots, _of_owner(spots["owner"], buckets), buckets, 0))
            lead = np.flatnonzero(many)
            kept = order[lead]
            out = np.zeros(len(kept), STRING)
            out["digest"] = _digests(raw, at[kept], at[kept] + LENGTH)
            out["owner"], out["start"], out["ask"] = owner[kept], start[kept], ask[kept] & (many[lead] == 1)
            yield from _flagged(False, _dealt(out, (out["digest"][:, 0] >> np.uint64(32)).astype(np.int64) % buckets, buckets, 0))

        for batch in batches:
            for id_, packed, (_, first, _, span, kind) in zip(batch.column(0).to_pylist(), batch.column(1), _asked(batch.column(2)), strict=True):
                raw = np.frombuffer(loose.decompress(packed.as_py()), np.uint8)
                count = span + 1
                at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                hashes = [span_hash(prefix_hash(view), at, at + LENGTH) for view in (raw, raw ^ np.uint8(0x5A))]
                held.append((raw, id_, at, np.repeat(kind == CROWD_ASK, count), *hashes))
                if sum(len(x[2]) for x in held) > 1 << 18 or sum(len(x[0]) for x in held) > 1 << 25:
                    yield from flush()
        if held:
            yield from flush()

    return task


def _of_owner(owner: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(owner.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % buckets


def _flagged(found: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([found] * batch.num_rows), *batch.columns], ["found", *batch.schema.names])


def _equal(buckets: int):
    """The crowded strings that repeat in another task, dealt by their documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            spots = np.concatenate(held)
            held.clear()
            yield from _dealt(spots, _of_owner(spots["owner"], buckets), buckets, 0)

        for r, ids in _buckets(batches, STRING):
            order = np.lexsort((r["digest"][:, 1], r["digest"][:, 0]))
            r, ids = r[order], ids[order]
            new = np.append(True, (r["digest"][1:] != r["digest"][:-1]).any(1))
            count = np.diff(np.append(np.flatnonzero(new), len(r)))
            k = np.flatnonzero((np.repeat(count, count) > 1) & (r["ask"] == 1))
            spots = np.zeros(len(k), SPOT)
            spots["owner"], spots["start"] = ids[k], r["start"][k]
            held.append(spots)
            if sum(map(len, held)) > 1 << 20:
                yield from flush()
        if held:
            yield from flush()

    return task


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One span for each stretch of repeating strings of a document that overlap or touch."""
    for r, ids in _buckets(batches, SPOT):
        start = r["start"].astype(np.int64)
        order = np.lexsort((start, ids))
        start, ids = start[order], ids[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + LENGTH))[: len(ids)]
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(ids)) - 1
        for i in range(0, len(lo), 1 << 16):
            k = slice(i, i + (1 << 16))
            yield _batch(SPANS, ids[lo[k]], start[lo[k]], start[hi[k]] + LENGTH)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loose = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        offsets, values = _lists(batch.column(2))
        codes = values.to_numpy(zero_copy_only=False)
        low = (1 << 32) - 1
        for i, (id_, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            raw = np.frombuffer(loose.decompress(packed.as_py()), np.uint8)
            start, size = codes[offsets[i] : offsets[i + 1]] >> 32, codes[offsets[i] : offsets[i + 1]] & low
            step = np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + size, minlength=len(raw) + 1)
            gone = np.cumsum(step[:-1]) > 0
            rows.append((id_, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        if rows:
            yield _batch(RESULT, *zip(*rows, strict=True))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """id, sha, n_bytes, copies and packed text of each distinct text. Copies meet before the shuffle."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_packed, TEXTS)
    once = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("packed").alias("packed"))
    return stored(once.withColumn("id", F.monotonically_increasing_id()), "suffix-texts")


def spans(texts: DataFrame, crowd: int = CROWD, piece: int = PIECE) -> DataFrame:
    """The repeated spans (id, start, stop; they may overlap) of distinct texts of LENGTH bytes or more. Stored tables only."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long_ = texts.where(F.col("n_bytes") >= LENGTH)

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(parts, F.expr(f"bucket % {parts}")).sortWithinPartitions("bucket")

    keys = long_.select("id", "packed").mapInArrow(_index(2 * parts, piece), KEYS)
    met = stored(by_bucket(keys).mapInArrow(_meet(crowd), MET), "suffix-met")
    full = met.where(F.col("kind") == FULL).select("id", F.col("first").alias("start"), (F.col("first") + F.col("span") + LENGTH).alias("stop"))

    def asked(kinds: list[int]) -> DataFrame:
        rows = met.where(F.col("kind").isin(kinds)).groupBy("id").agg(F.collect_list(_request()).alias("asked"))
        return long_.select("id", "packed").join(rows.hint("merge"), "id").select("id", "packed", "asked")

    contexts = asked([ASK, PARTNER]).mapInArrow(_cut, CONTEXTS)
    some = contexts.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_compare, SPANS)
    out = full.unionByName(stored(some, "suffix-spans"))
    if met.where(F.col("kind") == CROWD_ASK).isEmpty():
        return out
    strings = stored(asked([CROWD_ASK, CROWD_PARTNER]).mapInArrow(_strings(2 * parts), DEALT), "suffix-strings")
    met_again = by_bucket(strings.where("NOT found").drop("found")).mapInArrow(_equal(2 * parts), KEYS)
    crowded = by_bucket(strings.where("found").drop("found").unionByName(met_again)).mapInArrow(_joined, SPANS)
    return out.unionByName(stored(crowded, "suffix-crowd"))


def remove_repeats(docs: DataFrame, crowd: int = CROWD, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text).

    Removed is each byte that a string of LENGTH bytes covers which also starts elsewhere, in any row or the same one.
    Texts are UTF-8 bytes; null and shorter texts lose nothing. A text of LENGTH bytes or more that several rows hold
    (repeated rows too) is removed whole. Null ids are kept as they are. An empty table gives an empty one; other columns are
    not read.
    """
    texts = distinct_texts(docs)
    long_ = F.col("n_bytes") >= LENGTH
    # A span is one number: its start and its length. A document's spans are as many as its strings at most.
    code = F.shiftleft(F.col("start").cast("long"), 32) + (F.col("stop") - F.col("start"))
    alone = spans(texts, crowd, piece).select("id", code.alias("span")).groupBy("id").agg(F.collect_list("span").alias("spans"))
    cut = texts.where(long_ & (F.col("copies") == 1)).select("id", "packed").join(alone.hint("merge"), "id").select("id", "packed", "spans").mapInArrow(_removed, RESULT)
    whole = long_ & (F.col("copies") > 1)
    found = texts.select("id", "sha", "n_bytes", "copies").join(cut.hint("merge"), "id", "left").select(
        "sha", "copies",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha"))
    # Rows of a text that very many rows hold do not meet in one task.
    values = ["n_removed", "n_spans", "kept_sha256"]
    return spread_join(rows, stored(found, "suffix-found"), "sha", "copies", values).select("doc_id", "n_bytes", *values)
