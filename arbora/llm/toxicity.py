"""Operator 7: toxicity by multiple-instance learning; a document is a bag of sentences joined by noisy-or."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, WORD, flat, mix, prefix_hash, set_aside, span_hash, steps, stored, words

#: Hashed features (the model is a table of this many numbers, whatever the corpus): words, and their first so many bytes.
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
#: At most so many labelled documents, and bytes of their texts, train the model: those with the smallest hashes of their ids.
MAX_TRAIN = 6000
MAX_BYTES = 48 << 20
#: Sentences from this score on are located.
THRESHOLD = 0.5
#: A feature counts from this many training documents on.
LEAST_DOCS = 4
EPOCHS, RATE, START = 200, 0.1, -7.0
#: Strength of the Gaussian prior on the weights, against the sum over training documents: the fewer, the more it tells.
PRIOR = 0.2
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # line feed ! . ?
SCORED = "score double, n_sentences int, worst_score double, worst_start int, worst_end int, located array<struct<score:double,start:int,end:int>>"


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _bags(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features and their sentences (numbered over all rows), sentences' rows, words' byte places and sentences. Sentences end at . ! ? or a line feed."""
    start, end, place = words(raw, offsets, WORD)
    prefix = prefix_hash(LOWER[raw])
    hashed = [span_hash(prefix, start, end)]
    hashed += [span_hash(prefix, start, np.minimum(start + k, end)) + np.uint64(k) for k in PREFIXES]
    feature = (mix(np.stack(hashed, 1)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    held = np.concatenate([np.ones((len(start), 1), bool), (end - start)[:, None] > np.array(PREFIXES)], 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(place))
    stops = np.cumsum(_STOP[raw], dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
    at = stops[start] if len(start) else np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    return feature[held], np.repeat(sentence, held.sum(1)), row[new], np.stack([start, end]), sentence


def _sentence_logits(model: Model, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return model.bias + np.bincount(sentence, model.weights[feature], n)


def _log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0, z)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Full-batch Adam on the noisy-or likelihood of the documents' labels. Deterministic."""
    raw, offsets = flat(pa.array(texts, pa.string()))
    n = len(texts)

    def bags():
        for a, b in steps(offsets):
            feature, sentence, row, _, _ = _bags(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield feature, sentence, row + a

    seen = np.zeros(BUCKETS, np.int64)
    for feature, sentence, row in bags():
        seen += np.bincount(np.unique(feature * n + row[sentence]) // n, minlength=BUCKETS)
    used = np.flatnonzero(seen >= LEAST_DOCS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    # A chunk's features, by sentence, and each sentence's number of them; chunks are never joined, so memory stays at 4 bytes a feature.
    parts, rows = [], []
    for feature, sentence, row in bags():
        at = place[feature]
        parts.append((at[at >= 0], np.bincount(sentence[at >= 0], minlength=len(row)).astype(np.int32)))
        rows.append(row)
    if not parts:
        return Model(np.zeros(BUCKETS), START)
    row = np.concatenate(rows)
    first = np.cumsum([0, *(len(count) for _, count in parts)])
    y = np.asarray(labels, float)
    w, b = np.zeros(len(used)), START
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, epochs + 1):
        z = np.full(len(row), b)
        for (feature, count), lo in zip(parts, first, strict=False):
            z[lo : lo + len(count)] += np.bincount(np.repeat(np.arange(len(count)), count), w[feature], len(count))
        p = np.exp(-np.logaddexp(0, -z))
        clean = np.bincount(row, _log_clean(z), n)
        q = np.exp(clean)
        # d loss / d z: p for clean documents, -p q / (1 - q) for toxic ones.
        pull = np.where(y > 0, -q / np.maximum(1 - q, 1e-9), 1.0)
        g = p * pull[row] / max(n, 1)
        grad = np.append(sum((np.bincount(feature, np.repeat(g[lo : lo + len(count)], count), len(used)) for (feature, count), lo in zip(parts, first, strict=False)), PRIOR / max(n, 1) * w), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Model(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """Learns from labelled documents whose crc32 of the id, modulo 5, is not 0: at most max_train in the order of a hash of their ids, of
    which a text that doesn't fit into what is left of max_bytes is passed over, and the next ones are not.

    Null ids and null labels are left out; of several labels of one id the largest counts, of several texts the first by
    code point. With no labelled row the model calls everything clean; where there are some, but max_bytes
    holds none of their texts, it raises.
    """
    own = F.crc32(F.col("doc_id").cast("string"))
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(own % 5 != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = stored(rows, "toxicity-sample")
    order, taken, left = (F.xxhash64("doc_id"), F.col("doc_id")), [], max_bytes
    for r in rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(*order).collect():  # at most max_train numbers
        if r.n <= left:
            taken.append((r.doc_id,))
            left -= r.n
    if not taken and not rows.isEmpty():
        raise ValueError(f"no labelled text fits into {max_bytes} bytes")
    picked = docs.sparkSession.createDataFrame(taken, StructType([rows.schema["doc_id"]]))
    sample = rows.join(F.broadcast(picked), "doc_id", "left_semi").orderBy(*order).collect()  # at most max_bytes
    return train([r.text for r in sample], [int(r.toxic) for r in sample])


def _score(model: Model, column: pa.Array, threshold: float) -> list[np.ndarray]:
    """For each row: score, number of sentences, the worst sentence's score, start and end (UTF-8 bytes; 0, 0 if there is none), and
    how many sentences reach the threshold; then these sentences' scores, starts and ends."""
    raw, offsets = flat(column)
    parts, spots = [], []
    for a, b in steps(offsets):
        base = offsets[a]
        part, off = raw[base : offsets[b]], offsets[a : b + 1] - base
        feature, sentence, row, span, of_word = _bags(part, off)
        n, k = b - a, len(row)
        z = _sentence_logits(model, feature, sentence, k)
        score = -np.expm1(np.bincount(row, _log_clean(z), n))
        count = np.bincount(row, minlength=n)
        worst, first, last, many = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if k:
            order = np.lexsort((-np.arange(k), z, row))
            top = order[np.append(row[order][1:] != row[order][:-1], True)]
            begin = np.flatnonzero(np.append(True, of_word[1:] != of_word[:-1]))
            finish = np.append(begin[1:], len(of_word)) - 1
            p, start, end = np.exp(-np.logaddexp(0, -z)), span[0][begin] - off[row], span[1][finish] - off[row]
            r = row[top]
            worst[r], first[r], last[r] = p[top], start[top], end[top]
            bad = np.flatnonzero(p >= threshold)
            many = np.bincount(row[bad], minlength=n)
            spots.append((p[bad], start[bad], end[bad]))
        parts.append((score, count, worst, first, last, many))
    found = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 6
    return [*found, *([np.concatenate(x) for x in zip(*spots, strict=True)] if spots else [np.zeros(0)] * 3)]


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (noisy-or of its sentences), n_sentences, worst_score, the worst sentence's worst_start and worst_end, and
    located: score, start and end of every sentence whose own score reaches the threshold, in order. Places are UTF-8 bytes.

    Only the text is an input. Null and empty texts have no sentence and score 0. The model has a fixed size and is sent
    to the executors once. Columns of docs named like the new ones are replaced, all others are kept.
    """
    new = [x.split()[0] for x in SCORED.split(", ")]
    docs, back = set_aside(docs, [text], new)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, types = docs.columns.index(text), [pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *plain, many, p, start, end = _score(sent.value, batch.column(at), threshold)
            columns = [pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(plain, types, strict=True)]
            spots = pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["score", "start", "end"])
            located = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), spots)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, located], [*batch.schema.names, *new])

    return back(docs.mapInArrow(add, StructType([*docs.schema, *StructType.fromDDL(SCORED)])))
