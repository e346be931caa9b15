"""Collocations against plain counting."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counted(rows, longest):
    """Occurrences of phrases by language, and words by language."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return f, n


def brute(rows, longest, least, top):
    f, n = counted(rows, longest)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= 50 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in cand.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in sorted(out.items()) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(6)
    vocabulary = ["the", "The", "of", "é", "É", " ", "ab-c", "x"] + [f"w{i}" for i in range(12)]
    out = []
    for i in range(160):
        words = []
        for _ in range(draw.randint(0, 60)):
            words += draw.choice([["new", "york", "city"], ["new", "york"], ["the", "end"], [draw.choice(vocabulary)], [draw.choice(vocabulary)], [f"rare{draw.randrange(9999)}"]])
        text = "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", "\x0b"]) for w in words)
        out.append((i, text, draw.choice(["en", "en", "en", "de", None, "und", "a\tb", "a"])))
    return out + out[:9] + [(1, None, "en"), (2, "", "en"), (3, " .,\n", "xx"), (4, "a a a a a a a a a a a a", "one"), (5, "b " * 30000, "long")]


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (2, 3, 5), (4, 5, 50), (3, 300, 10)])
def test_mine(spark, rows, longest, least, top):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs = docs.withColumns({c: F.lit(1) for c in ("phrase", "Size", "n", "id", "a.b", "A", "score", "slice")})
    assert found(phrases.mine(docs, max_words=longest, min_count=least, top=top)) == brute(rows, longest, least, top)


def test_small_tables_slices_and_flushes_change_nothing(spark, rows, monkeypatch):
    """A sketch too full to tell anything, cut into slices, and tasks that send at every turn still give exact counts."""
    rows = [*rows, (0, " ".join(f"v{i}" for i in range(9000)), "en")]
    monkeypatch.setattr(phrases, "shape", lambda occurrences, least: (1 << 16, 3))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # With six words a code has 10 bits, so that vocabularies are forgotten all the time.
    assert found(phrases.mine(docs, max_words=6, min_count=10, top=30)) == brute(rows, 6, 10, 30)


def test_sketch_never_lacks_a_frequent_phrase(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.lang, r.phrase): r.n for r in phrases.frequent(docs, min_count=2).where("size > 0").collect()}
    f, _ = counted(rows, 3)
    assert got == {(g, " ".join(w)): n for (g, w), n in f.items() if n >= 2}


def test_sketch_drops_most_rare_phrases(spark):
    """What the second scan counts is little more than what is frequent."""
    draw = random.Random(1)
    texts = [" ".join(f"r{draw.randrange(10**9)}" for _ in range(2000)) + " same words here" for _ in range(40)]
    own = phrases.Counter(3)
    cells, slices = phrases.shape(3 * 40 * 2003, 10)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 40)], ["text", "lang"])
    blocks = [r for b in phrases._sketches(3, cells, slices, 10)(iter([batch])) for r in b.to_pylist()]
    table = np.zeros((phrases.DEPTH, cells // 8), np.uint8)
    for b in phrases._added(10, cells // phrases.BLOCKS)(iter([pa.RecordBatch.from_pylist(sorted(blocks, key=lambda r: (r["slice"], r["line"], r["block"])))])):
        for r in b.to_pylist():
            at = r["block"] * (cells // phrases.BLOCKS) // 8
            table[r["line"], at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    sent = type("Sent", (), {"value": table})
    kept = [r for b in phrases._survivors(3, cells, slices, 0, sent)(iter([batch])) for r in b.to_pylist() if r["size"]]
    names = {r["phrase"] for r in kept}
    assert names >= {"same", "words", "here", "same words", "words here", "same words here"} and len(kept) < 400
    assert own.bits == 21


def test_products_past_64_bits(spark):
    counts = [("en", "", 0, 10**14), ("en", "a", 1, 9 * 10**12), ("en", "b", 1, 7 * 10**12), ("en", "a b", 2, 5 * 10**12 + 1)]
    got = phrases.collocations(spark.createDataFrame(counts, "lang string, phrase string, size int, n long")).collect()
    a, l, r = 5 * 10**12 + 1, 9 * 10**12, 7 * 10**12
    assert [tuple(x) for x in got] == [("en", 1, "a b", a, l, r, 10**14, 1000000 * a * a // (l * r))]


def test_empty(spark):
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.mine(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []


def test_memory_of_a_task_is_bounded_by_its_steps():
    """Working arrays follow the bytes taken and the phrases hashed at a time, not the batch."""
    draw = np.random.Generator(np.random.PCG64(3))
    texts = pa.array([" ".join(f"w{x}" for x in draw.integers(0, 3000, 50000)) for _ in range(20)])
    batch = pa.RecordBatch.from_arrays([texts, pa.array(["en"] * len(texts))], ["text", "lang"])
    cells, slices = phrases.shape(3 * 20 * 50000, 10)
    sent = type("Sent", (), {"value": np.zeros((phrases.DEPTH, cells // 8), np.uint8)})
    for task in (phrases._sketches(3, cells, slices, 10), phrases._survivors(3, cells, slices, 0, sent)):
        tracemalloc.start()
        for _ in task(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 85 << 20, peak >> 20


def test_more_text_needs_no_more_scans():
    """10 GB of text (6 GB of Parquet) are read twice, as little ones are, and 50 GB three times; what is sent keeps its bound."""
    for gb, scans in ((0.1, 1), (1, 1), (10.4, 1), (25, 1), (50, 2)):
        cells, slices = phrases.shape(int(gb * 1e9) // 5 * 3, 10)
        assert slices == scans and phrases.DEPTH * cells // 8 <= phrases.SLICE_BYTES


def test_a_crowded_sketch_drops_most_rare_phrases():
    """32 rare phrases on a cell don't give it its bit."""
    draw = np.random.Generator(np.random.PCG64(8))
    texts = [" ".join([*(f"r{x}" for x in draw.integers(0, 10**12, 17500)), "same", "words", "here"]) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 40)], ["text", "lang"])
    blocks = [r for b in phrases._sketches(3, 1 << 16, 1, 10)(iter([batch])) for r in b.to_pylist()]
    blocks.sort(key=lambda r: (r["slice"], r["line"], r["block"]))
    bits = [r["bits"] for b in phrases._added(10, (1 << 16) // phrases.BLOCKS)(iter([pa.RecordBatch.from_pylist(blocks)])) for r in b.to_pylist()]
    assert 6 <= sum(np.unpackbits(np.frombuffer(b, np.uint8)).sum() for b in bits) < 100
