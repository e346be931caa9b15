"""Operators on tables with columns of any name, and what long texts do to a sample of bounded bytes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import WORDS

import corpus_pipeline
from arbora.llm import curriculum, decontam, jaccard, pii, toxicity, url_filter, warc

_OWN = random.Random(9)  # other tests' texts don't change with these


def prose(n):
    return " ".join(_OWN.choice(WORDS) for _ in range(n))


EXTRA = ["a.b", "x`y", "other_0", "found", "NEW", "digest", "least", "row", "place", "hot_key", "Key", "tie"]
CLASHING = {
    "pii": ["N_Private"], "mix": ["Size", "TARGET", "Position", "source_SIZE"], "score": ["Score", "LOCATED", "n_Sentences"], "mark": ["N_Leaks"],
    "judge": ["Host", "PATH", "Rule", "verdict"], "deduplicated": ["Component_Id"],
}


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(n) for n in (3, 20, 60, 80)] * 4 + ["card 4111 1111 1111 1111 on 2024-02-29", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def widened(df, clashing=()):
    """df with columns of awkward names, each with a value of its own, among its own columns."""
    more = [*EXTRA, *clashing]
    first = df.columns[0]
    return df.select(first, *[F.lit(i).alias(c) for i, c in enumerate(more)], *df.columns[1:]), {c: i for i, c in enumerate(EXTRA)}


def operators(spark, docs):
    bench = spark.createDataFrame([(1, prose(20))], "item_id long, text string")
    rules = url_filter.rules_table(spark, [("block", "net", "/")])
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), -3.0)
    return {
        "pii": lambda d: pii.pseudonymise(d),
        "mix": lambda d: curriculum.mix(d),
        "score": lambda d: toxicity.score(d, model),
        "mark": lambda d: decontam.mark(d, bench),
        "judge": lambda d: url_filter.judge(d.withColumn("url", F.lit("http://a.net/x")), rules),
        "deduplicated": lambda d: jaccard.deduplicated(d),
    }


@pytest.mark.parametrize("name", sorted(CLASHING))
def test_columns_keep_their_names_and_values(spark, docs, name):
    run = operators(spark, docs)[name]
    wide, kept = widened(docs, CLASHING[name])
    got, plain = run(wide), run(docs)
    assert len(set(c.lower() for c in got.columns)) == len(got.columns)
    new = [c for c in plain.columns if c not in docs.columns]
    assert set(new) | set(docs.columns) | set(kept) <= set(got.columns)
    rows = [r.asDict() for r in got.collect()]
    assert all(r[c] == v for r in rows for c, v in kept.items())
    want = sorted(str([r[c] for c in plain.columns]) for r in plain.collect())
    assert sorted(str([r[c] for c in plain.columns]) for r in rows) == want


def test_mix_keeps_only_what_is_asked(spark, docs):
    wide, _ = widened(docs)
    assert curriculum.mix(wide, keep=["doc_id", "a.b"]).columns[:2] == ["doc_id", "a.b"]
    assert "text" not in curriculum.mix(wide, keep=["doc_id"]).columns


def test_archives_do_not_read_other_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, None, "x" * 200), (3, "u", None)], "page_id long, url string, html string")
    wide = pages.withColumns({c: F.lit(1) for c in ("payload", "Digest", "record_id", "refers_to", "a.b")})
    assert sorted(map(str, warc.deduplicate(wide).collect())) == sorted(map(str, warc.deduplicate(pages).collect()))


def test_pipeline(spark, docs, tmp_path):
    wide, kept = widened(docs, ["Score", "N_Leaks", "N_Private", "Component_Id"])
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        read = stage(spark, read, str(tmp_path))
        assert read.columns == wide.columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) > 5 and all(r.asDict()[c] == v for r in rows for c, v in kept.items())


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_of_empty_tables(spark, docs, tmp_path, empty):
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, prose(20))], "item_id long, text string"),
    }
    for name, df in tables.items():
        (df.limit(0) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() == 0) == (empty == "documents")


def test_a_long_text_leaves_the_sample_whole(spark):
    draw = random.Random(5)
    texts = [prose(30) + (" grblx snorfk" if i % 2 else "") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = [(i, t) for i, t in enumerate(texts)]
    order = [r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").where("crc32(cast(doc_id AS string)) % 5 <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for long in (order[0], order[40], order[-1]):
        own = [(i, " ".join(draw.choice(texts) for _ in range(800)) if i == long else t) for i, t in rows]
        model = toxicity.fit(spark.createDataFrame(own, "doc_id long, text string"), labels, max_bytes=60000)
        assert np.count_nonzero(model.weights) > 20
        got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
        assert all((got[i] >= 0.5) == (i % 2 == 1) for i in got)


def test_noisy_or_by_hand(spark):
    """Scores against a plain version: a sentence is a logistic unit on its features, repeats counted, a document 1 less the product of what is clean."""
    draw = np.random.Generator(np.random.PCG64(2))
    model = toxicity.Model(draw.normal(0, 1.5, toxicity.BUCKETS), -1.0)
    texts = ["one two. three!\nfour five six", "Same same same? same", "x" * 50, "", ". . !", "é ü ö. two", prose(200).replace(" ", ". ", 20)]
    import pyarrow as pa

    from arbora.llm.common import flat

    for text in texts:
        raw, offsets = flat(pa.array([text]))
        feature, sentence, row, _, _ = toxicity._bags(raw, offsets)
        clean = 1.0
        for s in range(len(row)):
            z = model.bias + sum(model.weights[f] for f in feature[sentence == s].tolist())
            clean *= 1 - 1 / (1 + math.exp(-z))
        got = toxicity.score(spark.createDataFrame([(text,)], "text string"), model).first()
        assert got.n_sentences == len(row) and got.score == pytest.approx(1 - clean, abs=1e-9)
