"""Each stage of the pipeline against what its input makes plain, on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F
from test_native import TOKENS, plain
from test_search import WORDS, brute_components, changed, prose

import corpus_pipeline
from arbora.llm.common import stored

BAD = ["grblx", "snorfk", "quamz"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw = random.Random(2)
    items = [(i, prose(n)) for i, n in enumerate([12, 20, 33, 5])]
    texts, toxic, leaks, tokens = [], set(), set(), {}
    for i in range(320):
        t = [prose(draw.randint(5, 14)) for _ in range(draw.randint(2, 6))]
        if i % 4 == 0:
            t[draw.randrange(len(t))] += " " + " ".join(draw.sample(BAD, 2))
            toxic.add(i)
        elif i % 10 == 1:
            k, item = items[draw.randrange(4)]
            t.append(changed(item, draw.randint(0, 2), "mixed") if k < 3 else item)
            leaks.add(i)
        elif i % 10 == 3:
            tokens[i] = draw.sample(TOKENS, 2)
            t.append(f"see {tokens[i][0]} or {tokens[i][1]}")
        texts.append(". ".join(t))
    for i in range(320, 360):  # near and exact copies of clean documents
        texts.append(changed(texts[draw.choice([2, 6, 7, 9, 14, 18])], draw.randint(0, 1), "replaced"))
    texts += ["", None]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(320)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, toxic, leaks, tokens


def test_stages(spark, corpus):
    folder, texts, toxic, leaks, tokens = corpus
    assert len(set(WORDS) & set(BAD)) == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, set(range(len(texts)))

    def step(name):
        nonlocal docs
        docs = stored(dict(corpus_pipeline.STAGES)[name](spark, docs, folder), f"test-{name}")
        return {r.doc_id: r for r in docs.collect()}

    got = step("toxicity")
    assert set(got) == kept - toxic and docs.columns == columns
    left = sorted(got)
    component = brute_components([texts[i] for i in left])
    first = {}
    for k, (n, c) in component.items():
        first.setdefault((n > 0, c if n else k), left[k])
    got = step("ngram_jaccard")
    assert set(got) == set(first.values()) and len(got) < len(left)
    kept = set(got) - leaks
    got = step("decontamination")
    assert set(got) == kept and docs.columns == columns
    want = {i: texts[i] for i in kept}
    for i, found in tokens.items():
        if i in want:
            a, b = found
            want[i] = texts[i].replace(f"see {a} or {b}", f"see {plain(a)} or {plain(b)}")
    got = step("pii")
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == (None if want[i] is None else len(want[i])) for i, r in got.items())
    got = step("mixing")
    assert {i: r.text for i, r in got.items()} == want and set(columns) <= set(docs.columns)
    total = 0
    for source in {r.source for r in got.values()}:
        own = [r for r in got.values() if r.source == source]
        assert all(r.size == len((r.text or "").split()) and r.taken <= 2 * r.size for r in own)
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 1
        total += own[0].target
    assert total == pytest.approx(1.5 * sum(r.size for r in got.values()))
    at = [r.position for r in corpus_pipeline.order_for_training(spark, docs.select(columns), folder).select("position").collect() if r.position is not None]
    assert at == sorted(at)


def test_run_is_the_stages(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).agg(F.countDistinct("doc_id"), F.count("*")).first()[0] > 100
