"""The manifest against a plain tree, and what tampering does to it."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from arbora.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def fold(nodes, fan_out):
    """What remains of a list of digests, and each one's siblings level by level."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fan_out, len(nodes))) for i in range(0, len(nodes), fan_out)]
        for run in runs:
            for i in run:
                for o in owners[i]:
                    proofs[o].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        owners = [[o for i in run for o in owners[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], proofs


def brute(rows, fan_out):
    """(doc_id, source, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    by, tops = {}, []
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops.append(fold([leaf(r) for r in by[s]], fan_out))
    root, above = fold([t[0] for t in tops], fan_out)
    return sorted(
        (str(r[0]), str(s), leaf(r), sub, root, str([*proofs[i], *above[k]]))
        for k, (s, (sub, proofs)) in enumerate(zip(order, tops, strict=True))
        for i, r in enumerate(by[s])
    )


def rows(draw, n):
    out = []
    for i in range(n):
        source = draw.choice([None, "", "-", "=", "é", "a", "b", "b", "b", "b", "b", "b"])
        text = draw.choice([None, "", "Ab", "é" * draw.randint(0, 5), "x" * 9000])
        out.append((draw.choice([None, i, i, i, 7]), source, draw.choice([None, "en"]), draw.choice([None, 3]), text))
    return out


@pytest.mark.parametrize(("fan_out", "n"), [(2, 40), (3, 150), (16, 400), (16, 1)])
def test_tree(spark, fan_out, n):
    draw = random.Random(n)
    data = rows(draw, n)
    data += data[: n // 3]  # repeated rows
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    # Columns whose names clash with the operator's own, with a dot and with others by case.
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "pos", "Leaf", "root", "a.b", "payload", "digest", "RUN")})
    got = merkle.manifest(docs, fan_out=fan_out).collect()
    assert sorted((str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, str([tuple(s) for s in r.proof])) for r in got) == brute(data, fan_out)


def test_tampering_is_found(spark):
    data = [(i, f"s{i % 4}", "en", None, "Text" if i % 3 else "text") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    claimed = merkle.leaf("doc_id", "source", "lang", "n_chars", F.lower("text"))
    got = merkle.verified(merkle.manifest(docs, keep={"claimed": claimed}), "claimed").collect()
    assert len(got) == 200
    for r in got:
        assert r.verified == (r.doc_id % 3 == 0) and (r.folded_root == r.root) == r.verified


def test_hot_source_and_row_spread_over_tasks(spark):
    """One source and one repeated row hold most rows; their nodes still come from several partitions, counted without gaps."""
    nodes = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("key"), F.lit(5).alias("id"))
    found = merkle.ranked(nodes.withColumn("digest", F.lit("d")).withColumn("payload", F.struct("id")), ["id", "digest"])
    assert [r.pos for r in found.where("key = 'hot'").orderBy("pos").collect()] == list(range(2400))
    assert found.where("key <> 'hot'").agg(F.sum("pos"), F.count("*")).first()[:] == (0, 600)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).collect() == []


def test_crc_of_the_query_is_zlibs(spark):
    ids = [0, 7, 123456, -5]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.crc32(F.col("i").cast("string").cast("binary")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: zlib.crc32(str(i).encode()) for i in ids}
