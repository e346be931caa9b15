"""The queries opN_<name> of __spark_entry__.py and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum, decontam, jaccard, merkle, phrases, pii, simhash, suffix_dedup, token_scan, topk, toxicity, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(_read(spark, sf_dir, "pages"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS nth,
         first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id
  FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first_id END AS refers_to
FROM p
"""


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, sf_dir, "documents"))


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || doc_id) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + place % 3] AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
v AS (
  SELECT *, cap / weight AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5 AS total, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER b, 0) AS full_, coalesce(sum(weight) OVER b, 0) AS used
  FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - full_) / (weights - used) AS level FROM v),
o AS (SELECT ratio AS oratio, place AS oplace, level AS olevel FROM l WHERE ratio > level ORDER BY ratio, place LIMIT 1),
t AS (
  SELECT source, source_size, place,
         CASE WHEN oratio IS NULL OR ratio < oratio OR (ratio = oratio AND place < oplace) THEN cap ELSE weight * olevel END AS target
  FROM l LEFT JOIN o ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place, CAST(round(t.target) AS BIGINT) AS whole,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (
  SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS times FROM r),
n AS (
  SELECT *, CAST(times * size + greatest(0, least(size, whole - times * source_size - off)) AS BIGINT) AS taken FROM m),
q AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE * target AS w_a, target AS w_b,
         CASE place % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 ELSE 1.0 END::DOUBLE * target AS w_c,
         CASE place % 3 WHEN 0 THEN 0.625 WHEN 1 THEN 0.375 ELSE 0.5 END::DOUBLE * target AS d_b FROM n),
z AS (
  SELECT *, CASE WHEN d_b <= off THEN 1 ELSE 0 END AS seg,
         CASE WHEN d_b <= off THEN w_b ELSE w_a END AS w0, CASE WHEN d_b <= off THEN w_c ELSE w_b END AS w1,
         off - CASE WHEN d_b <= off THEN d_b ELSE 0 END AS rest FROM q)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(least(seg / 2.0::DOUBLE + least(CASE WHEN w0 + sqrt(greatest(w0 * w0 + 4 * (w1 - w0) * rest, 0)) > 0
         THEN 2 * rest / (w0 + sqrt(greatest(w0 * w0 + 4 * (w1 - w0) * rest, 0))) ELSE 0 END, 0.5), 1.0), 9) END AS position
FROM z
"""

#: The rules of the query: action, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
r(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
j AS (
  SELECT DISTINCT host, path, first_value(h || p) OVER o AS rule, first_value(action) OVER o AS action
  FROM (SELECT DISTINCT host, path FROM b) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  WINDOW o AS (PARTITION BY host, path ORDER BY length(h || p) DESC))
SELECT page_id, b.host, b.path, rule, coalesce(action, 'allow') AS verdict
FROM b LEFT JOIN j ON b.host = j.host AND b.path = j.path
"""

QUERIES = {
    "op2_warc_revisits": op2_warc_revisits,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op6_curriculum_mix": op6_curriculum_mix,
    "op9_url_filter": op9_url_filter,
}
SQL = {"op2_warc_revisits": OP2_SQL, "op6_curriculum_mix": OP6_SQL, "op9_url_filter": OP9_SQL}


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Neighbours are searched for every 50th id, against all documents.
    return simhash.with_neighbours(_read(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).drop("text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 == 0
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_score", "worst_start", "worst_end", F.size("located").alias("n_located"), "located")


QUERIES |= {"op4_simhash": op4_simhash, "op7_toxicity": op7_toxicity}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count_tokens(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES |= {"op1_token_counts": op1_token_counts, "op8_decontamination": op8_decontamination}


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


QUERIES |= {"op10_ngram_jaccard": op10_ngram_jaccard}


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


QUERIES |= {"op5_suffix_dedup": op5_suffix_dedup}


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lowered = merkle.leaf("doc_id", "source", "lang", "n_chars", F.translate("text", url_filter.UPPER, url_filter.LOWERED))
    proofs = merkle.manifest(docs, keep={"tampered": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered)})
    checked = merkle.verified(proofs.withColumn("tampered", F.coalesce("tampered", "leaf")), "tampered")
    return checked.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", "verified")


def _merkle_sql(levels: int = 6, over: int = 3) -> str:
    """SQL of the manifest for sources of up to 16**levels rows and up to 16**over sources."""

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    # CRC-32 bit by bit: each byte is put in at the first of its eight steps.
    crc = "xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"t AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS tampered FROM documents)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM t)",
        "a0 AS (SELECT source AS g, p, leaf AS h FROM d)",
    ]

    def level(name: str, i: int) -> list[str]:
        return [
            f"{name}r{i} AS (SELECT g, p // 16 AS run, list(h ORDER BY p) AS hs, sum(count(*)) OVER (PARTITION BY g) AS n FROM {name}{i} GROUP BY g, p // 16)",
            f"{name}{i + 1} AS (SELECT g, run AS p, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{i})",
        ]

    for i in range(levels):
        parts += level("a", i)
    parts.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, h, g AS source FROM a{levels})")
    for i in range(over):
        parts += level("b", i)
    parts.append(f"f0 AS (SELECT d.doc_id, d.leaf, d.source, d.p, b0.p AS s, b0.h AS subroot, (SELECT h FROM b{over}) AS root, '' AS proof, coalesce(tampered, leaf) AS f FROM d JOIN b0 ON d.source IS NOT DISTINCT FROM b0.source)")
    done = 0
    for name, group, place, n in (("a", "source", "p", levels), ("b", "0", "s", over)):
        for i in range(n):
            at, step = f"{place} // {16**i} % 16", f"{place} // {16 ** (i + 1)}"
            left, right = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:], '')"
            parts.append(
                f"f{done + 1} AS (SELECT doc_id, leaf, source, f{done}.p, s, subroot, root, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof, "
                f"CASE WHEN n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f FROM f{done} JOIN {name}r{i} ON g IS NOT DISTINCT FROM {group} AND run = {step})"
            )
            done += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{done}"


QUERIES |= {"op13_merkle_manifest": op13_merkle_manifest}
SQL |= {"op13_merkle_manifest": _merkle_sql()}


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.nth, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.nth <> c.nth WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
QUERIES |= {"op11_topk_search": op11_topk_search}
SQL |= {"op11_topk_search": OP11_SQL}


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3)) sizes(m))),
c AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE m = 1 GROUP BY lang),
k AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE m > 1 AND f >= 10),
inside AS (
  SELECT lang, part, max(a) AS longest
  FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM k WHERE m = 3) GROUP BY lang, part),
kept AS (SELECT k.* FROM k LEFT JOIN inside ON k.lang = inside.lang AND k.phrase = part WHERE longest IS NULL OR 100 * longest < 50 * a),
cuts AS (
  SELECT kept.lang, kept.phrase, a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS cut FROM kept) kept
  JOIN c l ON l.lang = kept.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
  JOIN c r ON r.lang = kept.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT ranked.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
QUERIES |= {"op12_phrase_mining": op12_phrase_mining}
SQL |= {"op12_phrase_mining": OP12_SQL}
