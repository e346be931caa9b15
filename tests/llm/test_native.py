"""URL rules, archives, pseudonyms and mixing."""

import hashlib
import math
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from arbora.llm import curriculum, pii, url_filter, warc
from arbora.llm.queries import URL_RULES


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def test_url_rules(spark):
    urls = ["http://a.NET/x?q", "https://m.b.example.net/en/5#t", "ftp://example.com/de/", "http://example.com/de", "http://x.org/fr/1", "http://net", "http://xnet/", None, "", "no scheme", "://", "http://example.net/en/", "http://b.example.com/de/?x"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(0, urls[0], "mine")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rules_table(spark, URL_RULES)).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1][2:] == ("example.net/en/", "allow") and got[11][2] == "example.net/en/"
    assert got[2][2:] == ("example.com/de/", "block") and got[12][2] == "example.com/de/"
    assert got[3] == ("example.com", "/de", None, "allow") and got[4][2] == "org/fr/"
    assert got[5] == ("net", "", None, "allow") and got[6][2] is None
    assert all(got[i] == ("", "", None, "allow") for i in (7, 8, 9, 10))
    assert url_filter.judge(df, url_filter.rules_table(spark, URL_RULES)).count() == len(urls) + 1
    assert url_filter.judge(df, url_filter.rules_table(spark, [])).where("verdict = 'allow'").count() == len(urls) + 1


def test_url_helper_columns_and_hot_places(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "http://x.net/a").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".org/fr/"))).alias("url"), F.lit(1).alias("_rank"), F.lit(2).alias("place"), F.lit(3).alias("hit"))
    got = url_filter.judge(df, url_filter.rules_table(spark, URL_RULES))
    assert got.columns == ["id", "url", "_rank", "place", "hit", "host", "path", "rule", "verdict"]
    assert {(r.rule, r["count"]) for r in got.where("_rank = 1 AND place = 2 AND hit = 3").groupBy("rule").count().collect()} == {("net/", 1000), (None, 1000), ("org/fr/", 1000)}


def test_url_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.rules_table(spark, URL_RULES)).count() == 0


def test_warc_round_trip(spark):
    long = "é" * 60
    rows = [(5, "u5", long), (3, "u3", long), (9, None, long), (None, "n", long), (1, "a\r\nb", "short"), (2, "b", "short"), (4, "c", None), (6, "d", ""), (5, "u5", long), (7, "e", "\r\n\r\n" + "x" * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.deduplicate(df).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == sorted((p or -1, len((t or "").encode()), sha(t)) for p, _, t in rows)
    same = [r for r in got if r.payload_digest == sha(long)]
    assert [r.page_id for r in same if r.record_type == "response"] == [3]
    assert all(r.refers_to == 3 for r in same if r.record_type == "revisit") and len(same) == 5
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_bytes < 100 or r.page_id == 7)
    assert warc.deduplicate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TOKENS = ["4111111111111111", "4111-1111-1111-1111", "371449635398431", "+1 (017) 555-7713", "(212) 555-0199", "10.0.0.1", "2024-02-29", "1899-12-31", "jane.doe7@mail.example.com"]
LEFT = ["4111111111111112", "300.1.2.3", "2024-02-30", "1234", "1.2.3", "x4111111111111111", "version 4.0.", "12@"]


def test_pseudonyms(spark):
    rows = [(i, f"see {t}, and {t}.") for i, t in enumerate(TOKENS)] + [(100 + i, f"see {t} now") for i, t in enumerate(LEFT)] + [(200, None), (201, ""), (202, "é4111111111111111 " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_private", F.lit("mine"))
    got = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    for i, t in enumerate(TOKENS):
        r = got[i]
        assert r.n_private == 2 and t not in r.text, t
        new = r.text[4 : r.text.index(", and ")]
        assert r.text == f"see {new}, and {new}."
        shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else c for c in s)
        if "." not in t or "@" in t:
            assert shape(new) == shape(t)
        if t in TOKENS[:3]:
            assert luhn(new)
        if t.startswith("10."):
            assert all(0 <= int(x) <= 255 for x in new.split("."))
    for i, t in enumerate(LEFT):
        assert got[100 + i].text == f"see {t} now" and got[100 + i].n_private == 0
    assert got[200].text is None and got[201].text == ""
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, key="another").collect()}
    assert all(other[i] != got[i].text for i in range(len(TOKENS)))


# The same permutations in plain Python, from the definition: alternating rounds, each half shifted by hashes of the other.


def feistel(values, radices, kind, key=pii.KEY):
    h = len(values) // 2
    state, radix = [list(values[:h]), list(values[h:])], [radices[:h], radices[h:]]
    for n in range(pii.ROUNDS):
        own, other = (0, 1) if n % 2 == 0 else (1, 0)
        seed = "|".join([key, kind, str(n), ",".join(map(str, state[other])), ""])
        state[own] = [(v + int(hashlib.sha256(f"{seed}{i}".encode()).hexdigest()[:12], 16)) % r for i, (v, r) in enumerate(zip(state[own], radix[own]))]
    return state[0] + state[1]


def put(token, digits):
    left = iter(digits)
    return "".join(str(next(left)) if c.isdigit() else c for c in token)


def plain(token):
    digits = [int(c) for c in token if c.isdigit()]
    if "@" in token:
        local, at, rest = token.partition("@")
        kinds = [(pii.LETTERS, 26) if c in pii.LETTERS else (pii.CAPITALS, 26) if c in pii.CAPITALS else (pii.DIGITS, 10) if c in pii.DIGITS else ("", 1) for c in local]
        new = feistel([max(k.find(c), 0) if k else 0 for c, (k, _) in zip(local, kinds)], [r for _, r in kinds], "mail")
        return "".join(k[v] if k else c for c, (k, _), v in zip(local, kinds, new)) + at + rest
    if re.fullmatch(r"\d{4}-\d\d-\d\d", token):
        try:
            day = date.fromisoformat(token).toordinal() - 1
        except ValueError:
            return token
        i = max(i for i, (first, _) in enumerate(pii.SPANS) if first <= day)
        first, size = pii.SPANS[i]
        side, x = math.isqrt(size - 1) + 1, day - first
        while True:
            a, b = feistel([x // side, x % side], [side, side], f"date{i}")
            x = a * side + b
            if x < size:
                return date.fromordinal(x + first + 1).isoformat()
    if token.count(".") == 3 and "(" not in token and "+" not in token:
        parts = [int(x) for x in token.split(".")]
        return ".".join(map(str, feistel(parts, [256] * 4, "address"))) if max(parts) < 256 else token
    if token[0] in "+(" or re.match(r"\d{3}[.-]\d{3}[.-]\d{4}$", token):
        own = digits[-10:]
        lead = [i in (0, 3) for i in range(10)]
        radix = [(8 if d > 1 else 2) if x else 10 for d, x in zip(own, lead)]
        base = [2 if x and d > 1 else 0 for d, x in zip(own, lead)]
        return put(token, digits[:-10] + [v + b for v, b in zip(feistel([d - b for d, b in zip(own, base)], radix, "phone"), base)])
    if not luhn(token):
        return token
    body = feistel(digits[:-1], [10] * (len(digits) - 1), "card")
    return put(token, body + [next(c for c in range(10) if luhn("".join(map(str, [*body, c]))))])


def test_pseudonyms_against_plain_python(spark):
    draw = random.Random(5)
    tokens = [*TOKENS, "4111111111111112", "300.1.2.3", "000-000-0000", "212-055-0199", "+1.212.555.0199", "A.b-9_c@x.org", "9999-12-31", "0001-01-01", "1899-12-31", "1900-01-01", "2099-12-31", "2100-01-01", "0000-01-01", "2023-02-29", "1582-10-10"]
    tokens += [date.fromordinal(draw.randint(1, 3652059)).isoformat() for _ in range(150)]
    tokens += [f"({draw.randint(0, 999):03}) {draw.randint(0, 999):03}-{draw.randint(0, 9999):04}" for _ in range(50)]
    tokens += [".".join(str(draw.randint(0, 255)) for _ in range(4)) for _ in range(30)] + [str(draw.randint(10**15, 10**16)) for _ in range(60)]
    df = spark.createDataFrame([(i, f"<{t}>") for i, t in enumerate(tokens)] + [(None, f"<{tokens[0]}>")], "doc_id long, text string")
    got = {r.doc_id: r.text[1:-1] for r in pii.pseudonymise(df).collect()}
    assert {i: got[i] for i in range(len(tokens))} == {i: plain(t) for i, t in enumerate(tokens)}
    assert got[None] == got[0]


def test_dates_stay_in_the_calendar(spark):
    """A bijection of each span's first and last days, and of a stretch of the shortest span; nothing leaves 0001 to 9999."""
    first = F.lit("0001-01-01").cast("date")
    edges = [(max(0, a - 300), a + 300) for a, _ in pii.SPANS] + [(3652059 - 300, 3652059), (700000, 704000)]
    days = spark.createDataFrame([(d,) for d in sorted({d for a, b in edges for d in range(a, b)})], "d int")
    rows = days.select("d", pii.date_pseudonym(F.date_add(first, F.col("d")).cast("string")).alias("p")).collect()
    found = [date.fromisoformat(r.p).toordinal() - 1 for r in rows]
    assert len(set(found)) == len(rows)
    span = lambda d: max(i for i, (a, _) in enumerate(pii.SPANS) if a <= d)
    assert all(span(r.d) == span(n) for r, n in zip(rows, found, strict=True))


def test_phones_stay_numbers_that_can_be_called(spark):
    df = spark.range(0, 2000).select(F.format_string("+1 (212) 555-%04d", "id").alias("t"))
    got = [r.p for r in df.select(pii.phone_pseudonym(F.col("t")).alias("p")).collect()]
    assert len(set(got)) == 2000 and all(re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", p) for p in got)


def test_pseudonyms_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "call 10.0.0.1", 3, 4)], "doc_id long, text string, found int, `_new` int").withColumn("_found", F.lit(5))
    r = pii.pseudonymise(df).first()
    assert (r.found, r._new, r._found, r.n_private) == (3, 4, 5, 1)
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_mix(frame):
    df = frame([("w " * (1 + i * 7 % 40)).strip() for i in range(200)] + [None, "", " \t"]).withColumn("size", F.lit("mine"))
    df = df.unionByName(df.limit(3))
    got = curriculum.mix(df).collect()
    assert len(got) == df.count()
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert len(r.positions) == -(-r.taken // r.size) if r.size else r.positions == []
        by.setdefault(r.source, []).append(r)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size and rows[0].target <= 2 * rows[0].source_size + 1e-9
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert sorted(map(str, got)) == sorted(map(str, curriculum.mix(df.repartition(7)).collect()))
    order = curriculum.training_order(curriculum.mix(df)).select("position").collect()
    assert [r[0] for r in order] == sorted(r[0] for r in order) and len(order) == sum(len(r.positions) for r in got)
    assert curriculum.mix(frame([])).count() == 0
    clashing = df.withColumns({"_key": F.lit(1), "_tie": F.lit(2), "_piece": F.lit(3), "_before": F.lit(7), "row": F.lit(8), "p": F.lit(9), "passes": F.lit(10)})
    r = curriculum.mix(clashing).first()
    assert (r._key, r._tie, r._piece, r._before, r.row, r.p, r.passes) == (1, 2, 3, 7, 8, 9, 10)


@pytest.mark.parametrize("piece_rows", [5, 1 << 16])
def test_mix_by_walking(spark, piece_rows):
    """What is taken, and when, by walking each source's order word by word."""
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 30), f"s{i % 4}" if i % 9 else None) for i in range(90)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "a b c", "s1"), (None, "a b c", "s1")]
    got = curriculum.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), piece_rows=piece_rows).collect()
    assert len(got) == len(rows)
    taken, first = {}, {}
    for s in {r[2] for r in rows}:
        own = sorted(((hashlib.md5("|".join(["mix", *([str(r[0])] if r[0] is not None else [])]).encode()).hexdigest(), r[0] or 0, len(r[1].split())) for r in rows if r[2] == s))
        whole = round(next(r.target for r in got if r.source == s))
        walked, sizes = [0] * len(own), [n for _, _, n in own]
        at = 0
        for _ in range(2):
            for k, n in enumerate(sizes):
                walked[k] += max(0, min(n, whole - at))
                at += n
        for (_, d, n), t in zip(own, walked, strict=True):
            taken.setdefault((s, d), []).append(t)
    for r in got:
        first.setdefault((r.source, r.doc_id or 0), []).append(r.taken)
    assert {k: sorted(v) for k, v in first.items()} == {k: sorted(v) for k, v in taken.items()}
