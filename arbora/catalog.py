"""Named queries of the network operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.text import base_name, sanitize_label
from arbora.operators import assoc, edges, moments, prep, profile, scores
from arbora.operators.counts import Variables, cardinalities, drop_parent, families_of, family_counts, with_totals
from arbora.operators.importance import edge_importance
from arbora.plans import bootstrap as boot
from arbora.plans import evaluation, search, workflow

VIEWS = {
    "bn_li": """
SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS x0, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS x1,
       CAST(LEAST(2, FLOOR((l_quantity - 1) / 17)) AS INT) AS x2, CAST(LEAST(2, FLOOR(l_extendedprice / 35000)) AS INT) AS x3,
       CASE WHEN ROUND(l_discount * 100) >= 5 THEN 1 ELSE 0 END AS x4, CAST(FLOOR(ROUND(l_tax * 100) / 3) AS INT) AS x5,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS x6, CAST(SUBSTR(o_orderpriority, 1, 1) AS INT) - 1 AS x7, c_mktsegment AS grp
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    "bn_dep": """
SELECT a, b, CASE WHEN a = 1 OR b = 1 THEN 1 ELSE 0 END AS c, d, CASE WHEN (a = 1 OR b = 1) AND d = 1 THEN 1 ELSE 0 END AS e,
       CAST((ln + CASE WHEN a = 1 OR b = 1 THEN 1 ELSE 0 END) % 2 AS INT) AS f
FROM (SELECT CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS a, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS b,
             CASE WHEN ROUND(l_discount * 100) >= 5 THEN 1 ELSE 0 END AS d, l_linenumber AS ln FROM {lineitem}) t""",
    "bn_ev": """
SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS etype,
       CAST(FLOOR(EXTRACT(hour FROM ts) / 6) AS INT) AS hour4, CASE WHEN value < 20 THEN 0 WHEN value < 55 THEN 1 ELSE 2 END AS val3,
       CAST(EXTRACT(day FROM ts) % 2 AS INT) AS day2
FROM {events}""",
    "expr_counts": """
SELECT p_brand AS gene, l_suppkey AS sample, COUNT(*) AS value, MIN(p_size) * 100 AS gene_length
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, l_suppkey""",
    "edges_nat": """
SELECT s_nationkey AS u, c_nationkey AS v, COUNT(*) AS n, ROUND(SUM(l_extendedprice) / 1000, 3) AS w
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey""",
    "edges_parts": """
SELECT s_nationkey AS u, c_nationkey AS v, COUNT(*) AS n, CAST(SUM(CASE WHEN o_orderdate < '1998-04-16' THEN 1 ELSE 0 END) AS BIGINT) AS n_early,
       CAST(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS n_building, CAST(SUM(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS BIGINT) AS n_machinery,
       CAST(SUM(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END) AS BIGINT) AS n_furniture
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey""",
}
EMB_SQL = "SELECT vec_id AS sample, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS gene, CAST(unnest(embedding) AS DOUBLE) AS value, label AS grp FROM embeddings"
TABLES = ("lineitem", "orders", "customer", "supplier", "part", "events")

LI = Variables(tuple(f"x{i}" for i in range(8)), (3, 2, 3, 3, 2, 3, 3, 5))
LI_EDGES = [(0, 2), (1, 2), (2, 3), (4, 3), (6, 7), (0, 7), (5, 4)]
LI_FAMILIES = families_of(LI_EDGES, 8)
EV = Variables(("etype", "hour4", "val3", "day2"), (5, 4, 3, 2))
DEP = Variables(tuple("abcdef"), (2,) * 6)
ESS = 10.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def _sql(name: str) -> str:
    return "(" + VIEWS[name].format(**{t: t for t in TABLES}) + ")"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("gene", "x"))
    return e.select(F.col("vec_id").alias("sample"), "gene", F.col("x").cast("double").alias("value"), F.col("label").alias("grp"))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _j(parents: Sequence[int], vs: Variables) -> str:
    out = "0"
    for p in parents:
        out = f"({out}) * {vs.cards[p]} + {vs.names[p]}"
    return f"CAST({out} AS BIGINT)"


def _counts_sql(families, vs: Variables, source: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    parts = [f"SELECT {g}{i} AS family, {v} AS v, {_j(ps, vs)} AS j, {vs.names[v]} AS k FROM s" for i, (v, ps) in enumerate(families)]
    return f"SELECT {g}family, v, j, k, count(*) AS n FROM (WITH s AS MATERIALIZED {source} {' UNION ALL '.join(parts)}) GROUP BY ALL"


def _shape_sql(families, vs: Variables) -> str:
    rows = ", ".join(f"({i}, {f[0]}, {vs.cards[f[0]]}::DOUBLE, {np.prod([vs.cards[p] for p in f[1]] or [1])}::DOUBLE)" for i, f in enumerate(families))
    return f"(SELECT * FROM (VALUES {rows}) AS t(family, v, r, q))"


def _score_sql(families, vs: Variables, source: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""
WITH c AS ({_counts_sql(families, vs, source, by)}),
j AS (SELECT {g}c.family, c.v, j, r, q, sum(n)::DOUBLE AS nj, sum(n * ln(n)) AS s, sum(lgamma(n + 1)) AS gg,
             sum(lgamma(n + {ESS} / q / r) - lgamma({ESS} / q / r)) AS b
      FROM c JOIN {_shape_sql(families, vs)} t ON c.family = t.family GROUP BY ALL),
f AS (SELECT {g}family, v, r, q, sum(nj) AS nn, sum(s - nj * ln(nj)) AS loglik, sum(gg + lgamma(r) - lgamma(nj + r)) AS k2,
             sum(b + lgamma({ESS} / q) - lgamma({ESS} / q + nj)) AS bdeu FROM j GROUP BY ALL)
SELECT {g}family, v, loglik, loglik - 0.5 * (r - 1) * q * ln(greatest(nn, 1)) AS bic, k2, bdeu FROM f"""


# --- counts -------------------------------------------------------------------------------------------------


@query("cardinalities", " UNION ALL ".join(f"SELECT '{n}' AS variable, CAST(max({n}) + 1 AS INT) AS card FROM {_sql('bn_li')}" for n in LI.names))
def _(spark, sf):
    return cardinalities(view(spark, sf, "bn_li"), LI.names)


@query("family_counts", _counts_sql(LI_FAMILIES, LI, _sql("bn_li")))
def _(spark, sf):
    return family_counts(view(spark, sf, "bn_li"), LI_FAMILIES, LI)


@query("family_counts_totals", f"WITH c AS ({_counts_sql(LI_FAMILIES, LI, _sql('bn_li'))}) SELECT family, v, j, k, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY GROUPING SETS ((family, v, j, k), (family, v, j))")
def _(spark, sf):
    return with_totals(family_counts(view(spark, sf, "bn_li"), LI_FAMILIES, LI))


@query("marginalize_parent", _counts_sql([(3, (2,))], LI, _sql("bn_li")))
def _(spark, sf):
    family = (3, (2, 4))
    return drop_parent(family_counts(view(spark, sf, "bn_li"), [family], LI), family, 4, LI)


# --- scores -------------------------------------------------------------------------------------------------


def _scored(metric: str, name: str) -> None:
    digits = 4

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = scores.score_families(view(spark, sf, "bn_li"), LI_FAMILIES, LI, ESS)
        return s.select("v", F.round(metric, digits).alias(metric))

    QUERIES[name] = run
    SQL[name] = f"SELECT v, round({metric}, {digits}) AS {metric} FROM ({_score_sql(LI_FAMILIES, LI, _sql('bn_li'))})"


for _m, _n in (("loglik", "node_loglik"), ("bic", "score_bic"), ("k2", "score_k2"), ("bdeu", "score_bdeu")):
    _scored(_m, _n)


def _cpt(name: str, alpha: float) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = family_counts(view(spark, sf, "bn_li"), LI_FAMILIES, LI)
        return scores.probabilities(c, LI_FAMILIES, LI, alpha).select("v", "j", "k", F.round("prob", 9).alias("prob"))

    QUERIES[name] = run
    SQL[name] = f"""
WITH c AS ({_counts_sql(LI_FAMILIES, LI, _sql("bn_li"))}),
g AS (SELECT family, v, r, unnest(range(CAST(q AS BIGINT))) AS j FROM {_shape_sql(LI_FAMILIES, LI)}),
h AS (SELECT family, v, r, j, CAST(unnest(range(CAST(r AS BIGINT))) AS INT) AS k FROM g),
d AS (SELECT h.family, h.v, h.r, h.j, h.k, coalesce(n, 0) AS n FROM h LEFT JOIN c ON h.family = c.family AND h.j = c.j AND h.k = c.k),
t AS (SELECT *, sum(n) OVER (PARTITION BY family, j) AS nj FROM d)
SELECT v, j, k, round(CASE WHEN nj + {alpha} > 0 THEN (n + {alpha} / r) / (nj + {alpha}) END, 9) AS prob FROM t"""


_cpt("cpt_mle", 0.0)
_cpt("cpt_smoothed", 1.0)

_SPLIT = "(SELECT * FROM {} WHERE x1 = {})"


@query(
    "loglik_dataset",
    f"""
WITH fit AS ({_counts_sql(LI_FAMILIES, LI, _SPLIT.format(_sql("bn_li"), 0))}), new AS ({_counts_sql(LI_FAMILIES, LI, _SPLIT.format(_sql("bn_li"), 1))}),
tot AS (SELECT family, j, sum(n) AS nj FROM fit GROUP BY ALL),
p AS (SELECT new.family, new.n, ln((coalesce(fit.n, 0) + 1.0::DOUBLE / r) / (coalesce(nj, 0) + 1)) AS lp
      FROM new LEFT JOIN fit ON new.family = fit.family AND new.j = fit.j AND new.k = fit.k LEFT JOIN tot ON new.family = tot.family AND new.j = tot.j
      JOIN {_shape_sql(LI_FAMILIES, LI)} s ON new.family = s.family)
SELECT round(sum(n * lp), 4) AS total, round(sum(n * lp) / sum(n) FILTER (family = 0), 9) AS per_sample,
       round(sum(n * lp) / sum(n) FILTER (family = 0) / 8, 9) AS per_sample_variable FROM p""",
)
def _(spark, sf):
    df = view(spark, sf, "bn_li")
    fit, new = (family_counts(df.where(F.col("x1") == x), LI_FAMILIES, LI) for x in (0, 1))
    return scores.data_loglik(new, fit, LI_FAMILIES, LI, 1.0).select(F.round("total", 4).alias("total"), F.round("per_sample", 9).alias("per_sample"), F.round("per_sample_variable", 9).alias("per_sample_variable"))


# --- association --------------------------------------------------------------------------------------------


def _pairs_sql(vs: Variables, source: str) -> str:
    parts = [f"SELECT {u} AS u, {v} AS v, {vs.names[u]} AS a, {vs.names[v]} AS b FROM s" for v in range(len(vs.names)) for u in range(v)]
    return f"SELECT u, v, a, b, count(*) AS n FROM (WITH s AS MATERIALIZED {source} {' UNION ALL '.join(parts)}) GROUP BY ALL"


def _assoc_sql(vs: Variables, source: str) -> str:
    cards = ", ".join(map(str, vs.cards))
    return f"""
SELECT u, v, sum(n / nn * ln((n / nn + 1e-300) / (na / nn * nb / nn + 1e-300))) AS mi, max(nn) * (sum(n * n / (na * nb)) - 1) AS chi2,
       CAST(([{cards}][u + 1] - 1) * ([{cards}][v + 1] - 1) AS INT) AS df
FROM (SELECT u, v, a, b, n::DOUBLE AS n, sum(n::DOUBLE) OVER (PARTITION BY u, v, a) AS na, sum(n::DOUBLE) OVER (PARTITION BY u, v, b) AS nb,
             sum(n::DOUBLE) OVER (PARTITION BY u, v) AS nn FROM ({_pairs_sql(vs, source)})) GROUP BY u, v"""


def _association(spark, sf, name="bn_li", vs=LI):
    return assoc.associations(view(spark, sf, name), vs)


@query("pair_contingency", _pairs_sql(LI, _sql("bn_li")))
def _(spark, sf):
    return assoc.pair_counts(view(spark, sf, "bn_li"), LI)


@query("mutual_info", f"SELECT u, v, round(mi, 9) AS mi FROM ({_assoc_sql(LI, _sql('bn_li'))})")
def _(spark, sf):
    return _association(spark, sf).select("u", "v", F.round("mi", 9).alias("mi"))


@query("chi2_stat", f"SELECT u, v, df, round(greatest(chi2, 0), 5) AS chi2 FROM ({_assoc_sql(LI, _sql('bn_li'))})")
def _(spark, sf):
    return _association(spark, sf).select("u", "v", "df", F.round("chi2", 5).alias("chi2"))


@query(
    "chi2_pvalue",
    f"""SELECT u, v, df, round(list_sum(list_transform(range(df // 2), lambda i: exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1)))), 8) AS p
FROM ({_assoc_sql(EV, _sql("bn_ev"))}) WHERE df % 2 = 0""",
)
def _(spark, sf):
    return assoc.with_p(_association(spark, sf, "bn_ev", EV)).where("df % 2 = 0").select("u", "v", "df", F.round("p", 8).alias("p"))


def _cand_sql(strength: str, keep: str) -> str:
    return f"""
WITH a AS ({_assoc_sql(LI, _sql("bn_li"))}), b AS (SELECT u, v, {strength} AS s FROM a WHERE {keep}),
c AS (SELECT v, u, s FROM b UNION ALL SELECT u, v, s FROM b)
SELECT v, u, s AS strength FROM c QUALIFY row_number() OVER (PARTITION BY v ORDER BY s DESC, u) <= 3"""


@query("cand_topk_mi", _cand_sql("round(mi, 9)", "true"))
def _(spark, sf):
    return assoc.candidates(_association(spark, sf).withColumn("mi", F.round("mi", 9)), "mi", 3)


@query("cand_topk_chi2")
def _(spark, sf):
    return assoc.candidates(_association(spark, sf), "chi2", 3, p_threshold=0.5)


# --- learning -----------------------------------------------------------------------------------------------

_STEP = [(v, ()) for v in range(6)] + [(v, (u,)) for v in range(6) for u in range(6) if u != v]


@query(
    "greedy_step_add",
    f"""
WITH s AS ({_score_sql(_STEP, DEP, _sql("bn_dep"))}),
d AS (SELECT s.v, CAST([{", ".join(str(f[1][0]) for f in _STEP[6:])}][s.family - 5] AS INT) AS u, round(s.bic - e.bic, 4) AS delta
      FROM s JOIN s e ON e.family = s.v WHERE s.family >= 6)
SELECT u, v, delta FROM d ORDER BY delta DESC, v, u LIMIT 1""",
)
def _(spark, sf):
    """The best first addition to an empty network."""
    s = scores.score_families(view(spark, sf, "bn_dep"), _STEP, DEP, ESS).select("family", "v", "bic")
    empty = s.where("family < 6").select("v", F.col("bic").alias("base"))
    u = F.element_at(F.array(*[F.lit(f[1][0]) for f in _STEP[6:]]), F.col("family") - 5)
    return s.where("family >= 6").join(empty, "v").select(u.alias("u"), "v", F.round(F.col("bic") - F.col("base"), 4).alias("delta")).orderBy(F.col("delta").desc(), "v", "u").limit(1)


_SMALL = search.Config(tabu_tenure=0, assoc_rows=0)


@query("hill_climb_edges")
def _(spark, sf):
    return search.learn(view(spark, sf, "bn_dep"), _SMALL, vs=DEP).edge_frame(spark)


@query("tabu_edges")
def _(spark, sf):
    return search.learn(view(spark, sf, "bn_dep"), search.Config(max_iter=60, tabu_tenure=3, assoc_rows=0), vs=DEP).edge_frame(spark)


@query("bootstrap_freq")
def _(spark, sf):
    return boot.bootstrap(_keyed(spark, sf), ["key"], 20, (1, 2), search.Config(tabu_tenure=0, assoc_rows=0), names=list("abcdef"))


#: Lines that one row of a group is written out to.
PIECE = 1 << 12


def _keyed(spark, sf):
    """bn_dep with a key: lines have none of their own; a number by all columns tells equal ones apart."""
    columns = ["l_linestatus", "l_quantity", "l_discount", "l_linenumber"]
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(*columns).agg(F.count("*").alias("copies"))
    # Few groups stand for all lines: in pieces, dealt out anew, so that many tasks write the lines out.
    lines = lines.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PIECE).cast("long"))).alias("before"))
    lines = lines.repartition(8 * spark.sparkContext.defaultParallelism, *columns, "before")
    rows = lines.select("*", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + PIECE, F.col("copies")))).alias("copy"))
    a, b, d = F.when(F.col("l_linestatus") == "F", 0).otherwise(1), (F.col("l_quantity") > 25).cast("int"), (F.round(F.col("l_discount") * 100) >= 5).cast("int")
    c = F.greatest(a, b)
    return rows.select(F.xxhash64(*columns, "copy").alias("key"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (c * d).alias("e"), ((F.col("l_linenumber") + c) % 2).cast("int").alias("f"))


# --- importance ---------------------------------------------------------------------------------------------


def _importance_sql(by: str = "") -> str:
    full = [LI_FAMILIES[v] for _, v in sorted(LI_EDGES)]
    less = [(v, tuple(p for p in LI_FAMILIES[v][1] if p != u)) for u, v in sorted(LI_EDGES)]
    g = f"{by}, " if by else ""
    m = len(full)
    parts = []
    for i, ((u, v), f, h) in enumerate(zip(sorted(LI_EDGES), full, less, strict=True)):
        parts.append(f"SELECT {g}{i} AS edge, {u} AS u, {v} AS v, {LI.cards[v]} AS r, {_j(f[1], LI)} AS j, {_j(h[1], LI)} AS h, {LI.names[v]} AS k FROM s")
    keys = f"{g}edge"
    return f"""
WITH x AS ({_score_sql(full + less, LI, _sql("bn_li"), by)}),
d AS (SELECT {g}family % {m} AS edge, {", ".join(f"sum(CASE WHEN family >= {m} THEN {c} ELSE -{c} END) AS d_{c}" for c in ("loglik", "bic", "k2", "bdeu"))} FROM x GROUP BY ALL),
c AS (SELECT {g}edge, u, v, r, j, h, k, count(*)::DOUBLE AS n FROM (WITH s AS MATERIALIZED {_sql("bn_li")} {" UNION ALL ".join(parts)}) GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, j) AS nj, sum(n) OVER (PARTITION BY {keys}, h, k) AS n2, sum(n) OVER (PARTITION BY {keys}, h) AS nj2 FROM c),
l AS (SELECT *, ln((n2 + 1.0 / r) / (nj2 + 1)) - ln((n + 1.0 / r) / (nj + 1)) AS dl FROM w),
q AS (SELECT {keys}, u, v, CAST(sum(n) AS BIGINT) AS n_finite, sum(n * dl) / sum(n) AS mean, sum(n * dl * dl) AS ss FROM l GROUP BY ALL)
SELECT {", ".join(f"q.{by}" for by in [by] if by)}{", " if by else ""}q.u, q.v, round(d_loglik, 4) AS d_loglik, round(d_bic, 4) AS d_bic, round(d_k2, 4) AS d_k2, round(d_bdeu, 4) AS d_bdeu,
       round(mean, 8) AS mean_dlogl, round(CASE WHEN n_finite > 1 THEN sqrt(greatest((ss - n_finite * mean * mean) / (n_finite - 1), 0)) ELSE 0 END, 6) AS std_dlogl, n_finite
FROM q JOIN d ON q.edge = d.edge{" AND q." + by + " = d." + by if by else ""}"""


def _rounded(df: DataFrame) -> DataFrame:
    for c in ("d_loglik", "d_bic", "d_k2", "d_bdeu"):
        df = df.withColumn(c, F.round(c, 4))
    return df.withColumn("mean_dlogl", F.round("mean_dlogl", 8)).withColumn("std_dlogl", F.round("std_dlogl", 6))


@query("edge_importance", _importance_sql())
def _(spark, sf):
    return _rounded(edge_importance(view(spark, sf, "bn_li"), LI_EDGES, LI, 1.0, ESS))


@query("edge_importance_by_group", _importance_sql("grp"))
def _(spark, sf):
    return _rounded(edge_importance(view(spark, sf, "bn_li"), LI_EDGES, LI, 1.0, ESS, by=["grp"]))


# --- preparation --------------------------------------------------------------------------------------------


@query("cpm_log2", f"SELECT gene, sample, round(log2(value / sum(value) OVER (PARTITION BY sample) * 1e6 + 1), 6) AS value FROM {_sql('expr_counts')}")
def _(spark, sf):
    m = prep.log2(prep.normalise(view(spark, sf, "expr_counts"), "cpm"))
    return m.select("gene", "sample", F.round("value", 6).alias("value"))


@query("tpm", f"SELECT gene, sample, round(x / sum(x) OVER (PARTITION BY sample) * 1e6, 4) AS value FROM (SELECT gene, sample, value / (gene_length / 1000.0::DOUBLE) AS x FROM {_sql('expr_counts')})")
def _(spark, sf):
    return prep.normalise(view(spark, sf, "expr_counts"), "tpm").select("gene", "sample", F.round("value", 4).alias("value"))


_STATS = f"(SELECT gene, avg(value) AS mean, var_pop(value) AS variance, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) AS detected FROM ({EMB_SQL}) GROUP BY gene)"


@query("gene_filters", f"SELECT gene, round(mean, 9) AS mean, round(variance, 9) AS variance, round(detected, 9) AS detected FROM {_STATS} WHERE (mean > 0.001 AND detected >= 0.5 OR gene IN (3, 5)) AND variance > 0")
def _(spark, sf):
    s = prep.keep_genes(prep.gene_stats(embeddings(spark, sf)), 0.001, 0.5, ["3", "5"])
    return s.select("gene", *[F.round(c, 9).alias(c) for c in ("mean", "variance", "detected")])


@query("top_variance", f"SELECT gene, round(variance, 9) AS variance FROM {_STATS} QUALIFY row_number() OVER (ORDER BY variance DESC, gene) <= 10 OR gene IN (3, 5)")
def _(spark, sf):
    return prep.top_variance(prep.gene_stats(embeddings(spark, sf)), 10, ["3", "5"]).select("gene", F.round("variance", 9).alias("variance"))


@query("var_quantile", f"SELECT gene FROM {_STATS} WHERE variance >= (SELECT quantile_cont(variance, 0.75) FROM {_STATS})")
def _(spark, sf):
    return prep.variance_quantile(prep.gene_stats(embeddings(spark, sf)), 0.75).select("gene")


_CODES = f"""(WITH m AS ({EMB_SQL}), e AS (SELECT gene, quantile_cont(value, [1 / 3::DOUBLE, 2 / 3::DOUBLE]) AS e FROM m GROUP BY gene)
SELECT m.gene, sample, CAST((value >= e[1])::INT + (value >= e[2])::INT AS INT) AS code FROM m JOIN e ON m.gene = e.gene)"""


@query("disc_quantile", f"SELECT gene, sample, code FROM {_CODES}")
def _(spark, sf):
    return prep.discretise(embeddings(spark, sf)).select("gene", "sample", "code")


@query(
    "disc_uniform",
    f"""WITH m AS ({EMB_SQL}), e AS (SELECT gene, min(value) AS lo, max(value) AS hi FROM m GROUP BY gene)
SELECT m.gene, sample, CAST((value >= lo + (hi - lo) * (1 / 3::DOUBLE))::INT + (value >= lo + (hi - lo) * (2 / 3::DOUBLE))::INT AS INT) AS code FROM m JOIN e ON m.gene = e.gene""",
)
def _(spark, sf):
    return prep.discretise(embeddings(spark, sf), method="uniform").select("gene", "sample", "code")


@query("disc_compact", f"SELECT gene, sample, CAST(dense_rank() OVER (PARTITION BY gene ORDER BY code) - 1 AS INT) AS code FROM (SELECT gene, sample, code * 2 AS code FROM {_CODES})")
def _(spark, sf):
    codes = prep.discretise(embeddings(spark, sf)).withColumn("code", F.col("code") * 2)
    return prep.informative(prep.compact(codes)).select("gene", "sample", "code")


# Customers in debt have no group here, so that some samples stay without one.
_META = "(SELECT c_custkey AS sample, c_mktsegment AS g FROM customer WHERE c_acctbal >= 0)"


@query(
    "sample_align",
    f"""WITH j AS (SELECT o_custkey AS sample, min(o_orderkey) AS ix FROM orders GROUP BY 1), k AS (SELECT j.sample, ix, g AS "group" FROM j JOIN {_META} m ON j.sample = m.sample),
f AS (SELECT "group", min(ix) AS r FROM k GROUP BY 1)
SELECT k.sample, k."group", CAST(row_number() OVER (ORDER BY r, ix) - 1 AS INT) AS row_index FROM k JOIN f ON k."group" = f."group" """,
)
def _(spark, sf):
    return _aligned(spark, sf)


def _aligned(spark, sf):
    samples = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("sample")).agg(F.min("o_orderkey").alias("ix"))
    meta = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal >= 0").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("ix"))
    return prep.align(samples, meta)[0]


@query("group_manifest", f'SELECT g AS "group", count(DISTINCT o_custkey) AS n_samples FROM orders JOIN {_META} ON o_custkey = sample GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 2')
def _(spark, sf):
    return prep.group_manifest(_aligned(spark, sf))


@query(
    "sanitize_labels",
    r"""SELECT DISTINCT p_name AS raw, coalesce(nullif(regexp_replace(regexp_replace(trim(p_name), '[^\p{L}\p{N}_.\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'NA') AS label,
split_part(p_name || '__1', '__', 1) AS base FROM part""",
)
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_name").alias("raw"), sanitize_label(F.col("p_name")).alias("label"), base_name(F.concat("p_name", F.lit("__1"))).alias("base")).distinct()


# --- edge sets ----------------------------------------------------------------------------------------------

#: Networks of the trade between nations. Taken for true: what was traded more in the first half of the years than in the second. For predicted: what
#: two segments make more than two fifths of, turned round where one of them far outweighs the other. Evaluable: what a third one makes a fifth of.
_TRUE = "SELECT CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM {e} WHERE n_early > n - n_early"
_TURNED = "n_building > 2 * n_machinery"
_PRED = f"SELECT CAST(CASE WHEN {_TURNED} THEN v ELSE u END AS INT) AS u, CAST(CASE WHEN {_TURNED} THEN u ELSE v END AS INT) AS v FROM {{e}} WHERE 5 * (n_building + n_machinery) > 2 * n"
_SOME = "SELECT CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM {e} WHERE 5 * n_furniture >= n"
_E, _P = _sql("edges_nat"), _sql("edges_parts")


def _network(spark, sf, text: str) -> DataFrame:
    return spark.sql(text, e=view(spark, sf, "edges_parts"))


def _pair(spark, sf):
    return _network(spark, sf, _TRUE), _network(spark, sf, _PRED)


def _distinct(text: str) -> str:
    return f"(SELECT DISTINCT u, v FROM ({text.format(e=_P)}) x)"


_SETS = f"""WITH t AS {_distinct(_TRUE)}, p AS {_distinct(_PRED)}, st AS (SELECT DISTINCT least(u, v) a, greatest(u, v) b FROM t), sp AS (SELECT DISTINCT least(u, v) a, greatest(u, v) b FROM p),
tp AS (SELECT * FROM t INTERSECT SELECT * FROM p), stp AS (SELECT * FROM st INTERSECT SELECT * FROM sp),
rev AS (SELECT * FROM (SELECT * FROM p EXCEPT SELECT * FROM t) x WHERE EXISTS (SELECT 1 FROM t WHERE t.u = x.v AND t.v = x.u)),
c AS (SELECT (SELECT count(*) FROM t) nt, (SELECT count(*) FROM p) np, (SELECT count(*) FROM tp) ntp, (SELECT count(*) FROM st) nst, (SELECT count(*) FROM sp) nsp, (SELECT count(*) FROM stp) nstp, (SELECT count(*) FROM rev) nr)"""


@query(
    "shd_metrics",
    f"""{_SETS} SELECT nt AS n_true, np AS n_pred, ntp AS tp, np - ntp AS fp, nt - ntp AS fn, nr AS reversed, nst - nstp AS missing, nsp - nstp AS extra, nst - nstp + nsp - nstp + nr AS shd,
round(ntp / np, 9) AS directed_precision, round(ntp / nt, 9) AS directed_recall, round(2 * ntp / (np + nt), 9) AS directed_f1,
round(nstp / nsp, 9) AS skeleton_precision, round(nstp / nst, 9) AS skeleton_recall, round(2 * nstp / (nsp + nst), 9) AS skeleton_f1 FROM c""",
)
def _(spark, sf):
    m = edges.structure_metrics(*_pair(spark, sf))
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query(
    "compare_metrics",
    f"""{_SETS} SELECT nt AS n_true, np AS n_pred, ntp AS tp, np - ntp AS fp, nt - ntp AS fn, nr AS n_reversed, np + nt - 2 * ntp AS symmetric_difference,
round(ntp / np, 9) AS precision, round(ntp / nt, 9) AS recall, round(2 * ntp / (np + nt), 9) AS f1 FROM c""",
)
def _(spark, sf):
    m = edges.comparison(*_pair(spark, sf))
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query(
    "edge_verdicts",
    f"""{_SETS} SELECT u, v, CASE WHEN (u, v) IN (SELECT (u, v) FROM t) THEN 'TP' WHEN (v, u) IN (SELECT (u, v) FROM t) THEN 'FP_reversed' ELSE 'FP' END AS status FROM p
UNION ALL SELECT u, v, 'FN' FROM (SELECT * FROM t EXCEPT SELECT * FROM p)""",
)
def _(spark, sf):
    return edges.verdicts(*_pair(spark, sf))


@query("skeleton", f"SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM {_sql('edges_nat')}")
def _(spark, sf):
    return edges.skeleton(view(spark, sf, "edges_nat"))


@query("two_cycles", f"WITH e AS {_sql('edges_nat')} SELECT x.u, x.v FROM e x JOIN e y ON x.u = y.v AND x.v = y.u WHERE x.u < x.v")
def _(spark, sf):
    return edges.two_cycles(view(spark, sf, "edges_nat"))


@query("eval_pairs", f"{_SETS}, e AS {_distinct(_SOME)} SELECT u, v, 'truth' AS side FROM t WHERE (u, v) IN (SELECT (u, v) FROM e) UNION ALL SELECT u, v, 'pred' FROM p WHERE (least(u, v), greatest(u, v)) IN (SELECT (least(u, v), greatest(u, v)) FROM e)")
def _(spark, sf):
    t, p = edges.restrict(*(x.distinct() for x in _pair(spark, sf)), _network(spark, sf, _SOME))
    return t.withColumn("side", F.lit("truth")).unionByName(p.withColumn("side", F.lit("pred")))


_RARE = "SELECT CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM {e} WHERE n_early > n - n_early AND u < v"
#: Edges' frequencies in three segments, as if these were resamples: a segment's lines, and their share of all.
_SEEDS = ("n_building", "n_machinery", "n_furniture")
_FREQ_SQL = " UNION ALL ".join(f"SELECT {i} AS seed, u, v, {c} AS c, {c} / n::DOUBLE AS prob FROM {_P} e WHERE {c} > 0" for i, c in enumerate(_SEEDS))


def _frequencies(spark, sf) -> DataFrame:
    e = view(spark, sf, "edges_parts")
    seeds = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.col(c).alias("count")) for i, c in enumerate(_SEEDS)])).alias("s")
    return e.select("u", "v", "n", seeds).where("s.count > 0").select("s.seed", "u", "v", "s.count", (F.col("s.count") / F.col("n")).alias("prob"))



@query("descendants", f"WITH RECURSIVE e AS {_distinct(_RARE)}, r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u, v FROM r")
def _(spark, sf):
    return evaluation.reachable(_network(spark, sf, _RARE))


@query("sid")
def _(spark, sf):
    """Of the network that greedy search finds, against the one that made the data."""
    found = search.learn(view(spark, sf, "bn_dep"), _SMALL, vs=DEP)
    return evaluation.sid(spark, 6, [(0, 2), (1, 2), (2, 4), (3, 4), (2, 5)], found.edges)


@query("verdict_counts", f"""{_SETS} SELECT 'TP' AS status, ntp AS n FROM c WHERE ntp > 0 UNION ALL SELECT 'FP_reversed', nr FROM c WHERE nr > 0
UNION ALL SELECT 'FP', np - ntp - nr FROM c WHERE np - ntp - nr > 0 UNION ALL SELECT 'FN', nt - ntp FROM c WHERE nt > ntp""")
def _(spark, sf):
    return workflow.verdict_counts(edges.verdicts(*_pair(spark, sf)))


#: A threshold that no share of a few lines hits, so that rounding decides nothing.
_LEAST_PROB = 0.2037


@query("consensus_edges", f"""WITH f AS ({_FREQ_SQL})
SELECT u, v, CAST(sum(c) AS BIGINT) AS count, round(sum(prob) / 3, 9) AS prob FROM f WHERE u < v GROUP BY u, v HAVING sum(prob) / 3 >= {_LEAST_PROB} AND sum(c) >= 2""")
def _(spark, sf):
    """Edges from a smaller to a larger nation close no cycle, so all past the thresholds stay."""
    return boot.consensus(boot.integrate(_frequencies(spark, sf).where("u < v"), 3), _LEAST_PROB).withColumn("prob", F.round("prob", 9))


#: Edges past the threshold from the most probable on, each kept if no path of those kept leads back: a step of the recursion takes the next edge,
#: and the closure of what is kept is a list of pairs u * 100 + v.
_GREEDY_SQL = f"""WITH RECURSIVE f AS ({_FREQ_SQL}),
i AS (SELECT u, v, CAST(sum(c) AS BIGINT) AS count, round(sum(prob) / 3, 9) AS prob FROM f GROUP BY u, v HAVING round(sum(prob) / 3, 9) >= {_LEAST_PROB} AND sum(c) >= 2),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY prob DESC, u DESC, v DESC) AS place FROM i),
g AS (
  SELECT 0::BIGINT AS place, []::BIGINT[] AS paths, false AS kept
  UNION ALL
  SELECT o.place, CASE WHEN list_contains(paths, o.v * 100 + o.u) THEN paths ELSE list_distinct(list_concat(paths, flatten(list_transform(
           list_concat([o.u], list_transform(list_filter(paths, lambda p: p % 100 = o.u), lambda p: p // 100)),
           lambda a: list_transform(list_concat([o.v], list_transform(list_filter(paths, lambda p: p // 100 = o.v), lambda p: p % 100)), lambda b: a * 100 + b))))) END,
         NOT list_contains(paths, o.v * 100 + o.u)
  FROM g JOIN o ON o.place = g.place + 1)
SELECT u, v, count, prob FROM o JOIN g ON o.place = g.place WHERE kept"""


@query("consensus_greedy", _GREEDY_SQL)
def _(spark, sf):
    """Trade goes both ways, so that most edges past the threshold would close a cycle."""
    return boot.consensus(boot.integrate(_frequencies(spark, sf), 3).withColumn("prob", F.round("prob", 9)), _LEAST_PROB)


@query("bootstrap_integrated", f"""WITH f AS ({_FREQ_SQL})
SELECT u, v, CAST(sum(c) AS BIGINT) AS count, round(sum(prob) / 3, 9) AS prob FROM f GROUP BY u, v""")
def _(spark, sf):
    return boot.integrate(_frequencies(spark, sf), 3).withColumn("prob", F.round("prob", 9))


# --- networks -----------------------------------------------------------------------------------------------

#: A network over the first columns of bn_dep, fitted with a count of 1 added to each cell, and what it is measured against.
_FIT_EDGES, _FIT_LESS = [(0, 2), (1, 2), (0, 3)], [(0, 2)]


def _fitted(spark: SparkSession, sf: str, edges: Sequence[tuple[int, int]]) -> evaluation.Network:
    return evaluation.fit(view(spark, sf, "bn_dep").select(*"abcd"), edges, Variables(tuple("abcd"), (2,) * 4), 1.0)


def _fitted_sql(edges: Sequence[tuple[int, int]], p: str) -> str:
    """All states of a, b, c, d with their probability in the fitted network."""
    factors = []
    for v, ps in families_of(edges, 4):
        own = " AND ".join(f"s.{'abcd'[x]} = g.{'abcd'[x]}" for x in (v, *ps))
        above = " AND ".join(f"s.{'abcd'[x]} = g.{'abcd'[x]}" for x in ps) or "true"
        factors.append(f"((SELECT count(*) FROM s WHERE {own}) + 1.0::DOUBLE) / ((SELECT count(*) FROM s WHERE {above}) + 2.0::DOUBLE)")
    return f"(WITH s AS MATERIALIZED {_sql('bn_dep')} SELECT a, b, c, d, {' * '.join(factors)} AS {p} FROM (SELECT * FROM range(2) w(a), range(2) x(b), range(2) y(c), range(2) z(d)) g)"


@query("joint_distribution", f"SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(c AS INT) AS c, CAST(d AS INT) AS d, round(p, 12) AS p FROM {_fitted_sql(_FIT_EDGES, 'p')}")
def _(spark, sf):
    return evaluation.joint(spark, _fitted(spark, sf, _FIT_EDGES)).withColumn("p", F.round("p", 12))


@query("kl_divergence", f"SELECT round(sum(p * (ln(p) - ln(q))), 9) AS kl FROM {_fitted_sql(_FIT_EDGES, 'p')} JOIN {_fitted_sql(_FIT_LESS, 'q')} USING (a, b, c, d)")
def _(spark, sf):
    """The divergence of a network with fewer edges, both fitted to the data, summed by family."""
    return evaluation.kl_by_family(spark, _fitted(spark, sf, _FIT_EDGES), _fitted(spark, sf, _FIT_LESS)).select(F.round("kl", 9).alias("kl"))


@query("ancestral_sample")
def _(spark, sf):
    """As many draws from the fitted network as the data have rows."""
    n = view(spark, sf, "bn_dep").count()
    return evaluation.sample(spark, _fitted(spark, sf, _FIT_EDGES), n, 7).groupBy(*"abcd").agg(F.count("*").alias("n"))


_BENCH = "SELECT event_type AS network, CAST(user_id % 3 AS INT) AS n_rows, CASE WHEN value > 400 THEN NULL ELSE value END AS shd, CASE WHEN value < 1 THEN CAST('Infinity' AS DOUBLE) WHEN value > 300 THEN CAST('NaN' AS DOUBLE) ELSE value / 7 END AS kl FROM {t}"


@query(
    "benchmark_summary",
    f"""WITH r AS ({_BENCH.format(t="events")}),
l AS (SELECT network, n_rows, 'shd' AS metric, shd AS x FROM r UNION ALL SELECT network, n_rows, 'kl', kl FROM r),
f AS (SELECT network, n_rows, metric, CASE WHEN isfinite(x) THEN x END AS x FROM l)
SELECT network, n_rows, metric, round(avg(x), 6) AS mean, round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 6) AS sd, count(x) AS n, count(*) - count(x) AS n_missing FROM f GROUP BY ALL""",
)
def _(spark, sf):
    rows = spark.sql(_BENCH, t=spark.read.parquet(f"{sf}/events.parquet"))
    return evaluation.benchmark_summary(rows, ["network", "n_rows"], ["shd", "kl"]).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


# --- views of edges -----------------------------------------------------------------------------------------

_ENDS = f"(SELECT u AS node, 1 AS o, 0 AS i FROM {_E} UNION ALL SELECT v, 0, 1 FROM {_E})"
_DEGREES = f"(SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(count(*) AS BIGINT) AS degree FROM {_ENDS} GROUP BY node)"


@query("edge_rank_norm", f"SELECT u, v, w, round((row_number() OVER (ORDER BY w, u, v) - 1) / (count(*) OVER () - 1), 9) AS norm FROM {_E}")
def _(spark, sf):
    return edges.normalised(view(spark, sf, "edges_nat"), "w").select("u", "v", "w", F.round("norm", 9).alias("norm"))


@query(
    "edge_hist32",
    f"""WITH e AS {_E}, l AS (SELECT min(w) AS lo, max(w) AS hi FROM e), b AS (SELECT CAST(least(31, floor((w - lo) / ((hi - lo) / 32))) AS INT) AS bin, count(*) AS n FROM e, l GROUP BY 1),
g AS (SELECT CAST(range AS INT) AS bin, coalesce(n, 0) AS n FROM range(32) LEFT JOIN b ON range = bin)
SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin DESC) AS BIGINT) AS at_least FROM g""",
)
def _(spark, sf):
    return edges.histogram(view(spark, sf, "edges_nat"), "w")


@query("edge_filter_and_or", f"SELECT u, v, 'and' AS how FROM {_E} WHERE n >= 90 AND w <= 6000 UNION ALL SELECT u, v, 'or' FROM {_E} WHERE n >= 120 OR w <= 2000")
def _(spark, sf):
    e = view(spark, sf, "edges_nat")
    a = edges.filtered(e, [edges.condition("n", "ge", 90), edges.condition("w", "le", 6000)]).select("u", "v", F.lit("and").alias("how"))
    return a.unionByName(edges.filtered(e, [edges.condition("n", "ge", 120), edges.condition("w", "le", 2000)], "or").select("u", "v", F.lit("or").alias("how")))


@query("edge_nearest_quantile", f"SELECT CAST(w AS DOUBLE) AS value FROM (SELECT w, row_number() OVER (ORDER BY w) AS place, count(*) OVER () AS n FROM {_E}) WHERE place = floor(0.7 * (n - 1) + 0.5) + 1")
def _(spark, sf):
    return edges.nearest_quantile(view(spark, sf, "edges_nat"), "w", 0.7)


@query("edge_topn", f"SELECT u, v, w, CAST(row_number() OVER (ORDER BY w DESC, u DESC, v DESC) AS INT) AS rank FROM {_E} QUALIFY rank <= 20")
def _(spark, sf):
    return edges.ranked(view(spark, sf, "edges_nat"), "w").where("rank <= 20").select("u", "v", "w", "rank")


@query("edge_topn_by_source", f"SELECT u, v, w FROM {_E} QUALIFY row_number() OVER (PARTITION BY u ORDER BY w DESC, v) <= 2")
def _(spark, sf):
    return edges.top(view(spark, sf, "edges_nat"), "w", 2, by=["u"]).select("u", "v", "w")


@query("node_degree", f"SELECT *, CASE WHEN in_degree = 0 THEN 'source' WHEN out_degree = 0 THEN 'sink' ELSE 'middle' END AS role FROM {_DEGREES}")
def _(spark, sf):
    return edges.degrees(view(spark, sf, "edges_nat"))


@query("hub_subgraph", f"WITH h AS (SELECT node FROM {_DEGREES} ORDER BY degree DESC, node LIMIT 5) SELECT u, v FROM {_E} WHERE u IN (SELECT node FROM h) AND v IN (SELECT node FROM h)")
def _(spark, sf):
    e = view(spark, sf, "edges_nat")
    return edges.induced(e, edges.hubs(e, 5)).select("u", "v")


@query("ego_network", f"WITH t AS {_distinct(_RARE)}, k AS (SELECT 3 AS x UNION SELECT u FROM t WHERE v = 3 UNION SELECT v FROM t WHERE u = 3) SELECT u, v FROM t WHERE u IN (SELECT x FROM k) AND v IN (SELECT x FROM k)")
def _(spark, sf):
    return edges.ego(_network(spark, sf, _RARE).distinct(), spark.createDataFrame([(3,)], "node int")).select("u", "v")


@query("node_neighbours", f"SELECT DISTINCT 'parent' AS side, u AS node FROM {_E} WHERE v = 7 UNION ALL SELECT DISTINCT 'child', v FROM {_E} WHERE u = 7")
def _(spark, sf):
    return workflow.neighbours_of(view(spark, sf, "edges_nat"), 7)


@query("strongest_share", f"WITH r AS (SELECT *, row_number() OVER (ORDER BY w) AS place, count(*) OVER () AS k FROM {_E}) SELECT u, v, w FROM r WHERE w >= (SELECT w FROM r WHERE place = floor(0.7::DOUBLE * (k - 1) + 0.5) + 1)")
def _(spark, sf):
    return workflow.strongest_share(view(spark, sf, "edges_nat"), "w").select("u", "v", "w")


@query("node_search", f"SELECT n_name AS name, degree FROM {_DEGREES} d JOIN nation ON node = n_nationkey WHERE contains(lower(n_name), 'i') ORDER BY degree DESC, name LIMIT 40")
def _(spark, sf):
    nodes = edges.degrees(view(spark, sf, "edges_nat")).join(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name")), "node")
    return workflow.find_nodes(nodes.select("name", "degree"), "I")


@query("group_tops", f"SELECT u % 5 AS grp, CAST(row_number() OVER (PARTITION BY u % 5 ORDER BY w DESC, u, v) AS INT) AS place, u, v, w AS value, (SELECT max(w) FROM {_E}) AS greatest FROM {_E} QUALIFY place <= 3")
def _(spark, sf):
    return workflow.group_tops(view(spark, sf, "edges_nat").withColumn("grp", F.col("u") % 5), "grp", "w", 3)


@query("network_payload", f"WITH e AS {_E}, d AS {_DEGREES} SELECT e.u, e.v, e.n, CASE WHEN e.n > 90 THEN e.w END AS importance, CASE WHEN e.n % 2 = 0 THEN 0.5::DOUBLE END AS prob, a.degree AS u_degree, b.degree AS v_degree FROM e JOIN d a ON e.u = a.node JOIN d b ON e.v = b.node")
def _(spark, sf):
    e = view(spark, sf, "edges_nat")
    imp = e.where("n > 90").select("u", "v", F.col("w").alias("importance"))
    return edges.payload(e.select("u", "v", "n"), imp, e.where("n % 2 = 0").select("u", "v", F.lit(0.5).alias("prob")))


# --- profiles -----------------------------------------------------------------------------------------------

_NUM = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query(
    "matrix_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, CAST(min(({c} = floor({c}))::INT) AS INT) AS is_integer, count(DISTINCT {c}) AS n_unique,
round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0 END), 9) AS zero_frac, count(*) - count({c}) AS n_missing, CAST((min({c}) = max({c}))::INT AS INT) AS is_constant FROM lineitem"""
        for c in _NUM
    ),
)
def _(spark, sf):
    return profile.matrix_profile(spark.read.parquet(f"{sf}/lineitem.parquet"), _NUM).withColumn("zero_frac", F.round("zero_frac", 9))


@query("variance_profile", f"WITH s AS {_STATS}, q AS (SELECT quantile_cont(variance, [0, 0.25, 0.5, 0.75, 1]) AS q FROM s) SELECT {', '.join(f'round(q[{i + 1}], 9) AS q{i}' for i in range(5))}, (SELECT count(*) FROM s WHERE variance < q[3] / 2) AS n_low FROM q")
def _(spark, sf):
    p = profile.variance_profile(prep.gene_stats(embeddings(spark, sf)))
    return p.select(*[F.round(f"q{i}", 9).alias(f"q{i}") for i in range(5)], "n_low")


_WIDE = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")


@query(
    "column_moments",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_missing, count_if({c} <> 0) AS n_nonzero, round(avg({c}::DOUBLE) / max({c}::DOUBLE), 10) AS relative_mean, round(var_pop({c}::DOUBLE) / (avg({c}::DOUBLE) * avg({c}::DOUBLE)), 8) AS relative_variance,
min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum, bool_and({c} = round({c})) AS is_integer, {"count(DISTINCT " + c + ")" if c != "l_extendedprice" else "NULL::BIGINT"} AS n_levels FROM lineitem"""
        for c in _WIDE
    ),
)
def _(spark, sf):
    """Levels are exact up to a bound, which only prices pass."""
    stats = moments.column_stats(spark.read.parquet(f"{sf}/lineitem.parquet"), _WIDE).drop("digest")
    levels = F.when(F.col("column") != "l_extendedprice", F.col("n_levels"))
    relative = F.round(F.col("variance") / (F.col("mean") * F.col("mean")), 8).alias("relative_variance")
    mean = F.round(F.col("mean") / F.col("maximum"), 10).alias("relative_mean")
    return stats.select("*", relative, mean).drop("variance", "mean").withColumn("n_levels", levels)


@query("duplicate_rows", "SELECT copies, count(*) AS n_contents, CAST(sum(copies) AS BIGINT) AS n_rows FROM (SELECT count(*) AS copies FROM embeddings GROUP BY embedding) GROUP BY copies")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    d = e.select(F.max(F.size("embedding"))).first()[0]
    return moments.duplicate_rows(e.select(*[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(d)]), [f"e{i}" for i in range(d)])


@query("importance_or_zero", f"WITH e AS {_sql('edges_nat')} SELECT u, v, CASE WHEN n > 90 THEN w ELSE 0 END::DOUBLE AS importance FROM e")
def _(spark, sf):
    e = view(spark, sf, "edges_nat")
    return edges.with_importance(e.select("u", "v"), e.where("n > 90").select("u", "v", F.col("w").alias("importance")))
