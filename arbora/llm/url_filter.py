"""Operator 9: URL filter lists by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, set_aside, spread_join, stored

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the short hash prefix on which urls and rules are joined (32 bits).
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z lower-cased; path: then up to ?, # or end. Null or no ://: both empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWERED), path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: action (allow or block), host, path. A rule fits its host and all subdomains where the url's path starts
    with the rule's; the longest rule (code points of host and path) wins, block before allow, then the rule's text.
    Each url is expanded only into the shapes that rules have (labels of the host, length of the path), so any rule path
    works and the expansion is bounded by the rule list. Urls and rules meet on a 32-bit prefix of SHA-256; the whole
    digest is then compared. Null or malformed urls have an empty host and path. Repeated rows stay, an empty table gives an
    empty one; columns of pages named like the new ones are replaced, all others are kept whatever their names.
    """
    new = ["host", "path", "rule", "verdict"]
    pages, back = set_aside(pages, [url], new)
    host, path = host_and_path(F.col(url))
    rules = (
        rules.where("action IS NOT NULL AND host IS NOT NULL AND host <> ''")
        .select("action", F.translate("host", UPPER, LOWERED).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .distinct()
        .select(F.concat("host", "path").alias("rule"), "action", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
    )
    # A few numbers: shapes are pairs of a label count and a path length, however many rules there are.
    shapes = [(r.labels, r.chars) for r in rules.select("labels", "chars").distinct().orderBy("labels", "chars").collect()]
    ranked = rules.select(
        F.sha2("rule", 256).alias("digest"), F.struct(F.length("rule").alias("len"), F.when(F.col("action") == "block", 1).otherwise(0).alias("hard"), "rule", "action").alias("rank")
    ).withColumn("short", F.substring("digest", 1, SHORT))
    kept = pages.columns
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not shapes:
        return back(rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
    labels = F.split("host", r"\.")
    expressions = [
        F.when(
            (F.size(labels) >= n) & (F.length("path") >= m),
            F.concat(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."), F.substring("path", 1, m)),
        )
        for n, m in shapes
    ]
    # Judged once for each distinct host and path, so that a hot url costs one row.
    places = rows.groupBy("host", "path").agg(F.count("*").alias("copies"))
    asked = (
        places.select("host", "path", "copies", F.explode(F.array_compact(F.array(*expressions))).alias("e"))
        .select("host", "path", "copies", F.sha2("e", 256).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    best = asked.join(ranked, "short").where(F.col("full") == F.col("digest")).groupBy("host", "path", "copies").agg(F.max("rank").alias("rank"))
    # The verdicts go back to the rows by one key, of hot places by a broadcast.
    place, rank = fresh(rows.columns, "place", "rank")
    best = best.select(_place().alias(place), "copies", F.col("rank").alias(rank))
    judged = spread_join(rows.withColumn(place, _place()), stored(best, "url-places"), place, "copies", [rank])
    return back(judged.select(*kept, "host", "path", F.col(f"{rank}.rule").alias("rule"), F.coalesce(f"{rank}.action", F.lit(default)).alias("verdict")))


def _place() -> Column:
    """host and path as one string: a host has no slash, and a path that is not empty begins with one."""
    return F.concat("host", "path")
