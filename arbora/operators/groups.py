"""Groups of the rows of a matrix, and the variables that a study looks at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.text import base_name, sanitize_label

from .order import numbered

#: Groups of fewer rows are left out of analyses.
LEAST = 2


def _checked(groups: DataFrame, rows: int, what: str) -> DataFrame:
    """groups (row_index, group), if they are as many as the matrix has rows and each has one of its indices."""
    r = groups.agg(F.count("*").alias("n"), F.countDistinct("row_index").alias("places"), F.min("row_index").alias("least"), F.max("row_index").alias("most")).first()
    if r.n != rows or (rows and (r.places, r.least, r.most) != (rows, 0, rows - 1)):
        raise ValueError(f"{what}: {r.n} rows with {r.places} places for a matrix of {rows}")
    return groups


def from_samples(samples: DataFrame, rows: int, group: str = "group") -> DataFrame:
    """row_index, group of a table of samples that says each one's row (row_index) and group. Labels are made safe; it must cover the matrix."""
    return _checked(samples.select(F.col("row_index").cast("long").alias("row_index"), sanitize_label(F.col(group)).alias("group")), rows, "samples")


def from_metadata(meta: DataFrame, rows: int, order: Sequence[Column | str], group: str = "group") -> DataFrame:
    """row_index, group of metadata that stand in the matrix's order: their rows in that order are its rows. Another number of rows raises."""
    placed = numbered(meta.select(sanitize_label(F.col(group)).alias("group"), *[F.col(c) if isinstance(c, str) else c for c in order if c != group]), order, "row_index")
    return _checked(placed.select("row_index", "group"), rows, "metadata")


def from_sizes(spark: SparkSession, labels: Sequence[str], sizes: Sequence[int], rows: int) -> DataFrame:
    """row_index, group: the first rows belong to the first label, as many as its size, and so on. Sizes must add up to the matrix's rows."""
    if len(labels) != len(sizes) or any(n < 0 for n in sizes):
        raise ValueError(f"{len(labels)} labels and {len(sizes)} sizes, of which none may be negative")
    if sum(sizes) != rows:
        raise ValueError(f"sizes add up to {sum(sizes)} for a matrix of {rows} rows")
    if not labels:
        return spark.createDataFrame([], "row_index long, group string")
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    place = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda e: e <= F.col("id")))
    return spark.range(rows).select(F.col("id").alias("row_index"), sanitize_label(F.element_at(F.array(*[F.lit(x) for x in labels]), place + 1)).alias("group"))


def sizes(groups: DataFrame, least: int = LEAST) -> DataFrame:
    """group, n_rows, first (its first row's index, by which groups are ordered), enough (it has at least so many rows)."""
    return groups.groupBy("group").agg(F.count("*").alias("n_rows"), F.min("row_index").alias("first")).withColumn("enough", F.col("n_rows") >= least)


def targets(spark: SparkSession, path: str | None = None, var_map: DataFrame | None = None) -> DataFrame:
    """name: the listed variables of a file (a name a line, # begins a comment line), or without one those that the map of variables marks
    as listed; none without either."""
    if path is not None:
        lines = spark.read.text(path).select(F.trim("value").alias("name"))
        return lines.where("name <> '' AND name NOT LIKE '#%'").distinct()
    if var_map is not None:
        return var_map.where("whitelisted = 1").select(F.col("gene_name").alias("name")).distinct()
    return spark.createDataFrame([], "name string")


def with_target(nodes: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """nodes with target: their name, or it without its disambiguating suffix, is among the wanted ones."""
    keys = wanted.select(F.col("name").alias("_wanted")).distinct()
    own = nodes.select(name).distinct()
    hit = own.select(name, F.explode(F.array_distinct(F.array(F.col(name), base_name(F.col(name))))).alias("_key"))
    hit = hit.join(keys, F.col("_key") == F.col("_wanted"), "left_semi").select(F.col(name).alias("_hit")).distinct()
    return nodes.join(hit, F.col(name).eqNullSafe(F.col("_hit")), "left").withColumn("target", F.col("_hit").isNotNull()).drop("_hit")
