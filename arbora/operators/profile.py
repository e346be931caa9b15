"""Profiles of matrices and the parameters they suggest."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, minimum, maximum, is_integer, n_unique, zero_frac, n_missing, is_constant of numeric columns, in one pass over their long form."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    x = F.col("value")
    out = long.groupBy("column").agg(
        F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.min((x == F.floor(x)).cast("int")).alias("is_integer"), F.countDistinct(x).alias("n_unique"),
        F.avg((x == 0).cast("double")).alias("zero_frac"), F.count_if(x.isNull()).alias("n_missing"),
    )
    return out.withColumn("is_constant", (F.col("minimum") == F.col("maximum")).cast("int"))


def variance_profile(stats: DataFrame) -> DataFrame:
    """One row: quartiles of the variance and how many genes lie under half the median."""
    q = stats.agg(F.percentile("variance", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    low = stats.crossJoin(F.broadcast(q)).agg(F.count_if(F.col("variance") < F.col("q")[2] / 2).alias("n_low"))  # one row is broadcast
    return q.crossJoin(F.broadcast(low)).select(*[F.col("q")[i].alias(f"q{i}") for i in range(5)], "n_low")


#: Bounds of the kinds of values (fixed values): states and greatest state of discrete data, counts' and logarithms' greatest value, linear values' least greatest one.
STATES, GREATEST_STATE, COUNTS_ABOVE, LOGS_UP_TO, LINEAR_ABOVE = 12, 11, 50, 30, 100


def value_kind(minimum: float | None, maximum: float | None, integer: bool, n_unique: int) -> str:
    """discretized, raw_counts, log_transformed, linear_normalized or continuous_unknown, tested in this order; unknown without any value."""
    if minimum is None or maximum is None:
        return "unknown"
    if integer and minimum >= 0 and n_unique <= STATES and maximum <= GREATEST_STATE:
        return "discretized"
    if integer and maximum > COUNTS_ABOVE:
        return "raw_counts"
    if minimum >= 0 and maximum <= LOGS_UP_TO:
        return "log_transformed"
    return "linear_normalized" if maximum > LINEAR_ABOVE else "continuous_unknown"


def effective_parents(rows: int, card: int, most: int = 3) -> int:
    """Parents for which a table still has about ten rows a cell."""
    if rows < 10 * card:
        return 0
    return min(most, math.floor(math.log(rows / 10) / math.log(card) + 1e-9))


def suggest(rows: int, variables: int, high_variance: int | None = None, cpus: int = 8) -> dict[str, int]:
    """Bins, parents, genes, iterations, seeds and resamples for a matrix of this size."""
    bins = 3 if effective_parents(rows, 3) >= 2 else 2
    parents = max(1, min(3, effective_parents(rows, bins)))
    genes = variables
    if variables > 500:
        genes = 500
    elif high_variance is not None and variables - high_variance > 0.15 * variables:
        genes = max(20, high_variance)
    up = lambda x: max(500, math.ceil(x / 100) * 100)
    seeds = min(cpus, 10)
    return {"n_bins": bins, "max_parents": parents, "top_var": genes, "iters": up(3 * genes * parents), "iters_bootstrap": up(genes * parents), "seeds": seeds, "bootstrap": math.ceil(200 / seeds)}


#: Parts of names (fixed values): of columns that hold genes' identifiers, and of numeric columns that describe genes and are no samples.
GENE_ID_HINTS = ("ens", "gene", "symbol", "id", "name", "probe", "feature", "protein")
NUMERIC_ANNOTATION_HINTS = ("length", "len", "width", "chr", "chrom", "start", "end", "strand", "biotype", "exon", "gc_content", "tss", "entrez", "locus", "position")


def numeric_annotation(column: str) -> bool:
    """Whether a numeric column's name says that it describes genes."""
    return any(h in column.lower() for h in NUMERIC_ANNOTATION_HINTS)


def orientation(df: DataFrame, numeric_share: float = 0.9) -> dict:
    """genes_in_rows, evidence (of three: a column that is no number, more rows than numeric columns, a first column called like a gene's
    identifier; two make it so), rows, samples (numeric columns, without those that describe genes if genes are in rows), annotations.

    A column counts as numeric if more than numeric_share of its cells read as numbers. One pass, a number a column.
    """
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    r = df.agg(F.count("*").alias("n"), *[F.count(F.expr(f"try_cast({q} AS double)")).alias(f"c{i}") for i, q in enumerate(quoted)]).first()
    numeric = [c for i, c in enumerate(df.columns) if r.n and r[f"c{i}"] > numeric_share * r.n]
    others = [c for c in df.columns if c not in numeric]
    evidence = [bool(others), r.n > len(numeric), any(h in df.columns[0].lower() for h in GENE_ID_HINTS)]
    in_rows = sum(evidence) >= 2
    about = [c for c in numeric if numeric_annotation(c)] if in_rows else []
    return {"genes_in_rows": in_rows, "evidence": evidence, "rows": r.n, "samples": [c for c in numeric if c not in about], "annotations": [*others, *about]}
