"""Preparation of long matrices (gene, sample, value): normalising, filtering, discretising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.text import sanitize_label

from .order import numbered


def melt(wide: DataFrame, ident: str, samples: Sequence[str], name: str = "sample") -> DataFrame:
    """A row for each gene and sample; what is not a number counts as 0."""
    typed = wide.select(F.col(ident).cast("string").alias("gene"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in samples])
    return typed.unpivot(["gene"], list(samples), name, "value").withColumn("value", F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(0.0)))


def normalise(m: DataFrame, method: str = "none", scale: float = 1e6, length: str = "gene_length") -> DataFrame:
    """cpm: parts of a sample's sum; tpm: of its sum of values over length in kilobases, unusable lengths counting 0. A zero sum gives 0."""
    if method == "none":
        return m
    x = F.col("value").cast("double")
    if method == "tpm":
        x = F.when(F.col(length) > 0, x / (F.col(length) / 1000.0)).otherwise(0.0)
    elif method != "cpm":
        raise ValueError("method is none, cpm or tpm")
    total = m.withColumn("_x", x)
    sums = total.groupBy("sample").agg(F.sum("_x").alias("_t"))
    return total.join(sums, "sample").withColumn("value", F.when(F.col("_t") > 0, F.col("_x") / F.col("_t") * scale).otherwise(0.0)).drop("_x", "_t")


def log2(m: DataFrame, pseudocount: float = 1.0, clip: bool = False) -> DataFrame:
    x = F.greatest("value", F.lit(0.0)) if clip else F.col("value")
    return m.withColumn("value", F.log2(x + pseudocount))


def gene_stats(m: DataFrame, detect: float = 0.0) -> DataFrame:
    """gene, mean, variance (population), detected (share of values above detect)."""
    return m.groupBy("gene").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.avg((F.col("value") > detect).cast("double")).alias("detected"))


def keep_genes(stats: DataFrame, min_mean: float = 0.0, min_detected: float = 0.0, keep: Sequence[str] = (), constant: bool = False) -> DataFrame:
    """Genes whose mean exceeds min_mean and that are detected often enough, or are on the list; constant genes always go unless constant."""
    listed = F.col("gene").cast("string").isin(list(keep)) if keep else F.lit(False)
    ok = F.lit(True)
    if min_mean > 0:
        ok = ok & (F.col("mean") > min_mean)
    if min_detected > 0:
        ok = ok & (F.col("detected") >= min_detected)
    kept = stats.where(ok | listed)
    return kept if constant else kept.where("variance > 0")


def top_variance(stats: DataFrame, n: int, keep: Sequence[str] = (), including: bool = False) -> DataFrame:
    """The n genes of greatest variance plus the listed ones. Ties by gene. including: n genes in all, the listed ones first, and these by variance
    too where they are more than n."""
    listed = F.col("gene").cast("string").isin(list(keep)) if keep else F.lit(False)
    order = [F.col("variance").desc(), F.col("gene")]
    if including:
        return stats.orderBy(listed.desc(), *order).limit(n)
    return stats.orderBy(*order).limit(n).unionByName(stats.where(listed)).dropDuplicates(["gene"]) if keep else stats.orderBy(*order).limit(n)


def variance_quantile(stats: DataFrame, q: float) -> DataFrame:
    """Genes of a variance of at least the quantile (linear interpolation)."""
    level = stats.agg(F.percentile("variance", F.lit(q)).alias("_q"))
    return stats.crossJoin(F.broadcast(level)).where("variance >= _q").drop("_q")  # one row is broadcast


def _code(edges: Column, x: Column) -> Column:
    return F.aggregate(edges, F.lit(0), lambda n, e: n + (x >= e).cast("int"))


def discretise(m: DataFrame, bins: int = 3, method: str = "quantile", distinct_edges: bool = False) -> DataFrame:
    """m with code: how many of the gene's inner edges are at most the value.

    quantile: edges at k / bins by linear interpolation; uniform: equal steps from least to greatest, constant genes 0.
    distinct_edges also drops repeated edges and takes the median for missing values.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    x = F.when(~F.isnan("value"), F.col("value"))
    g = m.withColumn("_x", x)
    if method == "quantile":
        agg = g.groupBy("gene").agg(F.percentile("_x", F.array(*[F.lit(k / bins) for k in range(1, bins)])).alias("_e"), F.percentile("_x", F.lit(0.5)).alias("_m"))
    elif method == "uniform":
        lo, hi = F.min("_x"), F.max("_x")
        agg = g.groupBy("gene").agg(F.when(hi > lo, F.array(*[lo + (hi - lo) * (k / bins) for k in range(1, bins)])).otherwise(F.array().cast("array<double>")).alias("_e"), F.percentile("_x", F.lit(0.5)).alias("_m"))
    else:
        raise ValueError("method is quantile or uniform")
    edges = F.array_distinct("_e") if distinct_edges else F.col("_e")
    value = F.coalesce("_x", "_m") if distinct_edges else F.col("_x")
    return g.join(agg, "gene").withColumn("code", F.coalesce(_code(edges, value), F.lit(0))).drop("_x", "_e", "_m")


def compact(codes: DataFrame) -> DataFrame:
    """codes with each gene's used levels renumbered from 0, in order."""
    levels = codes.select("gene", "code").distinct()
    levels = levels.withColumn("_new", F.row_number().over(Window.partitionBy("gene").orderBy("code")) - 1)
    return codes.join(levels, ["gene", "code"]).withColumn("code", F.col("_new")).drop("_new")


def informative(codes: DataFrame) -> DataFrame:
    """Rows of genes that use at least two levels."""
    return codes.join(codes.groupBy("gene").agg(F.countDistinct("code").alias("_n")).where("_n >= 2").select("gene"), "gene", "left_semi")


def to_wide(codes: DataFrame, genes: Sequence[str]) -> DataFrame:
    """One row for each sample, one column for each gene of the list."""
    return codes.groupBy("sample").pivot("gene", list(genes)).agg(F.first("code"))


def align(samples: DataFrame, meta: DataFrame, groups: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """samples (sample, ix) with their group and row index in group order, and what either side lacks.

    Of repeated metadata rows the last (largest ix) counts. Groups stand in the given order or in that of first appearance.
    """
    last = meta.withColumn("_n", F.row_number().over(Window.partitionBy("sample").orderBy(F.col("ix").desc()))).where("_n = 1").select("sample", sanitize_label(F.col("group")).alias("group"))
    both = samples.join(last, "sample")
    if groups is not None:
        rank = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group"))
        both = both.where(rank > 0).withColumn("_r", rank)
    else:
        both = both.join(both.groupBy("group").agg(F.min("ix").alias("_r")), "group")
    aligned = numbered(both.select("sample", "group", "_r", "ix"), ["_r", "ix"], "row_index").select("sample", "group", "row_index")
    return aligned, samples.join(last, "sample", "left_anti"), last.join(samples, "sample", "left_anti")


def group_manifest(aligned: DataFrame, least: int = 2) -> DataFrame:
    """group, n_samples of groups with enough samples."""
    return aligned.groupBy("group").agg(F.count("*").alias("n_samples")).where(F.col("n_samples") >= least)


def disambiguate(names: DataFrame) -> DataFrame:
    """names (ix, base, ident) with name: base for its first row, base__ident for later ones, and base__ident_n where that too is taken."""
    w = Window.partitionBy("base").orderBy("ix")
    one = names.withColumn("name", F.when(F.row_number().over(w) == 1, F.col("base")).otherwise(F.concat_ws("__", "base", "ident")))
    w = Window.partitionBy("name").orderBy("ix")
    n = F.row_number().over(w)
    return one.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.concat_ws("_", "name", n.cast("string"))))
