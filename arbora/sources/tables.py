"""Readers and writers of discrete matrices, edge lists, counts and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.operators import order as order_
from arbora.operators.counts import Family, Variables

COUNTS = "v int, j long, k string, n long"
IMPORTANCE = "u int, v int, d_loglik double, d_bic double, d_k2 double, d_bdeu double, mean_dlogl double, std_dlogl double"


def _header(spark: SparkSession, path: str) -> tuple[list[str], str]:
    line = spark.read.text(path).first()[0]
    sep = "\t" if "\t" in line else ","
    return [x.strip() for x in line.split(sep)], sep


def read_discrete(spark: SparkSession, path: str) -> DataFrame:
    """A matrix of states with a header line, tab or comma separated. Cells that are not integers, and lines of another width, raise."""
    names, sep = _header(spark, path)
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in names])
    return spark.read.csv(path, header=True, sep=sep, schema=schema, mode="FAILFAST", enforceSchema=True)


def read_edges(spark: SparkSession, path: str, vs: Variables | None = None) -> DataFrame:
    """u, v of a list of edges by index or, with vs, by index or name; tab, comma or space separated; # comments and a header word are
    skipped, repeated edges count once. Loops, and with vs places and names that no variable has, raise.
    """
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT ltrim(value) LIKE '#%'")
    p = F.split(F.trim("value"), r"[\t, ]+")
    rows = lines.select(p[0].alias("a"), p[1].alias("b")).where(~F.lower("a").isin("u", "parent", "from", "source"))

    def place(c: str) -> Column:
        index = F.when(F.col(c).rlike("^-?[0-9]+$"), F.col(c).cast("int"))
        if vs is not None:
            known = F.map_from_arrays(F.array(*[F.lit(n) for n in vs.names]), F.array(*[F.lit(i) for i in range(len(vs.names))]))
            index = F.coalesce(F.try_element_at(known, F.col(c)), index)
            index = F.when((index >= 0) & (index < len(vs.names)), index)
        return index

    out = rows.select(place("a").alias("u"), place("b").alias("v"), F.concat_ws(" -> ", "a", "b").alias("edge"))
    good = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    return out.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not an edge of the network: "), "edge")).isNotNull())).select("u", "v").distinct()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """family, v, j, k, n of an exported counts table; totals (k = *) and comments are left out, repeated cells added."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=COUNTS).where("v IS NOT NULL")
    k = F.expr("try_cast(replace(k, '\"', '') AS int)")
    return rows.select(F.col("v").alias("family"), "v", "j", k.alias("k"), "n").where("k IS NOT NULL").groupBy("family", "v", "j", "k").agg(F.sum("n").alias("n"))


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=IMPORTANCE)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One name a line, # comments."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("name")).where("name <> ''").distinct()


def read_matrix(spark: SparkSession, path: str, missing: Sequence[str] = ("", "NA", "NaN", "nan")) -> DataFrame:
    """A numeric matrix with a header; missing words become null."""
    names, sep = _header(spark, path)
    raw = spark.read.csv(path, header=True, sep=sep, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), mode="FAILFAST")
    return raw.select(*[F.when(~F.trim(n).isin(list(missing)), F.col(n).cast("double")).alias(n) for n in names])


def stack(frames: Sequence[tuple[str, DataFrame]], label: str = "condition") -> DataFrame:
    """Tables of the same columns one below the other, with the name of each."""
    out = None
    for name, df in frames:
        if out is not None and set(df.columns) != set(out.columns) - {label}:
            raise ValueError(f"{name} has other columns")
        one = df.withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def check_names(edges: DataFrame, vs: Variables) -> DataFrame:
    """Rows of named edges (u, v, u_name, v_name) whose names are not those of the columns."""
    names = edges.sparkSession.createDataFrame([(i, n) for i, n in enumerate(vs.names)], "i int, n string")
    a, b = names.withColumnsRenamed({"i": "u", "n": "nu"}), names.withColumnsRenamed({"i": "v", "n": "nv"})
    return edges.join(a, "u", "left").join(b, "v", "left").where(~(F.col("nu").eqNullSafe(F.col("u_name")) & F.col("nv").eqNullSafe(F.col("v_name"))))


def write_counts(counts: DataFrame, families: Sequence[Family], vs: Variables, path: str) -> None:
    """Counts as tab-separated text: a family's description as comments, its cells, and its configurations' totals (*)."""
    spark = counts.sparkSession
    heads = []
    for i, (v, ps) in enumerate(families):
        about = [f"# node_name\t{vs.names[v]}", f"# parents_indices\t{','.join(map(str, ps))}", f"# parents_names\t{','.join(vs.names[p] for p in ps)}",
                 f"# parents_cardinalities\t{','.join(str(vs.cards[p]) for p in ps)}", f"# child_cardinality\t{vs.cards[v]}"]
        heads += [(i, -1, n, line) for n, line in enumerate(about)]
    totals = counts.groupBy("family", "v", "j").agg(F.sum("n").alias("n")).select("family", "j", F.lit(1 << 30).alias("k"), F.concat_ws("\t", "v", "j", F.lit("*"), "n").alias("line"))
    cells = counts.where("n > 0").select("family", "j", "k", F.concat_ws("\t", "v", "j", "k", "n").alias("line"))
    rows = spark.createDataFrame(heads, "family int, j long, k int, line string").unionByName(cells).unionByName(totals)
    rows.repartitionByRange("family", "j", "k").sortWithinPartitions("family", "j", "k").select("line").write.mode("overwrite").text(path)


def write_named(edges: DataFrame, path: str) -> None:
    """Edges with indices and names in one table, ordered."""
    edges.orderBy("u", "v").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_groups(codes: DataFrame, path: str) -> DataFrame:
    """A folder for each group's matrix; returns the manifest."""
    codes.write.mode("overwrite").partitionBy("group").parquet(path)
    return codes.groupBy("group").agg(F.count("*").alias("n_rows"))


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """df with each row's number in the order, from 0."""
    return order_.numbered(df, order, name)
