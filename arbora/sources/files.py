"""Readers and writers of the tables that a study exchanges: counts with their families, probabilities, bootstrap and consensus
edges, importance, verdicts, expression matrices with their samples, evaluation records."""

from __future__ import annotations

import csv
import math
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions.text import sanitize_label
from arbora.operators.counts import Family, Variables, normal
from arbora.operators.order import numbered_blocks
from arbora.operators.prep import melt
from arbora.operators.scores import probabilities
from .tables import IMPORTANCE, read_counts

FREQUENCIES = "u int, v int, count long, prob double"
VAR_MAP = "index int, column_name string, gene_id string, gene_name string, variance double, detected_frac double, used_levels int, whitelisted int"


def numbered_lines(spark: SparkSession, path: str, where: str = "true") -> DataFrame:
    """value, file, line of the lines of text files that meet a condition on their value, counted from 0 within their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return numbered_blocks(lines.where(where), "file", "block", "line").select("value", "file", "line")


def read_families(spark: SparkSession, path: str) -> tuple[list[Family], Variables]:
    """The families and variables that the comments of an exported counts table describe: a block for each node, in node order.

    Only comment lines, five for each node, reach the driver.
    """
    names, cards, parents = [], [], []
    for r in numbered_lines(spark, path).where("value LIKE '#%'").orderBy("file", "line").collect():
        field, _, value = r.value.lstrip("# ").partition("\t")
        if field == "node_name":
            names.append(value)
        elif field == "child_cardinality":
            cards.append(int(value))
        elif field == "parents_indices":
            parents.append(tuple(int(x) for x in value.split(",") if x))
    if not len(names) == len(cards) == len(parents):
        raise ValueError(f"{path}: a node lacks its name, parents or number of states")
    return [normal(v, ps) for v, ps in enumerate(parents)], Variables(tuple(names), tuple(cards))


def read_fitted(spark: SparkSession, path: str) -> tuple[DataFrame, list[Family], Variables]:
    """An exported counts table with its structure."""
    families, vs = read_families(spark, path)
    return read_counts(spark, path), families, vs


def conditional_table(counts: DataFrame, families: Sequence[Family], vs: Variables, alpha: float = 0.0) -> DataFrame:
    """node_id, node_name, parent_ids, parent_names, parent_values, j, k, prob: every cell of every node, parents as arrays."""
    def by_family(values: list[Column]) -> Column:
        return F.element_at(F.array(*values), F.col("family") + 1)

    ids = by_family([F.array(*[F.lit(p) for p in ps]).cast("array<int>") for _, ps in families])
    names = by_family([F.array(*[F.lit(vs.names[p]) for p in ps]).cast("array<string>") for _, ps in families])
    # A digit of j is taken with the steps and cardinalities of the family's parents, looked up by its place.
    cards = by_family([F.array(*[F.lit(int(vs.cards[p])) for p in ps]).cast("array<int>") for _, ps in families])
    steps = by_family([F.array(*[F.lit(math.prod(vs.cards[p] for p in ps[i + 1 :])) for i in range(len(ps))]).cast("array<bigint>") for _, ps in families])
    values = F.zip_with(steps, cards, lambda s, r: (F.floor(F.col("j") / s) % r).cast("int"))
    rows = probabilities(counts, families, vs, alpha)
    return rows.select(F.col("v").alias("node_id"), by_family([F.lit(vs.names[v]) for v, _ in families]).alias("node_name"), ids.alias("parent_ids"), names.alias("parent_names"), values.alias("parent_values"), "j", "k", "prob")


def write_conditional(table: DataFrame, path: str, per_node: bool = False, precision: int = 10) -> None:
    """conditional_table() as tab-separated text, lists joined by commas; per_node: a folder for each node."""
    lists = {c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("parent_ids", "parent_names", "parent_values")}
    out = table.withColumns(lists).withColumn("prob", general(F.col("prob"), precision))
    writer = out.repartition("node_id").sortWithinPartitions("node_id", "j", "k") if per_node else out.orderBy("node_id", "j", "k")
    (writer.write.partitionBy("node_id") if per_node else writer.write).mode("overwrite").csv(path, sep="\t", header=True)


def general(x: Column, precision: int = 6) -> Column:
    """A number as text with so many significant digits; NA for null and NaN, inf and -inf."""
    return F.when(x.isNull() | F.isnan(x), "NA").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.format_string(f"%.{precision}g", x.cast("double")))


def seed_suffix(seed: Column) -> Column:
    return F.concat(F.lit("_seed"), F.when(F.length(seed.cast("string")) < 4, F.lpad(seed.cast("string"), 4, "0")).otherwise(seed.cast("string")))


def write_bootstrap(frequencies: DataFrame, path: str, stem: str = "bootstrap") -> None:
    """seed, u, v, count, prob -> a folder <stem>_seed0001 for each seed (of four digits at least), tab-separated with a header."""
    named = frequencies.withColumn("run", F.concat(F.lit(stem), seed_suffix(F.col("seed")))).select("run", "u", "v", "count", "prob")
    named.repartition("run").sortWithinPartitions("run", "u", "v").write.mode("overwrite").partitionBy("run").csv(path, sep="\t", header=True)


def read_bootstrap(spark: SparkSession, path: str, stem: str = "bootstrap") -> DataFrame:
    """seed, u, v, count, prob of such folders; the seed is that of the folder's name."""
    rows = spark.read.csv(f"{path}/run={stem}_seed*", sep="\t", header=True, schema=FREQUENCIES).withColumn("file", F.input_file_name())
    return rows.select(F.regexp_extract("file", r"_seed(\d+)", 1).cast("int").alias("seed"), "u", "v", "count", "prob")


def read_bootstrap_files(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """file, u, v, count, prob of bootstrap tables of one file each: the first line of a file is passed over, whatever it holds, and so are lines
    of fewer than four cells; further cells are ignored."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    p = F.split(F.trim("value"), "\t")
    rows = numbered_blocks(lines, "file", "block", "line").where((F.col("line") > 0) & (F.size(p) >= 4))
    return rows.select("file", p[0].cast("int").alias("u"), p[1].cast("int").alias("v"), p[2].cast("long").alias("count"), p[3].cast("double").alias("prob"))


def write_consensus(edges: DataFrame, path: str, by: str = "prob", only_edges: bool = False) -> None:
    """u, v, count, prob without header, by descending probability or by edge."""
    order = [F.col("prob").desc(), F.col("u").desc(), F.col("v").desc()] if by == "prob" else ["u", "v"]
    edges.orderBy(*order).select(*(["u", "v"] if only_edges else ["u", "v", "count", "prob"])).write.mode("overwrite").csv(path, sep="\t")


def read_consensus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=FREQUENCIES)


def write_importance(table: DataFrame, path: str) -> None:
    """All eight columns under a header of eight names, ordered by edge."""
    table.select(*[x.split()[0] for x in IMPORTANCE.split(", ")]).orderBy("u", "v").write.mode("overwrite").csv(path, sep="\t", header=True)


def importance_of(table: DataFrame, metric: str) -> DataFrame:
    """u, v, importance: the metric's absolute value."""
    return table.select("u", "v", F.abs(metric).alias("importance"))


def ranked_importance(table: DataFrame, metric: str, vs: Variables) -> DataFrame:
    """rank, u_name, v_name, u, v, importance: by descending absolute metric, then names descending."""
    names = F.array(*[F.lit(n) for n in vs.names])
    named = importance_of(table, metric).select(F.element_at(names, F.col("u") + 1).alias("u_name"), F.element_at(names, F.col("v") + 1).alias("v_name"), "u", "v", "importance")
    w = Window.orderBy(F.col("importance").desc(), F.col("u_name").desc(), F.col("v_name").desc(), F.col("u").desc(), F.col("v").desc())  # the edges of one network
    return named.select(F.row_number().over(w).alias("rank"), "*")


def write_table(df: DataFrame, path: str, order: Sequence[str] = (), header: bool = True) -> None:
    """Verdicts, metrics, manifests, variable maps: tab-separated, doubles in general notation."""
    out = df.select(*[general(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    (out.orderBy(*order) if order else out).write.mode("overwrite").csv(path, sep="\t", header=header)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="u string, v string, status string")


def read_var_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=VAR_MAP)


def read_aligned(spark: SparkSession, indices: str, names: str) -> DataFrame:
    """u, v, u_name, v_name of two edge lists whose lines belong together by number. A different number of lines raises."""

    def lines(path: str, a: str, b: str) -> DataFrame:
        p = F.split("value", "\t")
        return numbered_lines(spark, path, "trim(value) <> '' AND value NOT LIKE '#%'").select(F.col("line").alias("n"), p[0].alias(a), p[1].alias(b))

    both = lines(indices, "u", "v").join(lines(names, "u_name", "v_name"), "n", "full")
    ok = F.col("u").isNotNull() & F.col("u_name").isNotNull()
    return both.where(F.when(ok, True).otherwise(F.raise_error(F.lit("the two lists differ in length")).isNotNull())).select(F.col("u").cast("int"), F.col("v").cast("int"), "u_name", "v_name")


# --- matrices of expression --------------------------------------------------------------------------------


def resolve(columns: Sequence[str], wanted: Sequence[str | int]) -> list[str]:
    """Columns by name or by place, also from the end; unknown ones raise."""
    out = []
    for w in wanted:
        if isinstance(w, str) and w in columns:
            out.append(w)
        elif str(w).lstrip("-").isdigit() and -len(columns) <= int(w) < len(columns):
            out.append(columns[int(w)])
        else:
            raise ValueError(f"no column {w}")
    return out


def read_wide(spark: SparkSession, path: str, header_row: int = 0, sep: str | None = None) -> DataFrame:
    """A table of strings whose header is line header_row; what stands before it is skipped. Separator by file name unless given. Cells may be
    quoted, and then hold separators and doubled quotes; a cell does not go over the end of a line. Missing cells are null."""
    sep = sep or ("," if path.lower().endswith(".csv") else "\t")
    lines = numbered_lines(spark, path)
    head = lines.where(F.col("line") == header_row).first()
    if head is None:
        raise ValueError(f"{path} has no line {header_row}")
    names = [x.strip() for x in next(csv.reader([head.value], delimiter=sep))]
    rows = lines.where((F.col("line") > header_row) & (F.trim("value") != ""))
    cells = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000"}
    return rows.select(F.from_csv("value", cells, options).alias("c")).select(*[F.coalesce(f"c.c{i}", F.lit(None)).alias(n) for i, n in enumerate(names)])


def load_expression(spark: SparkSession, path: str, ident: str | int = 0, name: str | int | None = None, length: str | int | None = None, drop: Sequence[str | int] = (), genes_in_rows: bool = True, header_row: int = 0) -> DataFrame:
    """gene, gene_name, gene_length, sample, value, in long form, of a matrix with genes in rows or in columns.

    Columns are named or given by place. Columns that hold no number are dropped, other cells that are none count as 0.
    """
    wide = read_wide(spark, path, header_row)
    ident = resolve(wide.columns, [ident])[0]
    extra = {k: resolve(wide.columns, [c])[0] for k, c in (("gene_name", name), ("gene_length", length)) if c is not None}
    skipped = {ident, *extra.values(), *resolve(wide.columns, drop)}
    cells = [c for c in wide.columns if c not in skipped]
    seen = wide.agg(*[F.count(F.expr(f"try_cast(`{c}` AS double)")).alias(c) for c in cells]).first()
    cells = [c for c in cells if seen[c]]
    long = melt(wide, ident, cells)
    if not genes_in_rows:
        return long.select(F.col("sample").alias("gene"), F.col("sample").alias("gene_name"), F.lit(None).cast("double").alias("gene_length"), F.col("gene").alias("sample"), "value")
    about = wide.select(F.col(ident).alias("gene"), *[(F.col(c) if k == "gene_name" else F.expr(f"try_cast(`{c}` AS double)")).alias(k) for k, c in extra.items()]).dropDuplicates(["gene"])
    out = long.join(about, "gene", "left")
    return out.select("gene", F.col("gene_name") if "gene_name" in extra else F.col("gene").alias("gene_name"), F.col("gene_length") if "gene_length" in extra else F.lit(None).cast("double").alias("gene_length"), "sample", "value")


def load_samples(spark: SparkSession, path: str, sample: str | int = 0, group: str | int | None = None) -> DataFrame:
    """sample, group, ix; the group column is the one of that name, or else the second. Labels are made safe."""
    wide = read_wide(spark, path)
    group = group if group is not None else ("group" if "group" in wide.columns else 1)
    s, g = resolve(wide.columns, [sample, group])
    return wide.select(F.trim(s).alias("sample"), sanitize_label(F.col(g)).alias("group"), F.monotonically_increasing_id().alias("ix"))


def match_list(genes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """genes (gene, gene_name) that a list (name) holds by id or by name, and the names that match nothing."""
    # A gene's id and its name are looked up as keys of one equi-join; a gene found by both counts once.
    keys = genes.select("gene", F.explode(F.array_distinct(F.array("gene", "gene_name"))).alias("name"))
    found = keys.join(wanted.select("name").distinct(), "name", "left_semi").select("gene").distinct()
    hit = genes.join(found, "gene", "left_semi")
    known = genes.select(F.explode(F.array("gene", "gene_name")).alias("name")).distinct()
    return hit, wanted.join(known, "name", "left_anti")


def write_prepared(wide: DataFrame, var_map: DataFrame, samples: DataFrame, path: str) -> None:
    """The matrix of codes, its variables and its samples, one folder each."""
    wide.write.mode("overwrite").csv(f"{path}/matrix", sep="\t", header=True)
    write_table(var_map, f"{path}/var_map", ["index"])
    write_table(samples, f"{path}/samples", ["row_index"])


def numbered_in_groups(df: DataFrame, group: str, order: Sequence[str], name: str = "name") -> DataFrame:
    """df with <group>_<i>, counted from 1 within each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn(name, F.concat_ws("_", F.col(group), n.cast("string")))


def tissue_label(path: Column, suffixes: Sequence[str] = ("smartseq2", "smartseq", "10x", "droplet", "facs")) -> Column:
    """A file's base name without extension and assay suffix."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(base, rf"(?i)[._-]({'|'.join(suffixes)})$", "")


def discover(spark: SparkSession, root: str, file: str = "edges.tsv", most: int = 800, prune: Sequence[str] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """path, n_edges, has_importance of the networks below a folder: those that hold the file. Folders that are the same by links count once."""
    found, seen = [], set()
    for folder, below, files in os.walk(root, followlinks=True):
        below[:] = sorted(d for d in below if d not in prune)
        real = os.path.realpath(folder)
        if real in seen:
            below[:] = []
            continue
        seen.add(real)
        if file in files and len(found) < most:
            with open(os.path.join(folder, file)) as f:
                n = sum(1 for line in f if line.strip() and not line.startswith("#"))
            found.append((os.path.relpath(folder, root), n, "edge_importance.tsv" in files))
    return spark.createDataFrame(found, T.StructType([T.StructField("path", T.StringType()), T.StructField("n_edges", T.LongType()), T.StructField("has_importance", T.BooleanType())]))
