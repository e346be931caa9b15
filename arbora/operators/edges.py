"""Edge-set algebra: verdicts and metrics of predicted against true networks, degrees, ranks, filters, subgraphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.math import f1, ratio

from .order import numbered


def skeleton(edges: DataFrame) -> DataFrame:
    """Unordered pairs a < b."""
    return edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _marked(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """u, v, t, p: every edge of either set and whether it is in each, and whether its reverse is (rt, rp). One shuffle by unordered pair."""
    rows = truth.select("u", "v").distinct().withColumn("s", F.lit(1)).unionByName(pred.select("u", "v").distinct().withColumn("s", F.lit(2)))
    pair = rows.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
        *[F.max(((F.col("u") < F.col("v")) == up).cast("int") * (F.col("s") == s).cast("int")).alias(n) for n, up, s in (("tf", True, 1), ("tb", False, 1), ("pf", True, 2), ("pb", False, 2))]
    )
    return pair


def structure_metrics(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """One row of counts and scores. SHD counts a reversal once; two empty sets have precision, recall and F1 of 1."""
    p = _marked(truth, pred)
    s = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    b = {n: F.col(n) == 1 for n in ("tf", "tb", "pf", "pb")}
    in_t, in_p = b["tf"] | b["tb"], b["pf"] | b["pb"]
    wrong_f, wrong_b = b["pf"] & ~b["tf"], b["pb"] & ~b["tb"]
    rev = (wrong_f & b["tb"]) | (wrong_b & b["tf"])
    x = p.agg(
        s(F.col("tf") + F.col("tb")).alias("n_true"), s(F.col("pf") + F.col("pb")).alias("n_pred"),
        s((b["tf"] & b["pf"]).cast("int") + (b["tb"] & b["pb"]).cast("int")).alias("tp"),
        s(in_t).alias("st"), s(in_p).alias("sp"), s(in_t & in_p).alias("stp"), s(rev).alias("reversed"),
    )
    x = x.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_true") - F.col("tp"))
    x = x.withColumn("missing", F.col("st") - F.col("stp")).withColumn("extra", F.col("sp") - F.col("stp"))
    x = x.withColumn("shd", F.col("missing") + F.col("extra") + F.col("reversed"))
    for name, tp, n_pred, n_true in (("directed", "tp", "n_pred", "n_true"), ("skeleton", "stp", "sp", "st")):
        both = (F.col(n_pred) == 0) & (F.col(n_true) == 0)
        x = x.withColumn(f"{name}_precision", F.when(both, 1.0).otherwise(ratio(F.col(tp), F.col(n_pred), 0.0)))
        x = x.withColumn(f"{name}_recall", F.when(both, 1.0).otherwise(ratio(F.col(tp), F.col(n_true), 0.0)))
        x = x.withColumn(f"{name}_f1", f1(F.col(f"{name}_precision"), F.col(f"{name}_recall")))
    return x.drop("st", "sp", "stp")


def comparison(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """One row by the other convention: the symmetric difference counts a reversal twice, empty sets score 0."""
    m = structure_metrics(truth, pred)
    x = m.select("n_true", "n_pred", "tp", "fp", "fn", F.col("reversed").alias("n_reversed"), (F.col("fp") + F.col("fn")).alias("symmetric_difference"))
    x = x.withColumn("precision", ratio(F.col("tp"), F.col("n_pred"), 0.0)).withColumn("recall", ratio(F.col("tp"), F.col("n_true"), 0.0))
    return x.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def verdicts(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """u, v, status: TP, FP, FP_reversed for predicted edges, FN for missed ones."""
    t, p = truth.select("u", "v").distinct(), pred.select("u", "v").distinct()
    back = t.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("rev"))
    both = p.withColumn("p", F.lit(True)).join(t.withColumn("t", F.lit(True)), ["u", "v"], "full").join(back, ["u", "v"], "left")
    status = F.when(F.col("p") & F.col("t"), "TP").when(F.col("p") & F.col("rev"), "FP_reversed").when(F.col("p"), "FP").otherwise("FN")
    return both.select("u", "v", status.alias("status"))


def restrict(truth: DataFrame, pred: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth whose directed edge is among the pairs, prediction whose unordered one is."""
    s = skeleton(pairs)
    kept = pred.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).join(s, ["a", "b"], "left_semi").drop("a", "b")
    return truth.join(pairs.select("u", "v").distinct(), ["u", "v"], "left_semi"), kept


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(n, F.col("u") == F.col("_n"), "left_semi").join(n, F.col("v") == F.col("_n"), "left_semi")


def two_cycles(edges: DataFrame) -> DataFrame:
    """u < v of which both directions are present."""
    e = edges.select("u", "v").distinct()
    return e.join(e.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi").where("u < v")


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree, role (source, middle, sink)."""
    ends = edges.select("u", "v").distinct().select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    d = ends.groupBy("x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    role = F.when(F.col("in_degree") == 0, "source").when(F.col("out_degree") == 0, "sink").otherwise("middle")
    return d.select("node", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"), role.alias("role"))


def ranked(edges: DataFrame, metric: str, ties: Sequence[str] = ("u", "v")) -> DataFrame:
    """edges with rank 1.. by descending metric."""
    return numbered(edges, [F.col(metric).desc(), *[F.col(c).desc() for c in ties]], "rank", 1)


def top(edges: DataFrame, metric: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The n edges of greatest positive metric, in each group if by is given."""
    kept = edges.where(F.col(metric) > 0)
    if not by:
        return kept.orderBy(F.col(metric).desc(), "u", "v").limit(n)
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), "u", "v")
    return kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def normalised(edges: DataFrame, metric: str, out: str = "norm") -> DataFrame:
    """Ascending rank of the metric over [0, 1]; null stays null, a lone value is 1."""
    w = Window.partitionBy(F.col(metric).isNull()).orderBy(F.col(metric), "u", "v")
    n = F.count("*").over(Window.partitionBy(F.col(metric).isNull()))
    value = F.when(n == 1, 1.0).otherwise((F.row_number().over(w) - 1) / (n - 1))
    return edges.withColumn(out, F.when(F.col(metric).isNotNull(), value))


def nearest_quantile(edges: DataFrame, metric: str, t: float) -> DataFrame:
    """One row: the value at place round(t (n - 1)) in ascending order."""
    placed = numbered(edges.where(F.col(metric).isNotNull()).select(metric), [metric], "place")
    size = placed.agg(F.count("*").alias("n"))
    at = F.col("place") == F.floor(t * (F.col("n") - 1) + 0.5)
    return placed.join(F.broadcast(size), at).select(F.col(metric).cast("double").alias("value"))  # one row is broadcast


def histogram(edges: DataFrame, metric: str, bins: int = 32) -> DataFrame:
    """bin, n, at_least: equal bins from least to greatest (which falls into the last), and how many reach each bin's lower edge."""
    lim = edges.agg(F.min(metric).cast("double").alias("lo"), F.max(metric).cast("double").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(metric) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))).otherwise(0)
    rows = edges.where(F.col(metric).isNotNull()).crossJoin(F.broadcast(lim)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row is broadcast
    grid = edges.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(rows, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("at_least", F.sum("n").over(Window.orderBy(F.col("bin").desc())))


def condition(metric: str, op: str, value: float) -> Column:
    """metric >= or <= value; null never passes."""
    c = F.col(metric)
    return F.coalesce(c >= value if op == "ge" else c <= value, F.lit(False))


def filtered(edges: DataFrame, conditions: Sequence[Column], how: str = "and") -> DataFrame:
    """Edges that pass all (and) or any (or) of the conditions; without conditions, all."""
    if not conditions:
        return edges
    return edges.where(reduce(lambda a, b: a & b if how == "and" else a | b, conditions))


def hubs(edges: DataFrame, n: int) -> DataFrame:
    """node, degree of the n nodes of greatest degree, ties by node."""
    return degrees(edges).orderBy(F.col("degree").desc(), "node").limit(n).select("node", "degree")


def ego(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges among the targets and their direct neighbours."""
    t = targets.select(F.col("node").alias("_t")).distinct()
    near = edges.join(t, F.col("v") == F.col("_t"), "left_semi").select(F.col("u").alias("node"))
    near = near.unionByName(edges.join(t, F.col("u") == F.col("_t"), "left_semi").select(F.col("v").alias("node"))).unionByName(targets.select("node"))
    return induced(edges, near)


def with_importance(edges: DataFrame, importance: DataFrame, metric: str = "importance", default: float = 0.0) -> DataFrame:
    """edges (u, v, ...) with the metric of a table of importance (u, v, metric), and the default for edges that it doesn't list."""
    known = importance.select("u", "v", F.col(metric).cast("double").alias(metric)).dropDuplicates(["u", "v"])
    return edges.drop(metric).join(known, ["u", "v"], "left").withColumn(metric, F.coalesce(metric, F.lit(float(default))))


def within(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges of which both ends are among the names (name) and differ."""
    n = names.select("name").distinct()
    kept = edges.where("u <> v").join(n.withColumnRenamed("name", "u"), "u", "left_semi")
    return kept.join(n.withColumnRenamed("name", "v"), "v", "left_semi").select(*edges.columns)


def payload(edges: DataFrame, importance: DataFrame, probabilities: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """edges with importance, probability and verdict where known, and the degrees of both ends."""
    d = degrees(edges).select("node", "degree")
    out = edges.join(importance, ["u", "v"], "left").join(probabilities, ["u", "v"], "left")
    if truth is not None:
        out = out.join(verdicts(truth, edges), ["u", "v"], "left")
    return out.join(d.withColumnsRenamed({"node": "u", "degree": "u_degree"}), "u").join(d.withColumnsRenamed({"node": "v", "degree": "v_degree"}), "v")
