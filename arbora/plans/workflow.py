"""Studies from end to end: bootstrap to consensus to importance, evaluation records, sweeps, and tables about networks."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators import edges as sets
from arbora.operators.counts import Variables, families_of, family_counts, variables
from arbora.operators.importance import edge_importance
from arbora.operators.moments import extremes
from arbora.operators.scores import data_loglik
from arbora.sources.files import write_table

from .bootstrap import bootstrap, consensus, integrate
from .evaluation import Network, fit, is_dag, kl_by_family, sid
from .search import Config, Result, late_gain, learn

Edges = Sequence[tuple[int, int]]


@dataclass(frozen=True)
class Study:
    """What a stability run yields. counts and importance are null if no edge is in the consensus."""

    frequencies: DataFrame
    integrated: DataFrame
    consensus: DataFrame
    edges: list[tuple[int, int]]
    counts: DataFrame | None
    importance: DataFrame | None
    by_group: DataFrame | None


def stability(df: DataFrame, key: Sequence[str], cfg: Config = Config(), replicates: int = 100, seeds: Sequence[int] = (2025,), least_prob: float = 0.2, least_count: int = 2, alpha: float = 1.0, group: str | None = None, names: Sequence[str] | None = None) -> Study:
    """Bootstrap -> integration over seeds -> acyclic consensus -> recount on all rows -> importance of its edges, overall and by group.

    The consensus is as large as the network, and only it reaches the driver.
    """
    names = list(names or [c for c in df.columns if c not in {*key, group}])
    vs = variables(df, names)
    frequencies = bootstrap(df, key, replicates, seeds, cfg, names=names)
    integrated = integrate(frequencies, len(seeds))
    agreed = consensus(integrated, least_prob, least_count)
    found = sorted((r.u, r.v) for r in agreed.collect())
    if not found:
        return Study(frequencies, integrated, agreed, found, None, None, None)
    counts = family_counts(df, families_of(found, len(names)), vs)
    by_group = edge_importance(df, found, vs, alpha, cfg.ess, by=[group]) if group else None
    return Study(frequencies, integrated, agreed, found, counts, edge_importance(df, found, vs, alpha, cfg.ess), by_group)


def iterations(variables_: int, per_variable: int = 10, least: int = 2000) -> int:
    """A search's budget by the number of variables."""
    return max(least, per_variable * variables_)


#: Nodes of networks of which the SID is taken, and states of a network of which the KL divergence is.
SID_MOST, MAX_STATES = 500, 2_000_000


def evaluation_record(spark: SparkSession, n: int, truth: Edges, pred: Edges, net: Network | None = None, data: DataFrame | None = None, pairs: Edges | None = None, alpha: float = 1.0, sid_most: int = SID_MOST, max_states: int = MAX_STATES, extra: Mapping[str, str] | None = None) -> DataFrame:
    """One row: extras, sizes, structural metrics, SID and KL divergence, null where they can't be had.

    pairs restricts truth by directed and prediction by unordered membership, but not for SID, which is about the whole networks. SID needs two acyclic
    networks of at most sid_most nodes; KL needs the known network's tables, at most max_states states in all, and data to fit the predicted
    structure's, of which a state that the network doesn't have raises.
    """
    frame = lambda e: spark.createDataFrame(list(e), "u int, v int")
    t, p = frame(truth), frame(pred)
    raw = (len(set(truth)), len(set(pred)))
    if pairs is not None:
        t, p = sets.restrict(t, p, frame(pairs))
    row = sets.structure_metrics(t, p)
    t_dag, p_dag = is_dag(n, sorted(set(truth))), is_dag(n, sorted(set(pred)))
    errors = kl = None
    if t_dag and p_dag and n <= sid_most:
        errors = sid(spark, n, truth, pred).agg(F.sum("errors")).first()[0]
    if net is not None and data is not None and p_dag and math.prod(net.cards) <= max_states:
        vs = Variables(tuple(net.names), tuple(net.cards))
        seen = extremes(data, vs.names)
        bad = [(v, lo, hi) for v, card, (lo, hi, nulls) in zip(vs.names, vs.cards, seen, strict=True) if nulls or lo is not None and (lo < 0 or hi >= card)]
        if bad:
            raise ValueError(f"data hold states that the network does not have: {bad[:3]}")
        kl = kl_by_family(spark, net, fit(data, pred, vs, alpha)).first().kl
    about = {
        "n_nodes": F.lit(n), "n_true_edges_raw": F.lit(raw[0]), "n_pred_edges_raw": F.lit(raw[1]),
        "n_true_not_evaluable": F.lit(raw[0]) - F.col("n_true"), "n_pred_not_evaluable": F.lit(raw[1]) - F.col("n_pred"),
        "true_is_dag": F.lit(int(t_dag)), "pred_is_dag": F.lit(int(p_dag)),
        "sid": F.lit(errors).cast("long"), "sid_max": F.lit(n * (n - 1)).cast("long"), "sid_normalised": F.lit(None if errors is None or n < 2 else errors / (n * (n - 1))).cast("double"), "kl": F.lit(kl).cast("double"),
    }
    return row.select(*[F.lit(v).alias(k) for k, v in (extra or {}).items()], *[c.alias(k) for k, c in about.items()], "*")


def write_record(record: DataFrame, path: str) -> None:
    """An evaluation record of one row as a tab-separated table of two lines (path.tsv) and as JSON (path.json): NA and null where a figure can't be had."""
    write_table(record.coalesce(1), f"{path}.tsv")
    record.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}.json")


def append_record(record: DataFrame, path: str) -> None:
    """Adds the record to a benchmark's table."""
    record.write.mode("append").parquet(path)


def settings(base: Config, **choices: Iterable) -> list[dict]:
    """The cross product of choices of a search's options (score=..., max_parents=...), as rows with a Config each."""
    names = list(choices)
    rows = []
    for values in product(*choices.values()):
        own = dict(zip(names, values, strict=True))
        rows.append({**own, "config": replace(base, **own)})
    return rows


def sweep(spark: SparkSession, datasets: Mapping[str, DataFrame], base: Config = Config(), sizes: Sequence[int | None] = (None,), reps: int = 1, truth: Mapping[str, Edges] | None = None, names: Sequence[str] | None = None, **choices: Iterable) -> DataFrame:
    """A row for each dataset x size x repetition x setting: the score and edges that the search finds, its iterations and whether its
    budget was binding, and SHD and F1 if the truth is given.

    A size takes so many rows by a hash of the row and the repetition, the same ones whatever the partitions; of equal rows, which nothing tells apart, each copy
    has a number of its own. Repetitions of all rows differ only in that hash.
    """
    out = []
    for (name, df), size, rep in product(datasets.items(), sizes, range(reps)):
        vs = variables(df, names)
        part = df.select(*vs.names)
        if size:
            # Equal rows are counted and dealt out again under numbers, so that a row's place doesn't follow from where it is stored.
            copies = part.groupBy(*vs.names).agg(F.count("*").alias("__n"))
            part = copies.select(*vs.names, F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__n"))
            part = part.orderBy(F.xxhash64(F.lit(rep), *vs.names, "__n"), *vs.names, "__n").limit(size).drop("__n")
        part = part.cache()
        for row in settings(base, **choices):
            result: Result = learn(part, row["config"], vs=vs)
            binding = late_gain(result.trace_frame(spark), row["config"].max_iter).first().budget_binding if result.trace else 0
            shd = f1 = None
            if truth and name in truth:
                m = sets.structure_metrics(spark.createDataFrame(list(truth[name]), "u int, v int"), spark.createDataFrame(result.edges, "u int, v int")).first()
                shd, f1 = m.shd, m.directed_f1
            own = ", ".join(f"{k}={row[k]}" for k in choices)
            out.append((name, size or 0, rep, own, float(result.score), len(result.edges), result.iterations, int(binding), shd, f1))
        part.unpersist()
    return spark.createDataFrame(out, "dataset string, n_rows int, rep int, setting string, score double, n_edges int, iterations int, budget_binding int, shd long, directed_f1 double")


def loglik_of(df: DataFrame, networks: Mapping[str, Edges], vs: Variables, alpha: float = 1.0, other: DataFrame | None = None) -> DataFrame:
    """network, total, per_sample, per_sample_variable of several structures fitted to df, on df or on other data."""
    out = None
    for name, found in networks.items():
        families = families_of(found, len(vs.names))
        fitted = family_counts(df, families, vs)
        one = data_loglik(fitted if other is None else family_counts(other, families, vs), fitted, families, vs, alpha).select(F.lit(name).alias("network"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# --- tables about networks ---------------------------------------------------------------------------------


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("status").agg(F.count("*").alias("n"))


def find_nodes(nodes: DataFrame, text: str, most: int = 40) -> DataFrame:
    """nodes (name, degree) whose name holds the text, in any case, by descending degree, then name."""
    return nodes.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy(F.col("degree").desc(), "name").limit(most)


def strongest_share(edges: DataFrame, metric: str, share: float = 0.3) -> DataFrame:
    """The edges whose metric reaches the value at that share from the top (nearest rank); null never passes."""
    level = sets.nearest_quantile(edges, metric, 1 - share).withColumnRenamed("value", "level")
    return edges.crossJoin(F.broadcast(level)).where(F.col(metric) >= F.col("level")).drop("level")  # one row is broadcast


def neighbours_of(edges: DataFrame, node) -> DataFrame:
    """side (parent, child), node: what is joined to a node."""
    return edges.where(F.col("v") == node).select(F.lit("parent").alias("side"), F.col("u").alias("node")).unionByName(edges.where(F.col("u") == node).select(F.lit("child").alias("side"), F.col("v").alias("node"))).distinct()


def labelled(edges: DataFrame, top: int, targets: Sequence = (), chosen: Sequence = (), most: int = 250) -> DataFrame:
    """node: those to be labelled, most at a time: the top by degree, targets, and chosen nodes with their neighbours; by degree, then node."""
    d = sets.degrees(edges).select("node", "degree")
    near = edges.where(F.col("u").isin(list(chosen))).select(F.col("v").alias("node")).unionByName(edges.where(F.col("v").isin(list(chosen))).select(F.col("u").alias("node")))
    kept = d.orderBy(F.col("degree").desc(), "node").limit(top).select("node").unionByName(near).unionByName(d.where(F.col("node").isin([*targets, *chosen])).select("node")).distinct()
    return d.join(kept, "node", "left_semi").orderBy(F.col("degree").desc(), "node").limit(most).select("node", "degree")


def default_network(catalogue: DataFrame, prefer: str | None = None) -> DataFrame:
    """The path to show first: one of the preferred prefix, else one with importance and the fewest edges."""
    first = F.col("path").startswith(prefer) if prefer else F.lit(False)
    return catalogue.orderBy(first.desc(), F.col("has_importance").desc(), "n_edges", "path").limit(1)


def group_tops(importance: DataFrame, group: str, metric: str, n: int) -> DataFrame:
    """The n strongest edges of each group, with the greatest value of all groups, to which they are all drawn."""
    x = importance.withColumn("value", F.abs(metric))
    w = Window.partitionBy(group).orderBy(F.col("value").desc(), "u", "v")
    top = x.where("value > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return top.crossJoin(F.broadcast(x.agg(F.max("value").alias("greatest")))).select(group, "place", "u", "v", "value", "greatest")  # one row is broadcast


def mean_and_sd(mean: Column, sd: Column, decimals: int = 3) -> Column:
    return F.concat_ws(" ± ", F.format_string(f"%.{decimals}f", mean), F.format_string(f"%.{decimals}f", sd))


def mixed_order(column: str) -> list[Column]:
    """Numbers first, in their order, then texts."""
    x = F.col(column).try_cast("double")
    return [x.isNull(), x, F.col(column)]


def dataset_info(spark: SparkSession, datasets: Mapping[str, tuple[DataFrame, Edges]]) -> DataFrame:
    """dataset, n_samples, n_variables, n_true_edges."""
    rows = [(name, df.count(), len(df.columns), len(set(truth))) for name, (df, truth) in datasets.items()]
    return spark.createDataFrame(rows, "dataset string, n_samples long, n_variables int, n_true_edges int")
