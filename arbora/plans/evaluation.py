"""Evaluation of a learned network against a known one: graph separation, SID, KL divergence, and sampling from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.math import mixed_radix
from arbora.operators.counts import Variables, families_of, family_counts
from arbora.operators.scores import probabilities

Edges = Sequence[tuple[int, int]]


@dataclass
class Network:
    """A discrete network: states and, for each node, parents in declared order and a table configurations x states.

    The first parent is the most significant digit of a configuration.
    """

    names: list[str]
    states: list[list[str]]
    parents: list[list[int]]
    tables: list[np.ndarray]

    @property
    def cards(self) -> list[int]:
        return [len(s) for s in self.states]

    def edges(self) -> list[tuple[int, int]]:
        return sorted((u, v) for v, ps in enumerate(self.parents) for u in ps)

    def order(self) -> list[int]:
        return topological_order(len(self.names), self.edges())

    def info(self) -> dict[str, float]:
        c = self.cards
        return {
            "nodes": len(c), "edges": sum(map(len, self.parents)), "parameters": int(sum(t.shape[0] * (t.shape[1] - 1) for t in self.tables)),
            "max_in_degree": max(map(len, self.parents), default=0), "state_space": float(np.prod([float(x) for x in c])),
        }


def neighbours(n: int, edges: Edges) -> tuple[list[set[int]], list[set[int]]]:
    parents, children = [set() for _ in range(n)], [set() for _ in range(n)]
    for u, v in edges:
        parents[v].add(u)
        children[u].add(v)
    return parents, children


def topological_order(n: int, edges: Edges) -> list[int]:
    """Sources first, in node order; raises on a cycle."""
    parents, children = neighbours(n, edges)
    left = [len(p) for p in parents]
    ready, out = [v for v in range(n) if not left[v]], []
    while ready:
        x = ready.pop(0)
        out.append(x)
        for y in sorted(children[x]):
            left[y] -= 1
            if not left[y]:
                ready.append(y)
    if len(out) < n:
        raise ValueError("the network has a cycle")
    return out


def is_dag(n: int, edges: Edges) -> bool:
    try:
        topological_order(n, edges)
    except ValueError:
        return False
    return True


def closure(start: set[int], step: list[set[int]]) -> set[int]:
    """All that is reached from start by at least one step."""
    out, todo = set(), list(start)
    while todo:
        new = step[todo.pop()] - out
        out |= new
        todo += new
    return out


def connected(start: set[int], parents: list[set[int]], children: list[set[int]], given: set[int], skip: set[tuple[int, int]] = frozenset()) -> set[int]:
    """All nodes that an open path joins to start, given the nodes: a ball is passed along edges, up from where it came or down.

    From above a ball goes on to children unless the node is given, and bounces back to parents if the node or one of its
    descendants is given; from below it goes on in both directions unless the node is given. Edges in skip are not there.
    """
    above = set(given)
    todo = list(given)
    while todo:
        x = todo.pop()
        new = {p for p in parents[x] if (p, x) not in skip} - above
        above |= new
        todo += new
    reached, seen = set(), set()
    balls = [(x, True) for x in start]
    while balls:
        x, from_below = balls.pop()
        if (x, from_below) in seen:
            continue
        seen.add((x, from_below))
        if x not in given:
            reached.add(x)
            balls += [(c, False) for c in children[x] if (x, c) not in skip]
        if (x not in given) if from_below else (x in above):
            balls += [(p, True) for p in parents[x] if (p, x) not in skip]
    return reached


def separated(n: int, edges: Edges, a: int, b: int, given: set[int]) -> bool:
    """d-separation; an end among the given counts as separated."""
    parents, children = neighbours(n, edges)
    return a in given or b in given or b not in connected({a}, parents, children, given)


def wrong_effects(i: int, parents: list[set[int]], children: list[set[int]], below: list[set[int]], given: set[int]) -> int:
    """Of how many other nodes adjusting for the given ones gets the effect of i wrong. below: each node's descendants.

    For a node that i does not cause, an open path is wrong. Of a node that i causes, what adjusts must not lie on a causal
    path or below one, and no path may be open but those that begin with an edge of i toward the node.
    """
    open_ = set() if i in given else connected({i}, parents, children, given)
    wrong = sum(j not in given and j in open_ for j in range(len(parents)) if j != i and j not in below[i])
    by_first: dict[frozenset, list[int]] = {}
    for j in below[i]:
        by_first.setdefault(frozenset(c for c in children[i] if c == j or j in below[c]), []).append(j)
    for first, nodes in by_first.items():
        if given & first.union(*(below[c] for c in first)):
            wrong += len(nodes)
        elif i not in given:
            still = connected({i}, parents, children, given, {(i, c) for c in first})
            wrong += sum(j not in given and j in still for j in nodes)
    return wrong


def sid(spark: SparkSession, n: int, truth: Edges, pred: Edges) -> DataFrame:
    """i, errors: for each node the ordered pairs (i, j) whose effect adjusting for i's predicted parents gets wrong. Nodes are spread over tasks."""
    truth, pred = list(truth), list(pred)
    if not (is_dag(n, truth) and is_dag(n, pred)):
        raise ValueError("both networks must be acyclic")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (own, children), other = neighbours(n, truth), neighbours(n, pred)[0]
        below: list[set[int]] = [set() for _ in range(n)]
        for v in reversed(topological_order(n, truth)):
            below[v] = children[v].union(*(below[c] for c in children[v]))
        for batch in batches:
            wrong = [0 if own[i] == other[i] else wrong_effects(i, own, children, below, other[i]) for i in batch["id"]]
            yield pd.DataFrame({"i": batch["id"].astype("int32"), "errors": pd.Series(wrong, dtype="int64")})

    return spark.range(n).repartition(min(n, 64)).mapInPandas(count, "i int, errors long")


def reachable(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """u, v of all pairs joined by a path: squaring the relation until it stops growing (or for a given number of rounds)."""
    out = edges.select("u", "v").distinct()
    n, rounds = out.count(), 0
    while depth is None or rounds < depth:
        a, b = out.alias("a"), out.alias("b")
        longer = a.join(b, F.col("a.v") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.v").alias("v"))
        new = out.unionByName(longer).distinct().cache()
        m = new.count()
        if rounds:
            out.unpersist()
        out, rounds = new, rounds + 1
        if m == n:
            break
        n = m
    return out


def _below(u):
    return lambda c: c < u


def sample(spark: SparkSession, net: Network, rows: int, seed: int = 0) -> DataFrame:
    """Rows drawn from the network, node by node in topological order: the state is how many cumulative probabilities the row's number exceeds."""
    df = spark.range(rows).withColumnRenamed("id", "row_id")
    for v in net.order():
        t = np.cumsum(net.tables[v], axis=1)[:, :-1]
        j = mixed_radix([F.col(net.names[p]) for p in net.parents[v]], [net.cards[p] for p in net.parents[v]])
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(v), "row_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
        table = F.array(*[F.array(*[F.lit(float(x)) for x in row]).cast("array<double>") for row in t])
        cut = F.element_at(table, (j + 1).cast("int"))
        df = df.withColumn(net.names[v], F.size(F.filter(cut, _below(u))))
    return df.select("row_id", *net.names)


def joint(spark: SparkSession, net: Network, max_states: int = 2_000_000) -> DataFrame:
    """Every configuration of all variables and its probability."""
    if np.prod([float(c) for c in net.cards]) > max_states:
        raise ValueError("the state space is larger than max_states")
    df = spark.range(1).select(F.lit(1.0).alias("p"))
    for v in net.order():
        df = df.select("*", F.explode(F.array(*[F.lit(k) for k in range(net.cards[v])])).alias(net.names[v]))
        j = mixed_radix([F.col(net.names[p]) for p in net.parents[v]], [net.cards[p] for p in net.parents[v]])
        flat = F.array(*[F.lit(float(x)) for x in net.tables[v].ravel()])
        df = df.withColumn("p", F.col("p") * F.element_at(flat, (j * net.cards[v] + F.col(net.names[v]) + 1).cast("int")))
    return df.select(*net.names, "p")


def fit(df: DataFrame, edges: Edges, vs: Variables, alpha: float = 1.0, states: list[list[str]] | None = None) -> Network:
    """Tables of a structure fitted to data with alpha added to each cell."""
    families = families_of(edges, len(vs.names))
    tables = [np.zeros((int(np.prod([vs.cards[p] for p in ps] or [1])), vs.cards[v])) for v, ps in families]
    for r in probabilities(family_counts(df, families, vs), families, vs, alpha, per_cell=True).collect():
        tables[r.family][r.j, r.k] = r.prob
    return Network(list(vs.names), states or [[str(k) for k in range(c)] for c in vs.cards], [list(ps) for _, ps in families], tables)


def kl_divergence(spark: SparkSession, p: Network, q: Network, max_states: int = 2_000_000) -> DataFrame:
    """One row: the divergence of q from p in nats; infinite where q excludes what p does not."""
    a = joint(spark, p, max_states)
    b = joint(spark, q, max_states).withColumnRenamed("p", "q")
    term = F.when(F.col("p") > 0, F.when(F.col("q") > 0, F.col("p") * (F.log("p") - F.log("q"))).otherwise(float("inf"))).otherwise(0.0)
    return a.join(b, list(p.names)).agg(F.sum(term).alias("kl"))


def kl_by_family(spark: SparkSession, p: Network, q: Network) -> DataFrame:
    """kl_divergence() without listing all states: the sum over nodes of what q's table of a node adds, given p's joint of the node and
    its parents in q. That joint needs only the node's, its parents' and their ancestors' tables; it is summed out as it is built."""
    above = neighbours(len(p.names), p.edges())[0]
    rank = {v: i for i, v in enumerate(p.order())}
    total = None
    for v in range(len(p.names)):
        for net, sign in ((p, 1.0), (q, -1.0)):
            kept = {v, *net.parents[v]}
            needed = sorted(kept | closure(kept, above), key=rank.get)
            df = spark.range(1).select(F.lit(1.0).alias("p"))
            for i, x in enumerate(needed):
                df = df.select("*", F.explode(F.array(*[F.lit(k) for k in range(p.cards[x])])).alias(p.names[x]))
                j = mixed_radix([F.col(p.names[y]) for y in p.parents[x]], [p.cards[y] for y in p.parents[x]])
                flat = F.array(*[F.lit(float(t)) for t in p.tables[x].ravel()])
                df = df.withColumn("p", F.col("p") * F.element_at(flat, (j * p.cards[x] + F.col(p.names[x]) + 1).cast("int"))).where("p > 0")
                later = kept.union(*(p.parents[y] for y in needed[i + 1 :]))
                df = df.groupBy(*[p.names[y] for y in needed[: i + 1] if y in later]).agg(F.sum("p").alias("p"))
            j = mixed_radix([F.col(p.names[y]) for y in net.parents[v]], [p.cards[y] for y in net.parents[v]])
            flat = F.array(*[F.lit(float(t)) for t in net.tables[v].ravel()])
            t = F.element_at(flat, (j * p.cards[v] + F.col(p.names[v]) + 1).cast("int"))
            one = df.agg((sign * F.sum(F.col("p") * F.when(t > 0, F.log(t)).otherwise(float("-inf")))).alias("kl"))
            total = one if total is None else total.unionByName(one)
    return total.agg(F.greatest(F.sum("kl"), F.lit(0.0)).alias("kl"))


def benchmark_summary(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """by..., metric, mean, sd, n, n_missing. Null, NaN and infinite values are missing; a single value has sd 0."""
    long = rows.unpivot(list(by), [c for c in metrics], "metric", "value")
    x = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    out = long.groupBy(*by, "metric").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("n_missing"))
    return out.withColumn("sd", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd")))
