"""Bootstrap edge frequencies, their integration over seeds, and an acyclic consensus."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.counts import COMPACT, TABLE_CELLS, pack, resampled, variables
from arbora.operators.order import numbered

from .search import Config, Graph, candidate_parents, kept, scored, unused, walk


def run_number(seed: int, replicate: int) -> int:
    return (seed << 32) + replicate


def bootstrap(df: DataFrame, key: Sequence[str], replicates: int = 100, seeds: Sequence[int] = (2025,), cfg: Config = Config(), init: Iterable[tuple[int, int]] = (), names: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """seed, u, v, count, prob: how many resamples' networks have the edge. key: columns that tell rows apart.

    A resample has as many draws as there are rows, with replacement: rows are numbered by a hash of their key, and their draws follow from number, seed
    and replicate, whatever the partitioning. With exact=False a row is drawn Poisson(1) times by the hash itself, which needs no numbers; a
    resample's size then varies. Candidate parents are found once, on the data themselves, and all cardinalities are those of the
    data. All resamples are searched in lockstep: each round is a scan in which every resample that waits gets the scores it
    asks for and those that its next moves may need, so rounds are fewer than the longest search's iterations, however many
    resamples there are, and the data are neither copied nor sent anywhere. Of few possible rows, one scan counts how often each resample has
    drawn each different one, and the rounds are scans of these.
    """
    spark = df.sparkSession
    vs = variables(df, names or [c for c in df.columns if c not in key])
    init = list(init)
    h = unused([*vs.names, *key], "key")
    rows, draws = df.select(*vs.names, *[c for c in key if c not in vs.names]), None
    if exact:
        rows = numbered(rows, [F.xxhash64(*key), *key, *vs.names], h)
        draws = rows.count()
    else:
        rows = rows.withColumn(h, F.xxhash64(*key))
    packed, runs = pack(rows.select(*vs.names, h), vs, key=h, draws=draws), [run_number(s, b) for s in dict.fromkeys(seeds) for b in range(replicates)]
    different = np.prod([float(c) for c in vs.cards])
    data = kept(resampled(packed, runs) if runs and different <= COMPACT and different * len(runs) <= TABLE_CELLS else packed)
    found: list[tuple[int, int, int]] = []
    try:
        cand = candidate_parents(df.select(*vs.names), vs, cfg)
        searches = {(s, b): walk(len(vs.names), cand, cfg, init) for s in seeds for b in range(replicates)}
        known: dict = {run: {} for run in searches}
        needed = {run: next(search) for run, search in searches.items()}
        while needed:
            ask = [(run, f) for run, (fs, soon) in needed.items() for f in dict.fromkeys([*fs, *soon()]) if f not in known[run]]
            for (run, f), x in zip(ask, scored(data, [(run_number(*run), f) for run, f in ask], cfg.score.lower(), cfg.ess), strict=True):
                known[run][f] = x
            for run in list(needed):
                # On until it needs what is not known.
                while run in needed and all(f in known[run] for f in needed[run][0]):
                    try:
                        needed[run] = searches[run].send({f: known[run][f] for f in needed[run][0]})
                    except StopIteration as end:
                        found += [(run[0], u, v) for u, v in end.value.edges]
                        del needed[run], known[run]
    finally:
        data.rows.unpersist()
    edges = spark.createDataFrame(found, "seed int, u int, v int")
    return edges.groupBy("seed", "u", "v").agg(F.count("*").alias("count")).withColumn("prob", F.col("count") / replicates)


def integrate(frequencies: DataFrame, seeds: int) -> DataFrame:
    """u, v, count, prob over seeds: counts are added, probabilities averaged over all seeds (absent is 0)."""
    return frequencies.groupBy("u", "v").agg(F.sum("count").cast("long").alias("count"), (F.sum("prob") / seeds).alias("prob"))


def consensus(integrated: DataFrame, least_prob: float = 0.2, least_count: int = 2, acyclic: bool = True) -> DataFrame:
    """Edges past both thresholds; if acyclic, inserted from the most probable on and left out where they close a cycle.

    Ties in probability go to the larger (u, v). Only the edges past the thresholds reach the driver.
    """
    kept = integrated.where((F.col("prob") >= least_prob) & (F.col("count") >= least_count))
    if not acyclic:
        return kept
    rows = kept.orderBy(F.col("prob").desc(), F.col("u").desc(), F.col("v").desc()).collect()
    g = Graph(1 + max((max(r.u, r.v) for r in rows), default=0))
    chosen = []
    for r in rows:
        if r.u != r.v and not g.reaches(r.v, r.u):
            g.add(r.u, r.v)
            chosen.append(tuple(r))
    return integrated.sparkSession.createDataFrame(chosen, kept.schema)
