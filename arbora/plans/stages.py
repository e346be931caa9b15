"""A study in stages, each of which runs only if what it reads is there and has changed since it ran."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, is_dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.counts import Variables, families_of, family_counts, variables
from arbora.operators.importance import edge_importance

from .bootstrap import bootstrap, consensus, integrate
from .search import Config, learn


@dataclass(frozen=True)
class Stage:
    """run(tables read by name) -> tables by name. reads and writes: names of tables; options: what else the result depends on."""

    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]
    run: Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]
    options: Mapping = field(default_factory=dict)


class Study:
    """Tables and a manifest in a folder that all machines share: for each stage that has run, the versions of what it read and wrote, and its options."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.base = self.base.rstrip("/")
        self.fs.create_dir(self.base, recursive=True)
        self.done: dict[str, dict] = {}
        if self.fs.get_file_info(f"{self.base}/manifest.json").type == pafs.FileType.File:
            with self.fs.open_input_stream(f"{self.base}/manifest.json") as f:
                self.done = json.loads(f.read())

    def _save(self) -> None:
        # Written beside and moved into place, so that a run that is stopped leaves a whole manifest.
        with self.fs.open_output_stream(f"{self.base}/manifest.new") as f:
            f.write(json.dumps(self.done, indent=1, sort_keys=True).encode())
        self.fs.move(f"{self.base}/manifest.new", f"{self.base}/manifest.json")

    def version(self, table: str) -> str | None:
        """What tells a table's contents from others: a sum over its rows' hashes and their number; None if it isn't there."""
        if self.fs.get_file_info(f"{self.base}/{table}/_SUCCESS").type != pafs.FileType.File:
            return None
        df = self.read(table)
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("h")).first()
        return f"{r.n}:{r.h}:{','.join(sorted(df.columns))}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def put(self, table: str, df: DataFrame) -> None:
        """A table that comes from outside, such as the data."""
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}")

    def run(self, stages: Sequence[Stage], skip: Sequence[str] = ()) -> dict[str, str]:
        """What became of each stage: done; kept (it had run on the same tables with the same options, and its own are still there); skipped (switched off);
        or waiting (a table that it reads isn't there, as when an earlier stage found nothing)."""
        out = {}
        for stage in stages:
            if stage.name in skip:
                out[stage.name] = "skipped"
                continue
            read = {t: self.version(t) for t in stage.reads}
            if None in read.values():
                out[stage.name] = "waiting"
                continue
            mark = hashlib.sha256(json.dumps(_plain(stage.options), sort_keys=True, default=str).encode()).hexdigest()
            past = self.done.get(stage.name)
            if past and past["read"] == read and past["options"] == mark and all(self.version(t) == v for t, v in past["wrote"].items()):
                out[stage.name] = "kept"
                continue
            made = stage.run({t: self.read(t) for t in stage.reads})
            for t in stage.writes:
                if t in made:
                    self.put(t, made[t])
                elif self.fs.get_file_info(f"{self.base}/{t}").type == pafs.FileType.Directory:
                    self.fs.delete_dir(f"{self.base}/{t}")  # what an earlier run wrote no longer holds
            self.done[stage.name] = {"read": read, "options": mark, "wrote": {t: self.version(t) for t in stage.writes if t in made}}
            self._save()
            out[stage.name] = "done"
        return out


def _plain(x):
    if is_dataclass(x):
        return asdict(x)
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, Mapping) else x


def network_stages(names: Sequence[str], key: Sequence[str], cfg: Config = Config(), replicates: int = 100, seeds: Sequence[int] = (2025,), least_prob: float = 0.2, least_count: int = 2, alpha: float = 1.0, group: str | None = None) -> list[Stage]:
    """learn, importance, bootstrap, consensus, consensus_importance, groups and consensus_groups over the table data. Those on the consensus wait where it has no edge."""

    def shape(data: DataFrame) -> Variables:
        return variables(data, list(names))

    def edges(df: DataFrame) -> list[tuple[int, int]]:
        return sorted((r.u, r.v) for r in df.select("u", "v").collect())  # a network

    def learned(t):
        data = t["data"]
        found = learn(data, cfg, names=list(names))
        return {"edges": found.edge_frame(data.sparkSession), **({"trace": found.trace_frame(data.sparkSession)} if found.trace else {})}

    def importance(of: str, to: str, by: Sequence[str] = ()):
        return lambda t: {to: edge_importance(t["data"], edges(t[of]), shape(t["data"]), alpha, cfg.ess, by=by)}

    def agreed(t):
        found = consensus(t["integrated"], least_prob, least_count)
        if found.isEmpty():
            return {}
        vs = shape(t["data"])
        return {"consensus": found, "consensus_counts": family_counts(t["data"], families_of(edges(found), len(vs.names)), vs)}

    def stability(t):
        f = bootstrap(t["data"], list(key), replicates, seeds, cfg, names=list(names))
        return {"frequencies": f, "integrated": integrate(f, len(seeds))}

    search = {"config": cfg, "names": list(names)}
    worth = {"alpha": alpha, "ess": cfg.ess, "names": list(names)}
    out = [
        Stage("learn", ("data",), ("edges", "trace"), learned, search),
        Stage("importance", ("data", "edges"), ("importance",), importance("edges", "importance"), worth),
        Stage("bootstrap", ("data",), ("frequencies", "integrated"), stability, {**search, "key": list(key), "replicates": replicates, "seeds": list(seeds)}),
        Stage("consensus", ("data", "integrated"), ("consensus", "consensus_counts"), agreed, {"prob": least_prob, "count": least_count}),
        Stage("consensus_importance", ("data", "consensus"), ("consensus_importance",), importance("consensus", "consensus_importance"), worth),
    ]
    if group:
        out.append(Stage("groups", ("data", "edges"), ("group_importance",), importance("edges", "group_importance", [group]), {**worth, "group": group}))
        out.append(Stage("consensus_groups", ("data", "consensus"), ("consensus_group_importance",), importance("consensus", "consensus_group_importance", [group]), {**worth, "group": group}))
    return out
