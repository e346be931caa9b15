"""Intermediate tables in the folder that all machines of a cluster share, and names for helper columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions, by application, and what has been stored.
_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[str, str]] = []


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for helper columns that clash with none of the taken ones, in Spark's sense (case does not tell names apart)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, needed: Sequence[str], new: Sequence[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns that an operator needs under these very names, those named like the ones it adds left out, and all others
    under names that clash with nothing; and what gives a result's columns their own names back.

    Names are told apart as Spark does, by case only where a needed name is there in its own case too; others may hold dots, backticks or
    anything else, and may repeat.
    """
    serves = {}
    for name in needed:
        found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"there must be one column {name}; there are {len(found)}")
        serves[found[0]] = name
    added = {n.lower() for n in new}
    stand_ins = fresh([*needed, *new], *[f"other_{i}" for i in range(len(df.columns))])
    names = [serves.get(i, stand_ins[i]) for i in range(len(df.columns))]
    own = dict(zip(names, df.columns, strict=True))
    out = df.toDF(*names).drop(*[n for i, n in enumerate(names) if i not in serves and df.columns[i].lower() in added])
    return out, lambda result: result.toDF(*[own.get(c, c) for c in result.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder of its own
    for as long as it lives; a cluster has none that all its machines would see, and raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="arbora-")
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application's operators have stored so far. Call it when their results have been written or collected."""
    own = [p for app, p in _WRITTEN if app == spark.sparkContext.applicationId]
    _WRITTEN[:] = [(app, p) for app, p in _WRITTEN if app != spark.sparkContext.applicationId]
    for path in own:
        fs, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        if fs.get_file_info(base).type != pafs.FileType.NotFound:
            fs.delete_dir(base)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
