"""Counts kept up to date over a stream: they add up, so each batch's delta is merged into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.operators.counts import Family, Variables, family_counts

KEYS = ["family", "v", "j", "k"]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The counts so far: the sum of all deltas. A batch that was written twice counts once."""
    deltas = spark.read.parquet(path).dropDuplicates([*KEYS, "batch"])
    return deltas.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def maintain(stream: DataFrame, families: Sequence[Family], vs: Variables, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's counts to a folder of its own under path; replaying a batch replaces its folder."""

    def merge(batch: DataFrame, number: int) -> None:
        family_counts(batch, families, vs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
