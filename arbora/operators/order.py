"""Row numbers of a distributed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.scratch import fresh, stored


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row_number", first: int = 0) -> DataFrame:
    """df with the number of each row in the order, counted from first.

    Rows are range-sorted and stored with a number that tells partition and place; the sizes of the partitions, one number each, are
    added up before each. So no task holds more than its share, whatever the number of rows. Rows that tie are numbered as they
    come, once and for all. A column called like the number is replaced.
    """
    spark = df.sparkSession
    df = df.drop(name)
    at, piece, start = fresh([*df.columns, name], "at", "piece", "start")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    sizes = sorted_.groupBy(F.shiftright(at, 33).alias(piece)).agg(F.count("*").alias("n")).orderBy(piece).collect()
    starts, n = [], first
    for r in sizes:
        starts.append((r[piece], n))
        n += r.n
    table = spark.createDataFrame(starts, f"`{piece}` long, `{start}` long")  # a row for each partition
    placed = sorted_.withColumn(piece, F.shiftright(at, 33)).join(F.broadcast(table), piece)
    return placed.select(*[c for c in df.columns], (F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1)).alias(name))


def numbered_blocks(rows: DataFrame, file: str, block: str, name: str = "line", first: int = 0) -> DataFrame:
    """rows of files, as they are read, with each one's number within its file, counted from first. file and block: columns that name the
    file of a row and the start of the part of it that a task reads in one go, as a scan tells them (_metadata.file_path and
    _metadata.file_block_start).

    The rows of each block are counted, and the counts added up before each block of a file: a number for each block. Nothing is sorted.
    """
    at, least, before = fresh([*rows.columns, name], "at", "least", "before")
    rows = rows.withColumn(at, F.monotonically_increasing_id())
    starts, n, last = [], first, None
    for r in rows.groupBy(file, block).agg(F.min(at).alias("least"), F.count("*").alias("n")).orderBy(file, block).collect():
        if r[file] != last:
            n, last = first, r[file]
        starts.append((r[file], r[block], r.least, n))
        n += r.n
    table = rows.sparkSession.createDataFrame(starts, f"`{file}` string, `{block}` long, `{least}` long, `{before}` long")  # a row for each block
    placed = rows.join(F.broadcast(table), [file, block])
    return placed.select(*[c for c in rows.columns if c != at], (F.col(at) - F.col(least) + F.col(before)).alias(name))
