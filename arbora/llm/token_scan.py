"""Operator 1: token counts of documents in flat, unindexed token files, by a separator scan over blocks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, scratch_path, stored

#: A public SentencePiece vocabulary of 32,000 pieces; its id 2 ends a document and no text encodes to it.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SEPARATOR = 2
DTYPE = "<u2"
BLOCK_TOKENS = 1 << 20
WRITTEN = "file string, ordinal long, doc_id long"
SCANNED = "file string, block long, tokens long, places array<int>"


def _encoder(vocabulary: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Token files, one for each task and attempt, each document's ids followed by the separator; returns which document stands where.

    Null texts count as empty. Rows of lost attempts are never referred to, and so neither are their files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        encoder, name, out, at = _encoder(vocabulary), f"{uuid.uuid4().hex}.tok", None, 0
        end = np.array([separator], DTYPE).tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(ids), 64):
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                for tokens in encoder.encode([t or "" for t in texts[i : i + 64]], num_threads=1):
                    out.write(np.array(tokens, DTYPE).tobytes() + end)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids), pa.string()), pa.array(range(at, at + len(ids)), pa.int64()), pa.array(ids, pa.int64())], ["file", "ordinal", "doc_id"]
            )
            at += len(ids)
        if out:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(write, WRITTEN), "token-order")


def scan(spark: SparkSession, files: DataFrame, folder: str, separator: int = SEPARATOR, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """files (file, bytes) -> a row for each block: its tokens and the places of separators in it. Blocks are read by independent tasks."""
    width = np.dtype(dtype).itemsize
    tokens = F.floor(F.col("bytes") / width)
    blocks = files.where(tokens > 0).select("file", tokens.alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((tokens - 1) / block_tokens))).alias("block"))
    spread = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                n = min(block_tokens, r["all"] - r["block"] * block_tokens)
                with fs.open_input_file(f"{base}/{r['file']}") as f:
                    f.seek(r["block"] * block_tokens * width)
                    found = np.flatnonzero(np.frombuffer(f.read(n * width), dtype) == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["block"]]), pa.array([n]), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found, pa.int32()))],
                    ["file", "block", "tokens", "places"],
                )

    return blocks.repartition(spread, "file", "block").mapInArrow(read, SCANNED)


def stitch(blocks: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks -> file, ordinal, n_tokens, terminated of each document.

    A prefix scan over a file's blocks gives each block the number of separators before it and the last one's place, so
    that the document that straddles its start is measured across any number of blocks. What follows a file's last
    separator is one more document, not terminated; nothing follows a file that ends with a separator.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("block") * block_tokens
    blocks = blocks.withColumn("n", F.size("places")).withColumn("last", F.when(F.col("n") > 0, own + F.element_at("places", -1)))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("since", F.coalesce(F.max("last").over(before), F.lit(-1)))
    counts = F.transform(
        "places", lambda p, i: F.struct((F.col("base") + i).alias("ordinal"), (own + p - F.when(i > 0, own + F.get("places", i - 1)).otherwise(F.col("since")) - 1).alias("n_tokens"))
    )
    ended = blocks.select("file", F.explode(counts).alias("d")).select("file", "d.ordinal", "d.n_tokens", F.lit(True).alias("terminated"))
    open_ = blocks.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.sum("tokens") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens")).where("n_tokens > 0")
    return ended.unionByName(open_.withColumn("terminated", F.lit(False)))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The names and sizes of a folder's token files; contents are not read."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of each row of docs (doc_id, text), by way of token files. Null texts have 0 tokens; repeated rows stay."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    order = write_tokens(docs, folder, vocabulary)
    files = token_files(spark, folder).join(order.select("file").distinct(), "file", "left_semi")
    counts = stitch(stored(scan(spark, files, folder, block_tokens=block_tokens), "token-blocks"), block_tokens)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
