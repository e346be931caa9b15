"""Members of zip archives as a partitioned source, and the studies' data sets that come in such archives or in folders of files."""

from __future__ import annotations

import fnmatch
import io
import json
import os
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arbora.functions.text import sanitize_label
from arbora.operators.order import numbered_blocks

from .files import read_wide, tissue_label

#: The parts of a network's data of the fourth challenge, in the order in which they are stacked.
DREAM4_PARTS = ("multifactorial", "knockouts", "knockdowns", "timeseries", "wildtype")
#: Lines of a member that make a batch.
LINES = 4096


def _uri(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def opened(path: str) -> zipfile.ZipFile:
    """An archive in any store that its machine reaches by the path; only the parts that are asked for are read."""
    fs, base = _uri(path)
    return zipfile.ZipFile(fs.open_input_file(base))


def exists(path: str) -> bool:
    fs, base = _uri(path)
    return fs.get_file_info(base).type == pafs.FileType.File


def _lines(archive: zipfile.ZipFile, member: str) -> Iterator[str]:
    with io.TextIOWrapper(archive.open(member), encoding="utf-8", errors="replace") as stream:
        for line in stream:
            yield line.rstrip("\r\n")


def _header(archive: zipfile.ZipFile, member: str, sep: str) -> list[str]:
    return [x.strip().strip('"') for x in next((line for line in _lines(archive, member) if line.strip()), "").split(sep)]


class Members(DataSource):
    """spark.read.format("archive_members"): the members of a zip archive, a partition each, in the order of the option members (a JSON list of names
    or patterns; a pattern's members by name). Nothing is unpacked: a task reads its members from the archive itself.

    kind lines (the default): part (the member's number), member, line (from 0), value. kind matrix: part, member, line and a column of doubles for each column of the
    members' headers, but for those of the option drop (a JSON list, any case); all members must have the same columns in the same
    order. Lines of another number of cells, or with a cell that is no number, are left out, as are empty ones. sep: a tab.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def _chosen(self) -> list[str]:
        with opened(self.options["path"]) as z:
            names, out = z.namelist(), []
        for wanted in json.loads(self.options.get("members", '["*"]')):
            out += [wanted] if wanted in names else sorted(fnmatch.filter(names, wanted))
        out = [m for m in dict.fromkeys(out) if not m.endswith("/")]
        if not out:
            raise ValueError(f"no member of {self.options['path']} fits")
        return out

    def _columns(self, chosen: Sequence[str]) -> list[str]:
        """The members' columns but the dropped ones; other columns in a member raise."""
        sep, drop = self.options.get("sep", "\t"), {x.lower() for x in json.loads(self.options.get("drop", "[]"))}
        first = None
        with opened(self.options["path"]) as z:
            for member in chosen:
                header = _header(z, member, sep)
                own = [c for c in header if c.lower() not in drop]
                if first is not None and own != first:
                    raise ValueError(f"{member} has other columns than {chosen[0]}, or another order")
                first = own
        return first

    def schema(self) -> T.StructType:
        fields = [T.StructField("part", T.IntegerType()), T.StructField("member", T.StringType()), T.StructField("line", T.LongType())]
        if self.options.get("kind", "lines") == "lines":
            return T.StructType([*fields, T.StructField("value", T.StringType())])
        return T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in self._columns(self._chosen())]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MembersReader(self.options, schema, self._chosen())


class Member(InputPartition):
    def __init__(self, part: int, member: str):
        super().__init__((part, member))


class MembersReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType, chosen: list[str]):
        self.path, self.sep, self.lines = options["path"], options.get("sep", "\t"), options.get("kind", "lines") == "lines"
        self.drop = {x.lower() for x in json.loads(options.get("drop", "[]"))}
        self.names, self.chosen = schema.names, chosen

    def partitions(self) -> list[InputPartition]:
        return [Member(i, m) for i, m in enumerate(self.chosen)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        part, member = partition.value
        with opened(self.path) as z:
            yield from self._rows(part, member, z) if self.lines else self._cells(part, member, z)

    def _batch(self, part: int, member: str, first: int, values: Sequence[pa.Array]) -> pa.RecordBatch:
        n = len(values[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([member] * n), pa.array(np.arange(first, first + n)), *values], self.names)

    def _rows(self, part: int, member: str, z: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for line in _lines(z, member):
            held.append(line)
            if len(held) == LINES:
                yield self._batch(part, member, n, [pa.array(held)])
                n, held = n + len(held), []
        if held:
            yield self._batch(part, member, n, [pa.array(held)])

    def _cells(self, part: int, member: str, z: zipfile.ZipFile) -> Iterator[pa.RecordBatch]:
        kept, width, held, n = None, 0, [], 0
        for line in _lines(z, member):
            if not line.strip():
                continue
            cells = line.split(self.sep)
            if kept is None:
                header = [x.strip().strip('"').lower() for x in cells]
                width, kept = len(header), [i for i, c in enumerate(header) if c not in self.drop]
                continue
            if len(cells) != width:
                continue
            try:
                held.append([float(cells[i].strip().strip('"')) for i in kept])
            except ValueError:
                continue
            if len(held) == LINES:
                yield self._batch(part, member, n, [pa.array(x) for x in np.array(held).T])
                n, held = n + len(held), []
        if held:
            yield self._batch(part, member, n, [pa.array(x) for x in np.array(held).T])


def _source(spark: SparkSession, archive: str, members: Sequence[str], **options: str) -> DataFrame:
    spark.dataSource.register(Members)
    return spark.read.format("archive_members").options(members=json.dumps(list(members)), **options).load(archive)


def read_lines(spark: SparkSession, archive: str, members: Sequence[str]) -> DataFrame:
    """part, member, line, value of the members of an archive."""
    return _source(spark, archive, members)


def read_matrices(spark: SparkSession, archive: str, members: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """part, member, line and the columns of the members of an archive, one below the other (order them by part and line)."""
    return _source(spark, archive, members, kind="matrix", drop=json.dumps(list(drop)))


def _names(archive: str) -> list[str]:
    with opened(archive) as z:
        return z.namelist()


def _pairs(lines: DataFrame, least: int) -> DataFrame:
    """line, u, v, is_edge of lines of two names and a label, which is 1 for an edge (and where it is missing). Shorter lines than least cells are left out."""
    p = F.split("value", "\t")
    label = F.when(F.size(p) > 2, F.trim(F.get(p, F.lit(2)))).otherwise("1")
    return lines.where(F.size(p) >= least).select("line", F.trim(p[0]).alias("u"), F.trim(p[1]).alias("v"), (label == "1").alias("is_edge"))


def read_dream4(spark: SparkSession, archive: str, net: str, parts: Sequence[str] = DREAM4_PARTS) -> tuple[DataFrame, DataFrame]:
    """The data of a network of the fourth challenge (insilico_size10_1, say), its parts stacked in their order without the time, and its gold standard
    (line, u, v, is_edge). Parts that the archive lacks are passed over; none at all raises, as do parts of other columns."""
    names = _names(archive)
    train = [m for m in names if f"DREAM4 training data/{net}/" in m]
    chosen = [m for part in parts for m in train if m.endswith(f"{net}_{part}.tsv")]
    gold = [m for m in names if m.endswith(f"DREAM4 gold standards/{net}_goldstandard.tsv")] or [m for m in names if m.endswith(f"{net}_goldstandard.tsv")]
    if not chosen or not gold:
        raise ValueError(f"{archive} has no training data or no gold standard of {net}")
    return read_matrices(spark, archive, chosen, ["time"]), _pairs(read_lines(spark, archive, gold[:1]), 3)


def read_dream5(spark: SparkSession, archive: str, number: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The expression of a network of the fifth challenge, its regulators (name; none if the archive lists none) and its gold standard (line, u, v, is_edge)."""
    names = _names(archive)
    data = [m for m in names if m.endswith(f"net{number}_expression_data.tsv")]
    gold = sorted(m for m in names if f"Network{number}/gold standard/" in m and m.endswith((".tsv", ".txt")))
    if not data or not gold:
        raise ValueError(f"{archive} has no expression or no gold standard of network {number}")
    listed = [m for m in names if m.endswith(f"net{number}_transcription_factors.tsv")]
    none = spark.createDataFrame([], "name string")
    regulators = read_lines(spark, archive, listed[:1]).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).where("name <> ''") if listed else none
    return read_matrices(spark, archive, data[:1]), regulators, _pairs(read_lines(spark, archive, gold[:1]), 2)


def read_placed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Expression and true edges (u, v) of a folder that holds expression.tsv and true_edges.tsv; None if one is missing."""
    data, truth = f"{folder}/expression.tsv", f"{folder}/true_edges.tsv"
    if not (exists(data) and exists(truth)):
        return None
    wide = read_wide(spark, data, sep="\t")
    p = F.split(F.trim("value"), r"\s+")
    edges = spark.read.text(truth).where(F.size(p) >= 2).select(p[0].alias("u"), p[1].alias("v"))
    quoted = ["`" + c.replace("`", "``") + "`" for c in wide.columns]
    return wide.select(*[F.col(q).cast("double").alias(c.strip('"')) for q, c in zip(quoted, wide.columns, strict=True)]), edges


def tissue_samples(spark: SparkSession, pattern: str, columns: Sequence[str], rows: int) -> DataFrame | None:
    """row_index, sample_id, group of a matrix whose rows are those of one file for each tissue, the files one after another by name.

    The first file's first columns must be the matrix's, and all files together must have its number of rows; otherwise the rows can't be told
    to belong together, and there is None. A sample is called by its tissue and its number within the file, from 1.
    """
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).where("trim(value) <> ''")
    lines = numbered_blocks(lines, "file", "block", "line")
    heads = lines.where("line = 0").orderBy("file").collect()  # a line for each file
    if not heads or heads[0].value.split("\t")[: len(columns)] != list(columns):
        return None
    sizes, starts, total = lines.groupBy("file").agg((F.count("*") - 1).alias("n")).orderBy("file").collect(), [], 0
    for r in sizes:
        starts.append((r.file, total))
        total += r.n
    if total != rows:
        return None
    table = spark.createDataFrame(starts, "file string, start long")  # a row for each file
    group = sanitize_label(tissue_label(F.col("file")))
    placed = lines.where("line > 0").join(F.broadcast(table), "file")
    return placed.select((F.col("start") + F.col("line") - 1).alias("row_index"), F.concat_ws("_", group, F.col("line").cast("string")).alias("sample_id"), group.alias("group"))
