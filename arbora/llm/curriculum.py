"""Operator 6: mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, set_aside, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEATS = 2
#: Relative weight of a source at equally spaced points of the training run, by its place among the sources: falling, rising, level.
SHAPES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))
#: Documents (ids and sizes, not texts) of a piece of a source's order; each piece is summed by a task of its own.
PIECE_ROWS = 1 << 16
NON_SPACE = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NON_SPACE))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size -> with place (0-based), weight and target.

    Sources by code point, null last, take the weights in turn and share share * all words; a target stops at repeats times
    its source's size and the excess is shared anew by weight. Filled like vessels: in ascending order of capacity by
    weight, the first k sources are full for the largest k whose capacity by weight lies under the level that the rest
    would reach. The table has one row for each source, so its windows are small.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", w)
    s = s.withColumn("_cap", (F.col("source_size") * repeats).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    whole = Window.partitionBy(F.lit(0))
    before = Window.orderBy("_ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_total", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("_weights", F.sum("weight").over(whole))
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
    # The level at the first source that is not full holds for all later ones.
    s = s.withColumn("_open", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "place", "_level"))).over(whole))
    target = F.when(F.col("_open").isNull() | (F.struct("_ratio", "place") < F.struct("_open._ratio", "_open.place")), F.col("_cap")).otherwise(F.col("weight") * F.col("_open._level"))
    return s.select("source", "source_size", "place", "weight", target.alias("target"))


def _schedule(place: Column, target: Column, shapes: tuple[tuple[float, ...], ...]) -> tuple[Column, Column]:
    """A source's weights at the knots, scaled so that they integrate to its target over [0, 1], and that integral up to each knot."""
    n = len(shapes[0]) - 1
    area = [sum(x[i] + x[i + 1] for i in range(n)) / 2 / n for x in shapes]
    pick = (place % len(shapes) + 1).cast("int")
    unit = F.element_at(F.array(*[F.array(*[F.lit(float(v) / a) for v in x]) for x, a in zip(shapes, area, strict=True)]), pick)
    part = F.element_at(F.array(*[F.array(*[F.lit(sum(x[j] + x[j + 1] for j in range(i)) / 2 / n / a) for i in range(n + 1)]) for x, a in zip(shapes, area, strict=True)]), pick)
    return F.transform(unit, lambda x: x * target), F.transform(part, lambda x: x * target)


def _invert(weight: Column, demand: Column, taken: Column, knots: int) -> Column:
    """The time in [0, 1] at which the integral of the piecewise linear weight reaches taken."""
    n = knots - 1
    i = F.least(F.greatest(F.size(F.filter(demand, lambda d: d <= taken)), F.lit(1)), F.lit(n))
    w0, w1 = F.element_at(weight, i), F.element_at(weight, i + 1)
    rest, slope = F.greatest(taken - F.element_at(demand, i), F.lit(0.0)), (w1 - w0) * n
    root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
    x = F.when(w0 + root > 0, 2 * rest / (w0 + root)).otherwise(0.0)
    return F.least((i - 1) / F.lit(float(n)) + F.least(x, F.lit(1.0 / n)), F.lit(1.0))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS, shapes=SHAPES, seed: str = "mix", piece_rows: int = PIECE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns, those in keep) with size, source_size, target, taken and positions (fractions of the run; position: the first, null if not taken), in training order.

    A document's size is its number of words. Each source's documents stand in the order of a keyed hash (ties: doc_id,
    then text hash); the mix walks that order round and round until the source's target is met, so each document is taken
    floor(target / source_size) whole times, those before the cut once more, and the one at the cut in part: no document
    is taken more than repeats times its size. The first word of a document is demanded when the integral of its source's
    weight schedule reaches the words before it; that time is its position, and rows are range-sorted by it, rows that
    are not taken last. Empty and null texts have size 0 and are not taken. Sources and ids may be null; of repeated rows, each
    has a place of its own. Columns of docs named like the new ones are replaced, all others are kept whatever their names.

    docs are stored once with a number for each row, and counted then. All ordering is done on numbers and sizes; the other
    columns are moved only to be joined to the result and sorted.
    """
    new = ["size", "source_size", "target", "taken", "position", "positions"]
    if keep is not None:
        docs = docs.drop(*[c for c in docs.columns if c not in (*keep, "doc_id", "source", "text")])
    docs, back = set_aside(docs, ["doc_id", "source", "text"], new)
    kept = [c for c in docs.columns if keep is None or c not in ("doc_id", "source", "text") or c in keep]
    row, words_, order, tie = fresh([*docs.columns, *new], "row", "words", "order", "tie")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    needed = [*kept, *[c for c in ("doc_id", "source") if c not in kept]]
    held = stored(docs.select(*needed, F.monotonically_increasing_id().alias(row), word_count(F.col("text")).cast("long").alias(words_), key.alias(order), F.xxhash64("text").alias(tie)), "mix-rows")
    plan = _plan(held.select(F.col(row).alias("row"), "doc_id", "source", F.col(words_).alias("size"), F.col(order).alias("key"), F.col(tie).alias("tie")), weights, share, repeats, shapes, piece_rows)
    if set(kept) <= {"doc_id", "source"}:  # nothing else to fetch
        return back(plan.orderBy(F.col("position").asc_nulls_last(), "doc_id").select(*kept, *new))
    # The plan is the side that a task holds; texts only stream by, unsorted.
    plan = plan.select(F.col("row").alias(row), *new).hint("shuffle_hash")
    joined = held.select(*needed, row).join(plan, row)
    return back(joined.orderBy(F.col("position").asc_nulls_last(), "doc_id").select(*kept, *new))


def _plan(rows: DataFrame, weights, share, repeats, shapes, piece_rows: int) -> DataFrame:
    """row, doc_id, source, size, key, tie -> row, doc_id, source and the new columns of mix()."""
    # At least a piece for each shuffle partition, so that a hot source is spread over all of them.
    pieces = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / piece_rows))
    rows = rows.withColumn("piece", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * pieces / F.lit(1 << 32)).cast("int"))
    piece_sizes = rows.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    piece_sizes = piece_sizes.withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    sources = targets(piece_sizes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    weight, demand = _schedule(F.col("place"), F.col("target"), shapes)
    sources = sources.withColumn("weights", weight).withColumn("demand", demand).withColumnRenamed("source", "s")
    plan = piece_sizes.join(sources, F.col("source").eqNullSafe(F.col("s")))
    plan = plan.select(F.col("source").alias("s"), F.col("piece").alias("p"), "start", "source_size", "target", "weights", "demand")
    within = Window.partitionBy("source", "piece").orderBy("key", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    whole = F.round(F.col("target")).cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    offset = F.col("start") + F.col("before")
    more = F.greatest(F.lit(0), F.least(F.col("size"), whole - times * F.col("source_size") - offset))
    rows = rows.withColumn("taken", (times * F.col("size") + more).cast("long"))
    passes = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = rows.withColumn("passes", F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda n: n < passes))
    at = F.transform("passes", lambda n: _invert(F.col("weights"), F.col("demand"), (offset + n * F.col("source_size")).cast("double"), len(shapes[0])))
    rows = rows.withColumn("positions", at).withColumn("position", F.when(F.size("positions") > 0, F.element_at("positions", 1)))
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", "taken", "position", "positions")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each time a document of mix() is taken, with its position and pass (0-based), range-sorted by position."""
    return (
        mixed.drop("position")
        .select("*", F.posexplode("positions").alias("pass", "position"))
        .drop("positions")
        .orderBy("position", "doc_id", "pass")
    )


__all__ = ["mix", "targets", "training_order", "word_count"]
