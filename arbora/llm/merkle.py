"""Operator 13: a Merkle manifest of a data set, with a proof for each row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FAN_OUT = 16
#: A level of proof: what stands left and right of the node in its run, as one string of digests each.
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """SHA-256 in lower-case hex of the parts, one after another; digests go in as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its number of UTF-8 bytes, a colon and itself; a hyphen for null. No two lists of values read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column | str) -> Column:
    return digest(*[field(F.col(v) if isinstance(v, str) else v) for v in values])


@dataclass(frozen=True)
class Tree:
    """Levels from the leaves on, as stored tables of runs: key, run, children (place, digest, payload), digest of the run, whole (the
    run is its key's only node, so that its single child is what remains of the key)."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """key, digest: what remains of each key."""
        out = None
        for level in self.levels:
            own = level.where("whole").select("key", F.col("children")[0]["digest"].alias("digest"))
            out = own if out is None else out.unionByName(own)
        return out


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """key, digest, payload (and the columns of order) -> key, pos, digest, payload: each key's nodes counted from 0 in that order.

    Rows are range-sorted by key, order and a number of the row, so that neither a key with most rows nor one row repeated lands in
    one task. A task counts within what it holds; only the first key of a task can have begun in an earlier one, so that one number a
    task, broadcast, tells where its count begins.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = stored(nodes.withColumn("row", F.monotonically_increasing_id()), "merkle-nodes")
    keys = ["key", *order, "row"]
    dealt = held.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    # The number holds the partition above its lowest 33 bits and the place within it below.
    dealt = stored(dealt.select("key", "digest", "payload", F.monotonically_increasing_id().alias("at")), "merkle-sorted")
    spot = dealt.select("key", F.shiftright("at", 33).alias("piece"), (F.col("at").bitwiseAND((1 << 33) - 1)).alias("nth"))
    starts = stored(spot.groupBy("piece", "key").agg(F.count("*").alias("n"), F.min("nth").alias("first")), "merkle-starts")
    # One row for each partition: its first key, how much of its last key it holds, and whether that is all it holds.
    ends = starts.groupBy("piece").agg(F.min_by("key", "first").alias("head"), F.max_by("key", "first").alias("tail"), F.max_by("n", "first").alias("n"), F.count("*").alias("keys"))
    before, open_key, open_n = [], None, 0
    for r in ends.orderBy("piece").collect():
        before.append((r.piece, r.head, open_n if r.head == open_key else 0))
        open_n = r.n + (open_n if r.keys == 1 and r.head == open_key else 0)
        open_key = r.tail
    carried = spark.createDataFrame(before, "p long, head string, carried long")
    within = dealt.withColumn("piece", F.shiftright("at", 33)).join(F.broadcast(carried), F.col("piece") == F.col("p"), "left")  # a row for each partition
    # The first key of a partition begins at its place 0, any other at a place of its own that the table of starts has.
    head = within.where(F.col("key") == F.col("head")).select("key", (F.col("at").bitwiseAND((1 << 33) - 1) + F.col("carried")).alias("pos"), "digest", "payload")
    rest = within.where(F.col("key") != F.col("head")).select("key", "piece", F.col("at").bitwiseAND((1 << 33) - 1).alias("nth"), "digest", "payload")
    rest = rest.join(starts.select("piece", "key", "first"), ["piece", "key"]).select("key", (F.col("nth") - F.col("first")).alias("pos"), "digest", "payload")
    return head.unionByName(rest)


def build(nodes: DataFrame, order: Sequence[str], fan_out: int = FAN_OUT) -> Tree:
    """nodes: key (not null), digest, payload and the columns of order -> the tree of each key, built from the bottom.

    While a key has several nodes, every fan_out consecutive ones become their digest; a shorter last run does too. What a task
    gathers is a run of at most fan_out nodes. A level is as long as the longest key's, stored before the next one reads it.
    """
    level, levels = ranked(nodes, order), []
    while True:
        children = F.array_sort(F.collect_list(F.struct("pos", "digest", "payload")))
        runs = level.groupBy("key", F.floor(F.col("pos") / fan_out).cast("long").alias("run")).agg(children.alias("children"))
        runs = runs.withColumn("digest", digest(F.array_join(F.transform("children", lambda c: c["digest"]), "")))
        runs = stored(runs.withColumn("whole", (F.col("run") == 0) & (F.size("children") == 1)), f"merkle-level{len(levels)}")
        levels.append(runs)
        if runs.where("NOT whole").isEmpty():
            return Tree(levels)
        none = F.lit(None).cast(runs.schema["children"].dataType.elementType["payload"].dataType)
        level = runs.where("NOT whole").select("key", F.col("run").alias("pos"), "digest", none.alias("payload"))


def _steps() -> Column:
    """For each child of a run, what stands left and right of it in the run."""
    texts = F.transform("children", lambda c: c["digest"])
    return F.transform(
        "children",
        lambda c, i: F.struct(
            c["pos"].alias("pos"), c["digest"].alias("digest"), c["payload"].alias("payload"),
            F.struct(F.array_join(F.slice(texts, F.lit(1), i), "").alias("left"), F.array_join(F.slice(texts, i + 2, F.size(texts)), "").alias("right")).alias("step"),
        ),
    )


def push(tree: Tree, tops: DataFrame) -> DataFrame:
    """tops: key, proof (of what remains of the key) and further columns -> key, pos, digest, payload, proof and those columns for each leaf.

    From the top down, each level's children, with their siblings put before what they inherit, are joined to the runs that they stand
    for. The join keys are unique on both sides, and a proof travels once a run, not once a node.
    """
    more = [c for c in tops.columns if c not in ("key", "proof")]
    nodes = None
    for level in reversed(tree.levels):
        lone = level.where("whole").select("key", F.explode("children").alias("c")).join(tops, "key").select("key", "c.pos", "c.digest", "c.payload", "proof", *more)
        if nodes is None:
            nodes = lone
            continue
        above = nodes.select("key", F.col("pos").alias("run"), "proof", *more)
        inner = level.where("NOT whole").join(above, ["key", "run"]).select("key", F.explode(_steps()).alias("c"), "proof", *more)
        inner = inner.select("key", "c.pos", "c.digest", "c.payload", F.concat(F.array("c.step"), "proof").alias("proof"), *more)
        nodes = inner.unionByName(lone)
    return nodes


def fold(node: Column, proof: Column) -> Column:
    """The root that a node and its proof give."""
    return F.aggregate(proof, node, lambda d, s: digest(s["left"], d, s["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right, as one string."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), source: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id (named as order), source (named so), leaf, place, subroot, root, proof (array of left, right from the leaf up) and the columns of keep, for each row.

    A leaf is the digest of the columns. Per source, leaves stand by order (nulls first; ties by leaf) and fold to the source's subroot; subroots
    by source (null first, then UTF-8 bytes) fold to the root in the same way. keep: names and expressions over docs that are carried
    along, such as a leaf to be checked. Rows with nulls in any column, empty and long texts are leaves like all others; a repeated row is a leaf
    of its own, and rows that tie have equal leaves, so that their places can't be told apart. An empty table gives an empty one. Other columns
    of docs, whatever their names, are neither read nor returned.
    """
    keep = keep or {}
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in {*columns, source, order}}
    name = quoted[source].cast("string")
    # A hyphen for null sorts before the equals sign of all others.
    key = F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name))
    payload = F.struct(quoted[order].alias("id"), *[v.alias(f"k{i}") for i, v in enumerate(keep.values())])
    nodes = docs.select(key.alias("key"), leaf(*[quoted[c] for c in columns]).alias("digest"), payload.alias("payload"))
    trees = build(nodes.withColumn("id", F.col("payload.id")), ["id", "digest"], fan_out)
    subroots = trees.tops()
    over = build(subroots.select(F.lit("").alias("key"), "digest", F.col("key").alias("payload")), ["payload"], fan_out)
    root = over.tops().select(F.lit("").alias("key"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("proof"))  # one row
    tops = push(over, root).select(F.col("payload").alias("key"), F.col("digest").alias("subroot"), "root", "proof")
    leaves = push(trees, tops)
    plain = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30))
    return leaves.select(F.col("payload.id").alias(order), plain.alias(source), F.col("digest").alias("leaf"), F.col("pos").alias("place"), "subroot", "root", "proof", *[F.col(f"payload.k{i}").alias(n) for i, n in enumerate(keep)])


def verified(proofs: DataFrame, claimed: str) -> DataFrame:
    """proofs of manifest() with folded_root, recomputed from the leaf in the column claimed and the siblings, and verified: it is the root."""
    out = proofs.withColumn("folded_root", fold(F.col(claimed), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
