"""Contingency counts of families, the sufficient statistics of every score."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.math import digits, mixed_radix

from .moments import extremes


@dataclass(frozen=True)
class Variables:
    """Names in column order and numbers of states."""

    names: tuple[str, ...]
    cards: tuple[int, ...]

    def card(self, i: int) -> int:
        return self.cards[i]


#: A child and its parents, ascending.
Family = tuple[int, tuple[int, ...]]


def variables(df: DataFrame, names: Sequence[str] | None = None) -> Variables:
    """Cardinalities as largest code + 1, in one pass. Null or negative codes raise."""
    names = tuple(names or df.columns)
    found = extremes(df, names)
    for n, (least, _, nulls) in zip(names, found, strict=True):
        if nulls or (least is not None and least < 0):
            raise ValueError(f"{n}: states must be integers from 0 on, without nulls")
    return Variables(names, tuple((most or 0) + 1 for _, most, _ in found))


def cardinalities(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable, card."""
    wide = df.agg(*[(F.max(n) + 1).cast("int").alias(n) for n in names])
    return wide.unpivot([], list(names), "variable", "card")


def normal(child: int, parents: Iterable[int]) -> Family:
    return child, tuple(sorted(set(parents)))


def families_of(edges: Iterable[tuple[int, int]], n: int) -> list[Family]:
    """One family for each node of a network given by its edges."""
    parents: dict[int, set[int]] = {v: set() for v in range(n)}
    for u, v in edges:
        if u == v or not (0 <= u < n and 0 <= v < n):
            raise ValueError(f"edge {u} -> {v} is outside the network or a loop")
        parents[v].add(u)
    return [normal(v, parents[v]) for v in range(n)]


def configurations(family: Family, cards: Sequence[int]) -> int:
    q = 1
    for p in family[1]:
        q *= cards[p]
    return q


def family_counts(df: DataFrame, families: Sequence[Family], vs: Variables, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by..., family (place in the list), v, j, k, n for all families in one scan.

    Each row is turned into one (family, j, k) for each family and summed map-side, so what is shuffled is the
    size of the tables and not of the data. Only cells that occur are listed. weight: a column to sum instead of counting.
    """
    if not families:
        raise ValueError("no families")
    cells = [
        F.struct(F.lit(i).alias("family"), F.lit(v).alias("v"), mixed_radix([F.col(vs.names[p]) for p in ps], [vs.cards[p] for p in ps]).alias("j"), F.col(vs.names[v]).cast("int").alias("k"))
        for i, (v, ps) in enumerate(families)
    ]
    used = sorted({x for v, ps in families for x in (v, *ps)})
    df = df.select(*by, *([weight] if weight else []), *[vs.names[i] for i in used])
    rows = df.select(*by, *([weight] if weight else []), F.explode(F.array(*cells)).alias("c")).select(*by, *([weight] if weight else []), "c.*")
    n = F.sum(weight) if weight else F.count("*")
    return rows.groupBy(*by, "family", "v", "j", "k").agg(n.cast("long").alias("n"))


#: A table up to this many cells is summed in an array of all its cells, a larger one by the cells that occur.
DENSE = 1 << 16
#: Cells of tables that a task sums, or passes on, at once.
TABLE_CELLS = 1 << 24
#: Data of at most so many different rows are searched, and their edges weighed, as these rows and their numbers.
COMPACT = 1 << 14
CELLS = "family int, v int, r int, q long, j long, k int, n long"


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def poisson(h: np.ndarray, run: int) -> np.ndarray:
    """How often each row, given by a 64-bit hash of its key, is in a resample: Poisson(1) by inversion, the same in any task."""
    x = _mixed((h.view(np.uint64) ^ np.uint64(run * 0x9E3779B97F4A7C15 % (1 << 64))) + np.uint64(0x632BE59BD9B4E019))
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")


#: Cumulative probabilities of Poisson(1), the limit of how often a row is drawn; 18 terms cover double precision.
_POISSON = np.cumsum(np.exp(-1.0) / np.array([math.factorial(i) for i in range(18)], float))
#: Rows whose draws one generator deals out; above that, a range's draws are halved by binomials.
DEALT = 1 << 10


class Draws:
    """How often each of rows numbered 0 to n - 1 is in a resample of n draws with replacement: exactly n draws in all.

    The draws of a range of numbers are split between its halves by a binomial of the halves' lengths, down to blocks of DEALT rows, over which
    a multinomial deals them. Each of these has a generator of its own, keyed by run and range, so that any task finds the draws of
    its rows by a walk from the top, and they don't depend on what else it holds.
    """

    def __init__(self, n: int, run: int):
        self.n, self.run = n, run
        self.blocks = max(1, -(-n // DEALT))
        self.known: dict[tuple[int, int], int] = {(0, self.blocks): n}

    def _generator(self, first: int, last: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(np.random.SeedSequence([self.run % (1 << 63), first, last])))

    def _rows(self, first: int, last: int) -> int:
        return min(last * DEALT, self.n) - first * DEALT

    def _block(self, block: int) -> np.ndarray:
        first, last = 0, self.blocks
        while last - first > 1:
            middle, n = (first + last) // 2, self.known[first, last]
            if (first, middle) not in self.known:
                left = int(self._generator(first, last).binomial(n, self._rows(first, middle) / self._rows(first, last)))
                self.known[first, middle], self.known[middle, last] = left, n - left
            first, last = (first, middle) if block < middle else (middle, last)
        rows = self._rows(first, last)
        return self._generator(first, last).multinomial(self.known[first, last], np.full(rows, 1 / rows))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(numbers), np.int64)
        block = numbers // DEALT
        for b in np.unique(block).tolist():
            own = block == b
            out[own] = self._block(b)[numbers[own] - b * DEALT]
        return out


@dataclass(frozen=True)
class Packed:
    """A discrete table by columns: a row (part, var, states) for each variable of each chunk of rows, the parts of a chunk next to each
    other. Plans over it have three columns, however many variables there are, and a scan can pick its variables.

    key: it also has what tells rows apart, for resamples. draws: the keys are the rows' numbers from 0 on, of so many rows, and a
    resample has exactly as many draws; if None, they are hashes, and each row is drawn Poisson(1) times by its own. drawn: the resamples
    for each of which a column, after the variables, says how often a row has been drawn; there is no weight or key then (see resampled())."""

    rows: DataFrame
    vs: Variables
    weight: bool = False
    key: bool = False
    draws: int | None = None
    drawn: tuple[int, ...] = ()


def state_type(cards: Sequence[int], var: int) -> np.dtype:
    """States are bytes where they fit; the weight and the key, which come after the variables, are 64-bit numbers."""
    return np.dtype("<i8" if var >= len(cards) else "u1" if cards[var] <= 256 else "<i4")


PACKED = "part long, var int, states binary"


def pack(df: DataFrame, vs: Variables, weight: str | None = None, key: str | None = None, draws: int | None = None) -> Packed:
    """df by columns; weight and key: columns of 64-bit numbers that say how often a row counts and what tells it apart; draws: see Packed."""
    extra = [c for c in (weight, key) if c]
    kinds = [state_type(vs.cards, i) for i in range(len(vs.names) + len(extra))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in enumerate(batches):
            blobs = [c.to_numpy(zero_copy_only=False).astype(t).tobytes() for c, t in zip(batch.columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), part)), pa.array(np.arange(len(blobs), dtype=np.int32)), pa.array(blobs, pa.binary())], ["part", "var", "states"])

    columns = df.select(*[F.col(n).cast("int").alias(n) for n in vs.names], *[F.col(c).cast("long").alias(c) for c in extra])
    return Packed(columns.mapInArrow(task, PACKED), vs, bool(weight), bool(key), draws)


def chunks(batches: Iterator[pa.RecordBatch], cards: Sequence[int]) -> Iterator[dict[int, np.ndarray]]:
    """Chunk after chunk, its variables' states."""
    part, held = None, {}
    for batch in batches:
        for p, var, states in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and (p != part or var in held):
                yield held
                held = {}
            part, held[var] = p, np.frombuffer(states.as_buffer(), state_type(cards, var))
    if held:
        yield held


#: A resample's number, or None for the rows as they are, and a family.
Request = tuple[int | None, Family]
TABLES = "family int, width int, ids binary, n binary"


@dataclass
class Table:
    """Counts of a family in all the runs that ask for it: cells x runs. ids: the cells that the lines are, or None for all of them in order;
    a cell's number is j * r + k. places: where the runs stand in the requests."""

    family: Family
    r: int
    q: int
    places: list[int]
    ids: np.ndarray | None
    n: np.ndarray


def _asked(requests: Sequence[Request]) -> list[tuple[Family, list[int | None], list[int]]]:
    """Each family once, with the runs that ask for it and their places."""
    found: dict[Family, tuple[list[int | None], list[int]]] = {}
    for place, (run, family) in enumerate(requests):
        runs, places = found.setdefault(family, ([], []))
        runs.append(run)
        places.append(place)
    return [(f, *x) for f, x in found.items()]


#: Types of counts by their width in bytes.
WIDTHS = {1: "u1", 2: "<u2", 4: "<u4", 8: "<i8"}


def narrow(n: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    most = int(n.max(initial=0))
    return n.astype(WIDTHS[1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8])


def _merged(ids: np.ndarray, n: np.ndarray, more: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two sets of cells x runs, by cell."""
    every, both = np.concatenate([ids, more]), np.concatenate([n, m])
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(every[order]) > 0))
    return every[order][first], np.add.reduceat(both[order], first, 0)


def table_sums(data: Packed, requests: Sequence[Request], emit: Callable[[list[Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """emit() of whole tables, some thousands at a time, for any number of requests in one scan.

    A family's configurations are found once for all its runs: rows are sorted by cell, and the cells' sums are taken of the matrix of
    rows x runs that says how often each run has drawn each row. A task sums what it reads and sends one table a family, in bytes where
    they hold its counts; tables are dealt by family and added where they meet. A family's cells meet in one task: as many as
    occur, whatever the number of rows.
    """
    vs, cards = data.vs, data.vs.cards
    asked = _asked(requests)
    used = sorted({x for (v, ps), _, _ in asked for x in (v, *ps)})
    d = len(vs.names)
    weight, key = (d if data.weight else None), (d + data.weight if data.key else None)
    every = sorted({run for _, runs, _ in asked for run in runs if run is not None})
    at = {run: i for i, run in enumerate(every)}
    draws, resampled = data.draws, bool(every)
    given = [d + data.drawn.index(run) for run in every] if data.drawn else []
    if data.drawn and any(None in runs for _, runs, _ in asked):
        raise ValueError("resamples' rows don't tell those of the data")
    shapes = [(v, [(p, cards[p]) for p in ps], cards[v], configurations((v, ps), cards), [at.get(run) for run in runs], places) for (v, ps), runs, places in asked]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list = [None] * len(shapes)
        exact = [Draws(draws, run) for run in every] if draws is not None and not given else None
        for held in chunks(batches, cards):
            states = {x: held[x].astype(np.int64) for x in used}
            rows = len(states[used[0]])
            plain = np.ones(rows) if weight is None else held[weight].astype(float)
            if given:
                drawn = np.stack([held[x] for x in given], 1).astype(float)
            elif resampled:
                drawn = np.stack([x.of(held[key]) for x in exact] if exact else [poisson(held[key], run) for run in every], 1) * plain[:, None]
            for i, (v, ps, r, q, runs, _) in enumerate(shapes):
                cell = np.zeros(rows, np.int64)
                for p, card in ps:
                    cell = cell * card + states[p]
                cell = cell * r + states[v]
                if len(runs) == 1:
                    w = (None if weight is None else plain) if runs[0] is None else drawn[:, runs[0]]
                    if q * r <= DENSE:
                        own = np.bincount(cell, w, q * r)[:, None]
                        total[i] = own if total[i] is None else total[i] + own
                        continue
                    some, back = np.unique(cell, return_inverse=True)
                    own = np.bincount(back, w, len(some))[:, None]
                else:
                    w = np.stack([plain if x is None else drawn[:, x] for x in runs], 1) if None in runs or len(runs) < len(every) else drawn[:, runs]
                    order = np.argsort(cell, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(cell[order]) > 0))
                    some, own = cell[order][first], np.add.reduceat(w[order], first, 0)
                    if q * r <= DENSE and q * r * len(runs) <= TABLE_CELLS:
                        if total[i] is None:
                            total[i] = np.zeros((q * r, len(runs)))
                        total[i][some] += own
                        continue
                total[i] = (some, own) if total[i] is None else _merged(*total[i], some, own)
        for a in range(0, len(shapes), 4096):
            out = []
            for i in range(a, min(a + 4096, len(shapes))):
                if total[i] is not None:
                    ids, n = total[i] if isinstance(total[i], tuple) else (None, total[i])
                    n = narrow(n)
                    out.append((i, n.dtype.itemsize, None if ids is None else ids.tobytes(), n.tobytes()))
                    total[i] = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)], ["family", "width", "ids", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, ids, n = [], 0, None, None, None

        def done() -> Table:
            v, _, r, q, _, places = shapes[now]
            return Table(asked[now][0], r, q, places, ids, n)

        for batch in batches:
            for i, width, cells, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.frombuffer(counts, WIDTHS[width]).astype(np.int64).reshape(-1, len(shapes[i][5]))
                own_ids = None if cells is None else np.frombuffer(cells, np.int64)
                if i != now:
                    if now is not None:
                        held.append(done())
                        size += n.size
                        if size > TABLE_CELLS // 16:
                            yield from emit(held)
                            held, size = [], 0
                    now, ids, n = i, own_ids, own
                elif ids is None:
                    n = n + own
                else:
                    ids, n = _merged(ids, n, own_ids, own)
        if now is not None:
            held.append(done())
        if held:
            yield from emit(held)

    needed = [*used, *[x for x in (weight, key) if x is not None], *given]
    rows = data.rows if len(needed) > 256 else data.rows.where(F.col("var").isin(needed))
    return rows.mapInArrow(task, TABLES).repartition("family").sortWithinPartitions("family").mapInArrow(add, schema)


def count_cells(data: Packed, requests: Sequence[Request]) -> DataFrame:
    """family (place in requests), v, r, q, j, k, n of the cells that occur, for any number of requests in one scan."""

    def emit(tables: list[Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for place, n in zip(t.places, t.n.T, strict=True):
                some = np.flatnonzero(n)
                cell = some if t.ids is None else t.ids[some]
                m = len(cell)
                columns = [np.full(m, place, np.int32), np.full(m, t.family[0], np.int32), np.full(m, t.r, np.int32), np.full(m, t.q), cell // t.r, (cell % t.r).astype(np.int32), n[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in CELLS.split(", ")])

    return table_sums(data, requests, emit, CELLS)


def resampled(data: Packed, runs: Sequence[int]) -> Packed:
    """The different rows of data and how often each resample has drawn them, from one scan: what resamples of few possible rows are learnt
    from. Tables of them are those of data."""
    cards, d = data.vs.cards, len(data.vs.names)
    whole: Family = (0, tuple(range(1, d)))

    def emit(tables: list[Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            rest, k = np.divmod(np.arange(len(t.n)) if t.ids is None else t.ids, t.r)
            states = {0: k}
            for p in reversed(whole[1]):
                rest, states[p] = np.divmod(rest, cards[p])
            some = t.n.any(1)
            blobs = [states[x][some].astype(state_type(cards, x)).tobytes() for x in range(d)]
            place = {p: i for i, p in enumerate(t.places)}
            blobs += [t.n[some, place[i]].astype("<i8").tobytes() for i in range(len(runs))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(blobs), np.int64)), pa.array(np.arange(len(blobs), dtype=np.int32)), pa.array(blobs, pa.binary())], ["part", "var", "states"])

    return Packed(table_sums(data, [(run, whole) for run in runs], emit, PACKED), data.vs, drawn=tuple(runs))


def with_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """counts and, with k null, the total of each configuration: an aggregate of the aggregate."""
    totals = counts.groupBy(*by, "family", "v", "j").agg(F.sum("n").alias("n")).withColumn("k", F.lit(None).cast("int"))
    return counts.unionByName(totals)


def drop_parent(counts: DataFrame, family: Family, parent: int, vs: Variables) -> DataFrame:
    """Counts of the family without one parent, from its counts alone."""
    _, ps = family
    cards = [vs.cards[p] for p in ps]
    d = digits(F.col("j"), cards)
    kept = [i for i, p in enumerate(ps) if p != parent]
    j: Column = mixed_radix([d[i] for i in kept], [cards[i] for i in kept])
    return counts.withColumn("j", j).groupBy("family", "v", "j", "k").agg(F.sum("n").alias("n"))


def joint_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.groupBy(*names).agg(F.count("*").alias("n"))
