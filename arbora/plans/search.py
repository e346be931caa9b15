"""Structure search: hill climbing with tabu over a small graph on the driver; every score comes from Spark counts."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.assoc import sample_rows, top_candidates
from arbora.operators.counts import COMPACT, DENSE, TABLE_CELLS, Family, Packed, Request, Variables, configurations, families_of, normal, pack, variables
from arbora.operators.scores import score_families, score_requests
from arbora.scratch import stored

EPS = 1e-12
SCORES = ("bic", "k2", "bdeu")
#: Additions into a node that are looked at for a legal one, when the next moves' families are told.
TRIED = 8
Move = tuple[str, int, int]
_RANK = {"add": 0, "remove": 1, "reverse": 2}


@dataclass(frozen=True)
class Config:
    """Options of a search. None or 0 lifts a limit, as stated for each."""

    score: str = "bic"
    ess: float = 1.0
    max_iter: int = 5000
    tabu_tenure: int = 20  # 0: greedy
    max_parents: int | None = 3
    max_children: int | None = 16
    top_k: int = 50  # 0: all
    cand_metric: str = "mi"
    mi_threshold: float = 0.0
    p_threshold: float = 1.0
    assoc_rows: int = 8000  # 0: all
    assoc_budget: int = 1500  # 0: all
    aspiration: str = "current"  # "initial": against the starting score
    seed: int = 2025
    ahead: int = 24  # nodes of which the best next moves' families are scored together with what is needed now

    def __post_init__(self) -> None:
        if self.score.lower() not in SCORES:
            raise ValueError(f"score is one of {SCORES}")
        if self.aspiration not in ("current", "initial"):
            raise ValueError("aspiration is current or initial")


@dataclass
class Result:
    edges: list[tuple[int, int]]
    score: float
    iterations: int
    trace: list[tuple[int, str, int, int, float, float, bool]] = field(default_factory=list)
    vs: Variables | None = None

    def edge_frame(self, spark) -> DataFrame:
        named = [(u, v, self.vs.names[u] if self.vs else str(u), self.vs.names[v] if self.vs else str(v)) for u, v in sorted(self.edges)]
        return spark.createDataFrame(named, "u int, v int, u_name string, v_name string")

    def trace_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.trace, "it int, op string, u int, v int, delta double, total double, best boolean")


class Graph:
    """A DAG as parent and child sets with its transitive closure: for each node the bits of all nodes that it reaches, itself included, and
    of those that reach it. A question is one look at a bit; a new edge joins bits, and a removed one has the closures of the nodes
    that reached it, and of those that it reached, put together anew from their neighbours'."""

    def __init__(self, n: int, edges: Iterable[tuple[int, int]] = ()) -> None:
        self.n = n
        self.parents = [set() for _ in range(n)]
        self.children = [set() for _ in range(n)]
        self.below = [1 << v for v in range(n)]
        self.above = [1 << v for v in range(n)]
        for u, v in edges:
            if not (0 <= u < n and 0 <= v < n) or u == v:
                raise ValueError(f"edge {u} -> {v} is outside the network or a loop")
            if self.reaches(v, u):
                raise ValueError(f"edge {u} -> {v} closes a cycle")
            self.add(u, v)

    def add(self, u: int, v: int) -> None:
        self.parents[v].add(u)
        self.children[u].add(v)
        if not self.reaches(u, v):
            above, below = self.above[u], self.below[v]
            for a in bits(above):
                self.below[a] |= below
            for b in bits(below):
                self.above[b] |= above

    def remove(self, u: int, v: int) -> None:
        self.parents[v].discard(u)
        self.children[u].discard(v)
        if not any(self.reaches(c, v) for c in self.children[u]):
            self._renew(bits(self.above[u]), self.below, self.children)
            self._renew(bits(self.below[v]), self.above, self.parents)

    def _renew(self, nodes: list[int], closure: list[int], near: list[set[int]]) -> None:
        """The closures of these nodes from their neighbours', each after those of its neighbours that are among them."""
        inside, done, todo = set(nodes), set(), list(nodes)
        while todo:
            x = todo[-1]
            wait = [y for y in near[x] if y in inside and y not in done]
            if x not in done and wait:
                todo += wait
                continue
            todo.pop()
            if x not in done:
                done.add(x)
                closure[x] = 1 << x
                for y in near[x]:
                    closure[x] |= closure[y]

    def reaches(self, a: int, b: int) -> bool:
        """Whether a directed path leads from a to b, which a node does to itself."""
        return bool(self.below[a] >> b & 1)

    def turns(self, u: int, v: int) -> bool:
        """Whether the edge u -> v can be turned without closing a cycle: no other path leads from u to v."""
        return not any(c != v and self.reaches(c, v) for c in self.children[u])

    def edges(self) -> list[tuple[int, int]]:
        return [(u, v) for u in range(self.n) for v in sorted(self.children[u])]


def bits(x: int) -> list[int]:
    """The places of a number's bits."""
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


#: Families, and what tells which ones may be needed soon -> their scores.
Scorer = Callable[[list[Family], Callable[[], list[Family]]], dict[Family, float]]


def scored(data: Packed, requests: list[Request], score: str, ess: float) -> list[float]:
    """The score of each request (see table_sums()), one job for all that a task can hold the tables of; 0 where there are no rows."""
    out, cards = [0.0] * len(requests), data.vs.cards
    # Requests of one family stand together, so that its configurations are found once.
    order = sorted(range(len(requests)), key=lambda i: (requests[i][1], -1 if requests[i][0] is None else requests[i][0]))
    a = 0
    while a < len(order):
        b, cells = a, 0
        while b < len(order) and (b == a or cells < TABLE_CELLS):
            v, ps = requests[order[b]][1]
            cells += min(DENSE, configurations((v, ps), cards) * cards[v])
            b += 1
        some = order[a:b]
        for r in score_requests(data, [requests[i] for i in some], ess).select("family", score).collect():
            out[some[r.family]] = r[score]
        a = b
    return out


def spark_scorer(data: Packed, score: str, ess: float) -> Scorer:
    """Scores of families; a job is run only where an unseen one is needed, and then brings those that may be needed soon. The packed rows
    should be cached."""
    known: dict[Family, float] = {}

    def ask(families: list[Family], soon: Callable[[], list[Family]] = list) -> dict[Family, float]:
        new = {f for f in families if f not in known}
        if new:
            new = sorted(new | {f for f in soon() if f not in known})
            known.update(zip(new, scored(data, [(None, f) for f in new], score, ess), strict=True))
        return {f: known[f] for f in families}

    return ask


def candidate_parents(df: DataFrame, vs: Variables, cfg: Config) -> list[set[int]]:
    """For each variable the partners that preselection leaves, from (a sample of) the rows."""
    n = len(vs.names)
    if cfg.top_k <= 0 and cfg.mi_threshold <= 0 and cfg.p_threshold >= 1:
        return [set(range(n)) - {v} for v in range(n)]
    if cfg.assoc_rows:
        df = sample_rows(df, [F.col(c) for c in vs.names], cfg.assoc_rows, cfg.seed).repartition(df.sparkSession.sparkContext.defaultParallelism)
    out: list[set[int]] = [set() for _ in range(n)]
    for r in top_candidates(df, vs, cfg.cand_metric, cfg.top_k, cfg.mi_threshold, cfg.p_threshold, cfg.assoc_budget, cfg.seed).select("v", "u").collect():
        out[r.v].add(r.u)
    return out


class Gains:
    """What each move would add to the score. Only moves into nodes whose parents changed are computed anew."""

    def __init__(self, g: Graph, cand: Sequence[set[int]], cfg: Config) -> None:
        self.g, self.top_in, self.top_out = g, cfg.max_parents or g.n, cfg.max_children or g.n
        self.cand = [sorted(c - {v}) for v, c in enumerate(cand)]
        self.at = [{u: i for i, u in enumerate(c)} for c in self.cand]
        self.first = np.cumsum([0, *map(len, self.cand)])
        self.child = np.repeat(np.arange(g.n), np.diff(self.first))
        self.parent = np.array([u for c in self.cand for u in c], np.int64)
        self.add = np.full(self.first[-1], -np.inf)
        self.less: dict[tuple[int, int], float] = {}
        self.own = [0.0] * g.n

    def families(self, v: int, parents: set[int] | None = None) -> list[Family]:
        """All that moves into v need: its own family (with its parents, or those given), with one more candidate, and with one parent less."""
        p = self.g.parents[v] if parents is None else parents
        more = [normal(v, p | {u}) for u in self.cand[v] if u not in p] if len(p) < self.top_in else []
        return [normal(v, p), *more, *[normal(v, p - {u}) for u in p]]

    def update(self, v: int, known: dict[Family, float]) -> None:
        p, base = self.g.parents[v], known[normal(v, self.g.parents[v])]
        self.own[v] = base
        room = len(p) < self.top_in
        self.add[self.first[v] : self.first[v + 1]] = [known[normal(v, p | {u})] - base if room and u not in p else -np.inf for u in self.cand[v]]
        self.less = {e: d for e, d in self.less.items() if e[1] != v} | {(u, v): known[normal(v, p - {u})] - base for u in p}

    def soon(self, most: int, changed: Sequence[int]) -> list[Family]:
        """The families that will be asked for after the best legal additions into so many nodes and the best removals, as known now; for nodes
        that have just changed, by what additions were worth before."""
        out, tops = [], []
        for v, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            if len(self.g.parents[v]) < self.top_in:
                for i in np.argsort(-self.add[a:b])[:TRIED].tolist():
                    u = self.cand[v][i]
                    if self.add[a + i] > -np.inf and u not in self.g.parents[v] and self._legal("add", u, v):
                        tops.append((float(self.add[a + i]), u, v))
                        break
        for _, u, v in sorted(tops, reverse=True)[:most]:
            out += self.families(v, self.g.parents[v] | {u})
        for (u, v), _ in sorted(self.less.items(), key=lambda x: -x[1])[: most // 4]:
            if v not in changed and u in self.g.parents[v]:
                out += self.families(v, self.g.parents[v] - {u})
                if v in self.at[u]:
                    out += self.families(u, self.g.parents[u] | {v})
        return out

    def best(self, allowed: Callable[[Move, float], bool]) -> tuple[Move, float] | None:
        """The legal and allowed move of the greatest gain. Of those within EPS the first: by child, additions, removals, reversals, by parent."""
        edges = sorted(self.less)
        turned = [self.less[u, v] + self.add[self.first[u] + self.at[u][v]] if v in self.at[u] else -np.inf for u, v in edges]
        gain = np.concatenate([self.add, [self.less[e] for e in edges], turned])
        n, m = len(self.add), len(edges)

        def move(i: int) -> Move:
            if i < n:
                return "add", int(self.parent[i]), int(self.child[i])
            return ("remove" if i < n + m else "reverse", *edges[(i - n) % m])

        while len(gain) and (top := int(np.argmax(gain))) is not None and gain[top] > -np.inf:
            level = gain[top]
            for i in sorted(np.flatnonzero(gain >= level - EPS).tolist(), key=lambda i: (move(i)[2], _RANK[move(i)[0]], move(i)[1])):
                if self._legal(*move(i)) and allowed(move(i), float(gain[i])):
                    return move(i), float(gain[i])
                gain[i] = -np.inf
        return None

    def _legal(self, op: str, u: int, v: int) -> bool:
        g = self.g
        if op == "add":
            return len(g.children[u]) < self.top_out and not g.reaches(v, u)
        if op == "remove":
            return True
        return len(g.children[v]) < self.top_out and g.turns(u, v)


#: Families that are needed, and what tells those that may be needed soon.
Needs = tuple[list[Family], Callable[[], list[Family]]]


def walk(n: int, cand: Sequence[set[int]], cfg: Config, init: Iterable[tuple[int, int]] = ()) -> Generator[Needs, dict[Family, float], Result]:
    """The search itself: yields the families whose scores it needs, and what tells those that the next moves may need; is sent the former's
    scores, and returns the result. The first of the best moves is taken; greedy stops where no move gains more than EPS, tabu goes on with the best move that is not forbidden (or
    that beats the aspiration level) and returns the best network met."""
    g = Graph(n, init)
    gains = Gains(g, cand, cfg)
    known = yield [f for v in range(n) for f in gains.families(v)], list
    for v in range(n):
        gains.update(v, known)
    total = best = start = sum(gains.own)
    best_edges, trace, done = g.edges(), [], 0
    until: dict[Move, int] = {}
    for it in range(cfg.max_iter):

        def allowed(m: Move, gain: float, it=it, total=total, best=best) -> bool:
            level = start if cfg.aspiration == "initial" else best
            return not (cfg.tabu_tenure and until.get(m, 0) > it and total + gain <= level + EPS)

        found = gains.best(allowed)
        if found is None or (cfg.tabu_tenure == 0 and found[1] <= EPS):
            break
        (op, u, v), gain = found
        total += gain
        if op != "add":
            g.remove(u, v)
        if op == "add":
            g.add(u, v)
        elif op == "reverse":
            g.add(v, u)
        forbid = {"add": [("remove", u, v), ("reverse", u, v)], "remove": [("add", u, v)], "reverse": [("reverse", v, u)]}[op]
        for m in forbid:
            until[m] = it + cfg.tabu_tenure
        done = it + 1
        better = total > best + EPS
        trace.append((done, op, u, v, gain, total, better))
        if better:
            best, best_edges = total, g.edges()
        changed = [v, u] if op == "reverse" else [v]
        known = yield [f for x in changed for f in gains.families(x)], lambda changed=changed: gains.soon(cfg.ahead, changed)
        for x in changed:
            gains.update(x, known)
    return Result(best_edges, best, done, trace)


def climb(n: int, cand: Sequence[set[int]], scorer: Scorer, cfg: Config, init: Iterable[tuple[int, int]] = ()) -> Result:
    """walk() with all scores from one scorer."""
    search = walk(n, cand, cfg, init)
    needed = next(search)
    while True:
        try:
            needed = search.send(scorer(*needed))
        except StopIteration as end:
            return end.value


def learn(df: DataFrame, cfg: Config = Config(), init: Iterable[tuple[int, int]] = (), names: Sequence[str] | None = None, vs: Variables | None = None) -> Result:
    """Learns a network from a table of discrete columns. Of few possible rows only the different ones and their numbers are kept."""
    vs = vs or variables(df, names)
    rows, weight = df.select(*vs.names), None
    if np.prod([float(c) for c in vs.cards]) <= COMPACT:
        weight = unused(vs.names, "rows")
        rows = rows.groupBy(*vs.names).agg(F.count("*").alias(weight))
    data = kept(pack(rows, vs, weight))
    try:
        cand = candidate_parents(df.select(*vs.names), vs, cfg)
        result = climb(len(vs.names), cand, spark_scorer(data, cfg.score.lower(), cfg.ess), cfg, init)
    finally:
        data.rows.unpersist()
    result.vs = vs
    return result


def kept(data: Packed) -> Packed:
    """data stored and cached: a search plans many small jobs over them, and each would otherwise go through the plan that made them."""
    return replace(data, rows=stored(data.rows, "packed").cache())


def unused(names: Sequence[str], name: str) -> str:
    """name, with as many underscores before it as make it none of names."""
    while name.lower() in {n.lower() for n in names}:
        name = f"_{name}"
    return name


def score_network(df: DataFrame, edges: Iterable[tuple[int, int]], vs: Variables, ess: float = 1.0) -> DataFrame:
    """v, loglik, bic, k2, bdeu of a given network, without any search."""
    return score_families(df, families_of(edges, len(vs.names)), vs, ess).drop("family")


def late_gain(trace: DataFrame, total: int) -> DataFrame:
    """Whether the last gain came in the final tenth of the iteration budget."""
    return trace.where("best").agg((F.coalesce(F.max("it") - 1, F.lit(0)) >= F.floor(F.lit(0.9 * total))).cast("int").alias("budget_binding"))
