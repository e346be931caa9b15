"""Reader of networks in BIF."""

from __future__ import annotations

import gzip
import re
from itertools import product

import numpy as np

from arbora.plans.evaluation import Network

_VARIABLE = re.compile(r"variable\s+(\"[^\"]+\"|\S+)\s*\{[^}]*?discrete\s*\[\s*\d+\s*\]\s*\{([^}]*)\}", re.S)
_PROBABILITY = re.compile(r"probability\s*\(([^)]*)\)\s*\{(.*?)\}", re.S)
_ROW = re.compile(r"(?:\(([^)]*)\)|\b(table|default)\b)\s*([^;]*);")


def _name(x: str) -> str:
    return x.strip().strip('"')


def parse_bif(text: str) -> Network:
    """A network from BIF text. Rows are scaled to 1; default entries are ignored; a table with parents lists a state's configurations together."""
    text = re.sub(r"//[^\n]*", "", text)
    names, states = [], []
    for m in _VARIABLE.finditer(text):
        names.append(_name(m[1]))
        states.append([_name(x) for x in m[2].split(",")])
    at = {n: i for i, n in enumerate(names)}
    parents: list[list[int]] = [[] for _ in names]
    tables: list[np.ndarray | None] = [None] * len(names)
    for m in _PROBABILITY.finditer(text):
        child, _, given = m[1].partition("|")
        v = at[_name(child)]
        ps = [at[_name(x)] for x in given.split(",") if x.strip()]
        cards = [len(states[p]) for p in ps]
        table = np.full((int(np.prod(cards or [1])), len(states[v])), np.nan)
        place = {c: i for i, c in enumerate(product(*[states[p] for p in ps]))}
        for labels, word, numbers in _ROW.findall(m[2]):
            values = [float(x) for x in numbers.replace(",", " ").split()]
            if word == "default":
                continue
            if word == "table":
                table = np.array(values).reshape(table.shape, order="F") if ps else np.array([values])
            else:
                table[place[tuple(_name(x) for x in labels.split(","))]] = values
        if np.isnan(table).any() or (table < 0).any() or (table.sum(1) <= 0).any():
            raise ValueError(f"{names[v]}: the table is not complete")
        parents[v], tables[v] = ps, table / table.sum(1, keepdims=True)
    if missing := [n for n, t in zip(names, tables, strict=True) if t is None]:
        raise ValueError(f"no table for {missing}")
    return Network(names, states, parents, tables)  # type: ignore[arg-type]


def read_bif(path: str) -> Network:
    """A BIF file, also gzipped. Such files are small and are read on the driver."""
    with gzip.open(path, "rt") if path.endswith(".gz") else open(path) as f:
        return parse_bif(f.read())
