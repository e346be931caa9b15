"""Settings of a study as one value: from options by name, from a profile, and to and from JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

from arbora.operators.profile import suggest

from .search import Config

#: Settings by the names that option files give them (fixed values).
OPTIONS = {
    "NORMALIZE": "normalise", "LOG2": "log2", "MIN_MEAN_LOG": "min_mean", "MIN_DETECT_FRAC": "min_detected", "VAR_QUANTILE": "variance_quantile", "TOP_VAR_GENES": "top_variance",
    "N_BINS": "bins", "DISC_METHOD": "method", "PSEUDOCOUNT": "pseudocount", "DETECT_THRESHOLD": "detect", "SCORE": "score", "ESS": "ess", "MAX_PARENTS": "max_parents",
    "ITERS": "iterations", "TABU": "tabu", "TOPK": "top_k", "ALPHA": "alpha", "BOOTSTRAP": "replicates", "SEEDS": "seeds", "ITERS_BS": "iterations_bootstrap",
    "THRESHOLD_PROB": "least_prob", "THRESHOLD_COUNT": "least_count",
}


@dataclass(frozen=True)
class Settings:
    """Preparation, search and bootstrap of a study. 0 of top_variance or top_k: all; a variance_quantile goes before top_variance."""

    normalise: str = "none"
    log2: bool = True
    pseudocount: float = 1.0
    detect: float = 0.0
    min_mean: float = 0.0
    min_detected: float = 0.0
    variance_quantile: float | None = None
    top_variance: int = 500
    bins: int = 3
    method: str = "quantile"
    score: str = "bdeu"
    ess: float = 10.0
    max_parents: int = 2
    iterations: int = 5000
    tabu: int = 30
    top_k: int = 20
    alpha: float = 1.0
    replicates: int = 10
    seeds: int = 5
    iterations_bootstrap: int = 1500
    least_prob: float = 0.3
    least_count: int = 2

    def __post_init__(self) -> None:
        if self.normalise not in ("none", "cpm", "tpm") or self.method not in ("quantile", "uniform"):
            raise ValueError("normalise is none, cpm or tpm, and method quantile or uniform")
        if self.bins < 2 or min(self.replicates, self.seeds) < 1 or not 0 <= self.min_detected <= 1:
            raise ValueError("two bins at least, one resample and seed at least, and a share of detected values from 0 to 1")
        self.search()

    def with_options(self, options: Mapping[str, str]) -> Settings:
        """These settings with options by name (those of OPTIONS or of the fields); empty ones are passed over, unknown ones raise."""
        types, out = {f.name: str(f.type) for f in fields(self)}, {}
        for name, text in options.items():
            own = OPTIONS.get(name, name)
            if own not in types:
                raise ValueError(f"no option {name}")
            if text == "":
                continue
            kind = types[own]
            out[own] = text not in ("0", "false", "False") if kind == "bool" else int(text) if kind == "int" else text if kind == "str" else float(text)
        return replace(self, **out)

    @classmethod
    def suggested(cls, rows: int, variables: int, kind: str = "log_transformed", high_variance: int | None = None, cpus: int = 8) -> Settings:
        """What suits a matrix of this size and kind of values: counts are scaled and taken logarithms of, logarithms and discrete states are left."""
        s = suggest(rows, variables, high_variance, cpus)
        counts = kind == "raw_counts"
        return cls(
            normalise="cpm" if counts else "none", log2=counts or kind == "linear_normalized", bins=s["n_bins"], max_parents=s["max_parents"], top_variance=s["top_var"],
            iterations=s["iters"], iterations_bootstrap=s["iters_bootstrap"], seeds=s["seeds"], replicates=s["bootstrap"],
        )

    def search(self, resample: bool = False) -> Config:
        return Config(score=self.score, ess=self.ess, max_iter=self.iterations_bootstrap if resample else self.iterations, tabu_tenure=self.tabu, max_parents=self.max_parents, top_k=self.top_k)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        return cls(**json.loads(text))
