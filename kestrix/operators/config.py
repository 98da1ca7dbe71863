"""Configurations of coordinates and the small language they are written in on a command line."""

from __future__ import annotations

import itertools
import json
import math
import re
from dataclasses import dataclass, field, replace

TASKS = ("LOGISTIC_REGRESSION", "LINEAR_REGRESSION", "POISSON_REGRESSION", "SMOOTHED_HINGE_LOSS_LINEAR_SVM")
REGULARIZATION = ("NONE", "L1", "L2", "ELASTIC_NET")
OPTIMIZERS = ("LBFGS", "TRON", "LBFGSB")


@dataclass(frozen=True)
class Shard:
    """A feature shard: bags that are merged into one vector."""

    name: str
    bags: tuple[str, ...]
    intercept: bool = True

    @classmethod
    def parse(cls, text: str) -> Shard:
        """``name=..,feature.bags=a|b,intercept=true``."""
        d = _pairs(text)
        _only(d, {"name", "feature.bags", "intercept"})
        return cls(d["name"], tuple(d["feature.bags"].split("|")), d.get("intercept", "true").lower() == "true")

    def __str__(self) -> str:
        return f"name={self.name},feature.bags={'|'.join(self.bags)},intercept={str(self.intercept).lower()}"


@dataclass(frozen=True)
class Coordinate:
    """A fixed effect, or with entity a random effect."""

    name: str
    shard: str = "features"
    entity: str | None = None
    optimizer: str = "LBFGS"
    max_iterations: int | None = None
    tolerance: float | None = None
    regularization: str = "NONE"
    alpha: float | None = None
    weights: tuple[float, ...] = ()
    weight_range: tuple[float, float] | None = None
    alpha_range: tuple[float, float] | None = None
    down_sampling_rate: float = 1.0
    cap: int | None = None
    bound: int | None = None
    features_ratio: float | None = None
    min_partitions: int = 1
    incremental_weight: float | None = None
    bounds: dict[int, tuple[float, float]] | None = field(default=None, hash=False)
    weight: float = 0.0

    def __post_init__(self):
        def need(ok, said):
            if not ok:
                raise ValueError(f"coordinate {self.name}: {said}")

        need(self.optimizer in OPTIMIZERS, f"no optimizer {self.optimizer}")
        need(self.regularization in REGULARIZATION, f"no regularization {self.regularization}")
        need(not (self.optimizer == "TRON" and self.l1_share > 0), "TRON can't minimise an L1 penalty")
        need(self.alpha is None or self.regularization == "ELASTIC_NET", "alpha belongs to an elastic net")
        need(self.alpha is None or 0 < self.alpha <= 1, "alpha must lie in (0, 1]")
        need(all(w >= 0 for w in (*self.weights, self.weight)), "regularization weights must not be negative")
        need(0 < self.down_sampling_rate <= 1, "the down-sampling rate must lie in (0, 1]")
        need(self.cap is None or self.cap > 0, "the upper bound must be positive")
        need(self.bound is None or self.bound > 0, "the lower bound must be positive")
        need(self.cap is None or self.bound is None or self.bound <= self.cap, "the lower bound exceeds the upper")
        need(self.features_ratio is None or self.features_ratio > 0, "the features ratio must be positive")
        need(self.min_partitions > 0, "partitions must be positive")
        need(self.incremental_weight is None or self.incremental_weight >= 0, "the incremental weight must not be negative")
        for r in (self.weight_range, self.alpha_range):
            need(r is None or r[0] <= r[1], "a range starts after its end")

    @property
    def l1_share(self) -> float:
        return {"L1": 1.0, "ELASTIC_NET": self.alpha if self.alpha is not None else 1.0}.get(self.regularization, 0.0)

    @property
    def l1(self) -> float:
        return 0.0 if self.regularization == "NONE" else self.weight * self.l1_share

    @property
    def l2(self) -> float:
        return 0.0 if self.regularization == "NONE" else self.weight * (1 - self.l1_share)

    def expanded(self) -> list[Coordinate]:
        """One for each regularization weight, largest first; without regularization one of weight 0."""
        if self.regularization == "NONE":
            return [replace(self, weight=0.0)]
        return [replace(self, weight=w) for w in sorted(self.weights or (self.weight,), reverse=True)]

    @classmethod
    def parse(cls, text: str) -> Coordinate:
        d = _pairs(text)
        _only(d, {"name", *_KEYS})
        span = lambda x: tuple(float(v) for v in x.split("-", 1)) if "e-" not in x else tuple(map(float, re.fullmatch(r"(.+?)(?<!e)-(.+)", x).groups()))
        kinds = {"min_partitions": int, "cap": int, "bound": int, "max_iterations": int, "features_ratio": float, "tolerance": float, "alpha": float, "incremental_weight": float, "down_sampling_rate": float}
        out = {"name": d.pop("name")}
        for k, v in d.items():
            f = _KEYS[k]
            out[f] = tuple(float(x) for x in v.split("|")) if f == "weights" else span(v) if f in ("weight_range", "alpha_range") else kinds.get(f, str)(v)
        return cls(**out)

    def __str__(self) -> str:
        out = [f"name={self.name}"]
        for k, f in _KEYS.items():
            v = getattr(self, f)
            if v is not None and v != () and not (f == "min_partitions" and v == 1):
                out.append(f"{k}={'|'.join(f'{x:g}' for x in v)}" if f == "weights" else f"{k}={v[0]:g}-{v[1]:g}" if f.endswith("_range") else f"{k}={v}")
        return ",".join(out)


#: Keys of the language and the fields they set.
_KEYS = {
    "random.effect.type": "entity", "feature.shard": "shard", "min.partitions": "min_partitions", "active.data.lower.bound": "bound", "active.data.upper.bound": "cap",
    "features.to.samples.ratio": "features_ratio", "optimizer": "optimizer", "max.iter": "max_iterations", "tolerance": "tolerance", "regularization": "regularization",
    "reg.alpha": "alpha", "reg.alpha.range": "alpha_range", "reg.weights": "weights", "reg.weight.range": "weight_range", "incremental.weight": "incremental_weight", "down.sampling.rate": "down_sampling_rate",
}


def _pairs(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for part in text.split(","):
        k, mark, v = part.strip().partition("=")
        if not mark or k in out:
            raise ValueError(f"can't read {part!r} in {text!r}")
        out[k] = v
    if "name" not in out:
        raise ValueError(f"no name in {text!r}")
    return out


def _only(d: dict[str, str], known: set[str]) -> None:
    if bad := set(d) - known:
        raise ValueError(f"unknown keys: {sorted(bad)}")


def grid(coordinates: list[Coordinate]) -> list[dict[str, Coordinate]]:
    """Every combination of the coordinates' weights."""
    return [{c.name: c for c in combo} for combo in itertools.product(*(c.expanded() for c in coordinates))]


#: Stands for any name or any term in box constraints.
WILDCARD = "*"


def box_constraints(text: str, index: list[tuple[str, int]], intercept: int | None = None) -> dict[int, tuple[float, float]]:
    """Bounds by feature index from JSON: [{"name": .., "term": .., "lowerBound": .., "upperBound": ..}].

    index lists (key, idx).  A term, or name and term, may be ``*``: it bounds
    every matching feature but the intercept.  A bound may be left out, but not
    both.  A feature bounded twice, and a wildcard for all beside any other
    entry, are errors; features that the index lacks are passed over.
    """
    from kestrix.functions.features import SEPARATOR

    names = [(*k.partition(SEPARATOR)[::2], i) for k, i in index]
    out: dict[int, tuple[float, float]] = {}
    entries = json.loads(text)
    for e in entries:
        if "name" not in e or "term" not in e:
            raise ValueError(f"a constraint needs a name and a term: {e}")
        low, high = float(e.get("lowerBound", -math.inf)), float(e.get("upperBound", math.inf))
        if low == -math.inf and high == math.inf:
            raise ValueError(f"a constraint needs a bound: {e}")
        if low > high:
            raise ValueError(f"the lower bound exceeds the upper: {e}")
        if e["name"] == WILDCARD and (e["term"] != WILDCARD or len(entries) > 1):
            raise ValueError("a wildcard name needs a wildcard term and stands alone")
        for name, term, i in names:
            wild = WILDCARD in (e["name"], e["term"])
            if e["name"] in (WILDCARD, name) and e["term"] in (WILDCARD, term) and not (wild and i == intercept):
                if i in out:
                    raise ValueError(f"two constraints for {name!r}, {term!r}")
                out[i] = (low, high)
    return out
