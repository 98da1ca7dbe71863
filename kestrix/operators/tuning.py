"""Hyperparameter search on the driver: Sobol points, Gaussian processes and expected improvement."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np

#: Range of a regularization weight unless given.
WEIGHT_RANGE = (1e-4, 1e4)
# Primitive polynomials (degree, inner bits) and initial numbers of Sobol's sequence, dimensions 2 to 12.
_SOBOL = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)), (5, 13, (1, 1, 1, 3, 11)),
)
_BITS = 30


def sobol(n: int, dimensions: int, skip: int = 0) -> np.ndarray:
    """Points skip .. skip + n - 1 of Sobol's sequence in [0, 1); up to 12 dimensions."""
    if not 1 <= dimensions <= len(_SOBOL) + 1:
        raise ValueError(f"1 to {len(_SOBOL) + 1} dimensions")
    directions = np.zeros((dimensions, _BITS), np.int64)
    directions[0] = [1 << (_BITS - 1 - i) for i in range(_BITS)]
    for d, (degree, inner, first) in enumerate(_SOBOL[: dimensions - 1], 1):
        m = list(first)
        for i in range(degree, _BITS):
            v = m[i - degree] ^ (m[i - degree] << degree)
            for k in range(1, degree):
                if inner >> (degree - 1 - k) & 1:
                    v ^= m[i - k] << k
            m.append(v)
        directions[d] = [m[i] << (_BITS - 1 - i) for i in range(_BITS)]
    out = np.zeros((n, dimensions), np.int64)
    for row, index in enumerate(range(skip, skip + n)):
        gray, bit = index ^ index >> 1, 0
        while gray:
            if gray & 1:
                out[row] ^= directions[:, bit]
            gray, bit = gray >> 1, bit + 1
    return out / float(1 << _BITS)


def discretize(x: np.ndarray, levels: dict[int, int]) -> np.ndarray:
    """floor(x n) / n for each discrete dimension of n levels."""
    x = x.copy()
    for i, n in levels.items():
        x[..., i] = np.floor(x[..., i] * n) / n
    return x


@dataclass(frozen=True)
class Kernel:
    """Stationary kernel with amplitude, noise and a length scale per dimension (or one)."""

    amplitude: float = 1.0
    noise: float = 1e-4
    scales: tuple[float, ...] = (1.0,)
    kind: str = "matern52"

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.asarray(self.scales)
        d2 = np.maximum((((a / s)[:, None, :] - (b / s)[None, :, :]) ** 2).sum(axis=2), 0)
        if self.kind == "rbf":
            return self.amplitude * np.exp(-0.5 * d2)
        r = np.sqrt(5 * d2)
        return self.amplitude * (1 + r + r * r / 3) * np.exp(-r)

    def with_parameters(self, theta: np.ndarray) -> Kernel:
        return Kernel(float(theta[0]), float(theta[1]), tuple(map(float, theta[2:])), self.kind)

    def log_likelihood(self, x: np.ndarray, y: np.ndarray) -> float:
        """Log marginal likelihood with priors; minus infinity outside the allowed parameters."""
        scales = np.asarray(self.scales)
        if self.amplitude < 0 or self.noise < 0 or (scales <= 0).any() or (scales > 2).any():
            return -math.inf
        k = self(x, x) + (self.noise + 1e-10) * np.eye(len(x))
        try:
            low = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return -math.inf
        a = np.linalg.solve(low, y)
        out = -0.5 * a @ a - np.log(np.diag(low)).sum() - 0.5 * len(x) * math.log(2 * math.pi)
        out += math.log(math.log(1 + (0.1 / self.noise) ** 2)) if self.noise > 0 else -math.inf  # horseshoe on the noise
        return out - 0.5 * math.log(max(self.amplitude, 1e-300)) ** 2 if self.amplitude > 0 else -math.inf


def slice_sample(log_density, x: np.ndarray, rng: np.random.Generator, step: float = 1.0, most: int = 1000) -> np.ndarray:
    """One draw along a random direction: step out from the slice, then shrink."""
    direction = rng.normal(size=len(x))
    direction /= np.linalg.norm(direction)
    level = log_density(x) + math.log(1 - rng.random())
    low = -step * rng.random()
    high = low + step
    for _ in range(most):
        if log_density(x + low * direction) <= level:
            break
        low -= step
    for _ in range(most):
        if log_density(x + high * direction) <= level:
            break
        high += step
    while True:
        at = rng.uniform(low, high)
        if log_density(x + at * direction) > level:
            return x + at * direction
        low, high = (at, high) if at < 0 else (low, at)
        if high - low < 1e-12:
            return x


class GaussianProcess:
    """Posterior averaged over kernels whose parameters are drawn by slice sampling."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: str = "matern52", noisy: bool = True, burn_in: int = 100, samples: int = 10, seed: int = 0):
        self.x, self.mean = np.asarray(x, float), float(np.mean(y))
        self.y = np.asarray(y, float) - self.mean
        rng = np.random.default_rng(seed)
        spread = max(float(np.var(self.y)), 1e-6)
        theta = np.array([spread, 1e-4 if not noisy else 0.01 * spread, *np.ones(self.x.shape[1])])
        kernel = Kernel(kind=kind)

        def of(t):
            return kernel.with_parameters(t if noisy else np.array([t[0], 1e-4, *t[2:]]))

        def density(t):
            return of(t).log_likelihood(self.x, self.y)

        self.kernels = []
        for i in range(burn_in + samples):
            theta = slice_sample(density, theta, rng)
            if i >= burn_in:
                self.kernels.append(of(theta))

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance, averaged over the kernels."""
        each = [self._one(k, at) for k in self.kernels]
        return np.mean([m for m, _ in each], axis=0) + self.mean, np.mean([v for _, v in each], axis=0)

    def _one(self, k: Kernel, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.linalg.cholesky(k(self.x, self.x) + (k.noise + 1e-10) * np.eye(len(self.x)))
        cross = np.linalg.solve(low, k(self.x, at))
        return cross.T @ np.linalg.solve(low, self.y), np.maximum(np.diag(k(at, at)) - (cross**2).sum(axis=0), 0)

    def average(self, at: np.ndarray, transform) -> np.ndarray:
        """Mean of transform(mean, variance) over the kernels."""
        return np.mean([transform(m + self.mean, v) for m, v in (self._one(k, at) for k in self.kernels)], axis=0)


def expected_improvement(best: float):
    """Acquisition to be maximised when values are minimised."""

    def of(mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
        sd = np.sqrt(np.maximum(variance, 1e-18))
        z = (best - mean) / sd
        density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        return sd * (density + z * 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2))))

    return of


def confidence_bound(factor: float = 2.0):
    """Lower bound of values, to be minimised."""
    return lambda mean, variance: mean - factor * np.sqrt(variance)


class RandomSearch:
    """Minimises a function on the unit cube over Sobol points."""

    def __init__(self, dimensions: int, function, discrete: dict[int, int] | None = None, seed: int = 0):
        self.dimensions, self.function, self.discrete = dimensions, function, discrete or {}
        self.at = int(np.random.default_rng(seed).integers(0, 1 << 16))
        self.seed = seed

    def _draw(self, n: int) -> np.ndarray:
        points = sobol(n, self.dimensions, self.at)
        self.at += n
        return discretize(points, self.discrete)

    def next(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self._draw(1)[0]

    def find(self, n: int, observations: list | None = None, priors: list | None = None) -> list[tuple[np.ndarray, float, object]]:
        """n new (point, value, result); observations are earlier ones, priors (point, value) of earlier searches."""
        out = []
        seen = [(np.asarray(p), v) for p, v, *_ in (observations or [])]
        for _ in range(n):
            known = [*seen, *((np.asarray(p), v) for p, v in priors or [])]
            x = self.next(np.array([p for p, _ in known]).reshape(len(known), self.dimensions), np.array([v for _, v in known]))
            value, result = self.function(x)
            seen.append((x, value))
            out.append((x, value, result))
        return out


class BayesianSearch(RandomSearch):
    """Random until there are more observations than dimensions, then the best of a pool by expected improvement."""

    def __init__(self, *args, kind: str = "matern52", pool: int = 250, noisy: bool = True, **kwargs):
        super().__init__(*args, **kwargs)
        self.kind, self.pool, self.noisy = kind, pool, noisy

    def next(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if len(y) <= self.dimensions:
            return self._draw(1)[0]
        gp = GaussianProcess(x, y, self.kind, self.noisy, seed=self.seed)
        points = self._draw(self.pool)
        return points[int(gp.average(points, expected_improvement(float(y.min()))).argmax())]


def tuner(name: str):
    """DUMMY finds nothing; BUILTIN searches (dimensions, function, mode, n, ...)."""
    if name == "DUMMY":
        return lambda *a, **k: []
    if name == "BUILTIN":
        return search
    raise ValueError(f"no tuner {name}")


def search(n: int, dimensions: int, mode: str, function, observations=None, priors=None, discrete=None, seed: int = 0) -> list:
    if mode == "NONE":
        return []
    kind = {"RANDOM": RandomSearch, "BAYESIAN": BayesianSearch}[mode]
    return kind(dimensions, function, discrete, seed=seed).find(n, observations, priors)


@dataclass(frozen=True)
class Variable:
    """A hyperparameter: its range, transform (LOG, SQRT or none) and whether it is discrete."""

    name: str
    low: float
    high: float
    transform: str | None = None
    discrete: bool = False

    def forward(self, v: float) -> float:
        return math.log10(v) if self.transform == "LOG" else math.sqrt(v) if self.transform == "SQRT" else v

    def backward(self, v: float) -> float:
        return 10**v if self.transform == "LOG" else v * v if self.transform == "SQRT" else v

    def scale(self, v: float) -> float:
        """Into [0, 1]; a discrete range counts its last value."""
        a, b = self.forward(self.low), self.forward(self.high) + (1 if self.discrete else 0)
        return (self.forward(v) - a) / (b - a)

    def unscale(self, x: float) -> float:
        a, b = self.forward(self.low), self.forward(self.high) + (1 if self.discrete else 0)
        return self.backward(a + x * (b - a))


@dataclass(frozen=True)
class SearchConfig:
    mode: str
    variables: tuple[Variable, ...] = field(default=())

    @classmethod
    def from_json(cls, text: str) -> SearchConfig:
        """{"tuning_mode": .., "variables": {name: {"type": .., "min": .., "max": .., "transform": ..}}}"""
        d = json.loads(text)
        out = []
        for name, v in d["variables"].items():
            kind = v.get("type", "FLOAT").upper()
            if v.get("transform") not in (None, "LOG", "SQRT"):
                raise ValueError(f"no transform {v['transform']}")
            out.append(Variable(name, float(v["min"]), float(v["max"]), v.get("transform"), kind in ("INT", "INTEGER", "DISCRETE")))
        return cls(d.get("tuning_mode", "NONE").upper(), tuple(out))

    def priors(self, text: str, defaults: dict[str, float], metric: str = "evaluationValue") -> list[tuple[np.ndarray, float]]:
        """Records of earlier searches as scaled points and values; absent variables take defaults."""
        return [(np.array([v.scale(float(r[v.name] if v.name in r else defaults[v.name])) for v in self.variables]), float(r[metric])) for r in json.loads(text)["records"]]


def shrink(config: SearchConfig, priors: list[tuple[np.ndarray, float]], radius: float, pool: int = 1000, seed: int = 0) -> dict[str, tuple[float, float]]:
    """Narrower ranges around the candidate of largest predicted mean, radius in scaled units, clipped."""
    n = len(config.variables)
    gp = GaussianProcess(np.array([p for p, _ in priors]), np.array([v for _, v in priors]), seed=seed)
    points = sobol(pool, n, int(np.random.default_rng(seed).integers(0, 1 << 16)))
    best = points[int(gp.predict(points)[0].argmax())]
    lo, hi = np.clip(best - radius, 0, 1), np.clip(best + radius, 0, 1)
    clip = lambda v, x: min(max(v.unscale(x), v.low), v.high)
    return {v.name: (clip(v, a), clip(v, b)) for v, a, b in zip(config.variables, lo, hi)}


class EstimatorFunction:
    """An estimator as a function of the unit cube: ln(weight) of each regularized coordinate, then alpha, by name."""

    def __init__(self, estimator, base: dict, train, validation, larger_is_better: bool):
        self.estimator, self.base, self.train, self.validation, self.flip = estimator, base, train, validation, larger_is_better
        self.slots = []
        for name in sorted(base):
            c = base[name]
            if c.regularization == "NONE":
                continue
            a, b = c.weight_range or WEIGHT_RANGE
            self.slots.append((name, "weight", math.log(a), math.log(b)))
            if c.regularization == "ELASTIC_NET":
                a, b = c.alpha_range or (0.0, 1.0)
                self.slots.append((name, "alpha", max(a, 1e-9), b))

    @property
    def dimensions(self) -> int:
        return len(self.slots)

    def configuration(self, x: np.ndarray) -> dict:
        from dataclasses import replace

        out = dict(self.base)
        for (name, what, a, b), v in zip(self.slots, x):
            value = a + float(v) * (b - a)
            value = math.exp(value) if what == "weight" else value
            out[name] = replace(out[name], **{what: value}, **({"weights": (value,)} if what == "weight" else {}))
        return out

    def vector(self, configuration: dict) -> np.ndarray:
        now = [math.log(configuration[n].weight) if w == "weight" else configuration[n].alpha for n, w, *_ in self.slots]
        return np.array([(v - a) / (b - a) for v, (_, _, a, b) in zip(now, self.slots)])

    def __call__(self, x: np.ndarray):
        config = self.configuration(x)
        result = self.estimator.fit(self.train, self.validation, [config])[0]
        value = next(iter(result[1].metrics.values()))
        return (-value if self.flip else value), result
