"""Optimizers on the driver or inside one group: L-BFGS, OWL-QN, bounded L-BFGS and TRON.

An objective has value_gradient(b) and, for TRON, hessian_vector(b, d).
Tolerances are relative to value and gradient at zero coefficients; at least
one iteration runs.
"""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass, field

import numpy as np

#: Why an optimizer stopped.
MAX_ITERATIONS, NOT_IMPROVING, FUNCTION_VALUES, GRADIENT = "MAX_ITERATIONS", "OBJECTIVE_NOT_IMPROVING", "FUNCTION_VALUES_CONVERGED", "GRADIENT_CONVERGED"


@dataclass
class Result:
    coefficients: np.ndarray
    value: float
    gradient: np.ndarray
    reason: str
    iterations: int
    states: list = field(default_factory=list)
    #: Coefficients after every iteration, only of an objective with ``keep_path``.
    path: list = field(default_factory=list)


class _Progress:
    """Tolerances, the last 100 states and the reason to stop."""

    def __init__(self, objective, size: int, tolerance: float, max_iterations: int):
        value, gradient = objective.value_gradient(np.zeros(size))
        self.value_limit = abs(value) * tolerance
        self.gradient_limit = np.linalg.norm(gradient) * tolerance
        self.max_iterations, self.iteration = max_iterations, 0
        self.states: deque = deque(maxlen=100)
        self.path: list | None = [] if getattr(objective, "keep_path", False) else None
        self.began = time.time()

    def note(self, b: np.ndarray, value: float, gradient: np.ndarray) -> None:
        if self.path is not None:
            self.path.append(b.copy())
        self.states.append({"iteration": self.iteration, "value": value, "gradient_norm": float(np.linalg.norm(gradient)), "seconds": time.time() - self.began})

    def reason(self, before: float, value: float, gradient: np.ndarray, improved: bool) -> str | None:
        if self.iteration >= self.max_iterations:
            return MAX_ITERATIONS
        if not improved:
            return NOT_IMPROVING
        if abs(value - before) <= self.value_limit:
            return FUNCTION_VALUES
        if np.linalg.norm(gradient) <= self.gradient_limit:
            return GRADIENT
        return None


class Box:
    """Bounds of coefficients; missing ones are infinite."""

    def __init__(self, size: int, bounds: dict[int, tuple[float, float]] | None):
        self.low, self.high = np.full(size, -np.inf), np.full(size, np.inf)
        for i, (a, b) in (bounds or {}).items():
            if a > b:
                raise ValueError(f"empty bounds of coefficient {i}")
            self.low[i], self.high[i] = a, b
        self.free = not bounds

    def project(self, b: np.ndarray) -> np.ndarray:
        return b if self.free else np.clip(b, self.low, self.high)


class _Memory:
    """Two-loop recursion over the last m steps."""

    def __init__(self, m: int):
        self.pairs: deque = deque(maxlen=m)

    def push(self, s: np.ndarray, y: np.ndarray) -> None:
        sy = s @ y
        if sy > 1e-10 * np.linalg.norm(s) * np.linalg.norm(y):
            self.pairs.append((s, y, 1 / sy))

    def direction(self, g: np.ndarray) -> np.ndarray:
        q, alphas = -g.copy(), []
        for s, y, r in reversed(self.pairs):
            alphas.append(a := r * (s @ q))
            q -= a * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(self.pairs, reversed(alphas)):
            q += (a - r * (y @ q)) * s
        return q


def _wolfe(f, b, value, g, d, step, c1=1e-4, c2=0.9, tries=30):
    """Step that meets the strong Wolfe conditions, by bracketing and bisection with cubic steps."""
    slope = g @ d
    low, high, low_value = 0.0, np.inf, value
    best = None
    for _ in range(tries):
        v, gr = f(b + step * d)
        if not np.isfinite(v) or v > value + c1 * step * slope or v >= low_value and low > 0:
            high = step
        else:
            best = (step, v, gr)
            now = gr @ d
            if abs(now) <= -c2 * slope:
                return best
            if now >= 0:
                high = step
            else:
                low, low_value = step, v
        step = 2 * step if high == np.inf else (low + high) / 2
    return best


def lbfgs(objective, start: np.ndarray, tolerance=1e-7, max_iterations=100, memory=10, bounds=None) -> Result:
    """L-BFGS; with bounds every step is projected onto the box."""
    box = Box(len(start), bounds)
    if not box.free:
        return lbfgsb(objective, start, tolerance, max_iterations, memory, bounds)
    state, past = _Progress(objective, len(start), tolerance, max_iterations), _Memory(memory)
    b = start.copy()
    value, g = objective.value_gradient(b)
    state.note(b, value, g)
    while True:
        d = past.direction(g)
        if g @ d >= 0:
            past.pairs.clear()
            d = -g
        first = 1.0 if past.pairs else min(1.0, 1 / max(np.linalg.norm(g), 1e-300))
        found = _wolfe(objective.value_gradient, b, value, g, d, first)
        state.iteration += 1
        before = value
        if found:
            step, value, new = found
            past.push(step * d, new - g)
            b, g = b + step * d, new
        state.note(b, value, g)
        if reason := state.reason(before, value, g, bool(found)):
            return Result(b, value, g, reason, state.iteration, list(state.states), state.path or [])


def owlqn(objective, start: np.ndarray, l1: float, tolerance=1e-7, max_iterations=100, memory=10, bounds=None) -> Result:
    """Orthant-wise L-BFGS: value plus l1 times the sum of absolute coefficients, every one of them."""

    def pseudo(b, g):
        free = np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0.0))
        return np.where(b > 0, g + l1, np.where(b < 0, g - l1, free))

    class Full:
        keep_path = getattr(objective, "keep_path", False)

        @staticmethod
        def value_gradient(b):
            v, g = objective.value_gradient(b)
            return v + l1 * np.abs(b).sum(), pseudo(b, g)

    box = Box(len(start), bounds)
    state, past = _Progress(Full, len(start), tolerance, max_iterations), _Memory(memory)
    b = box.project(start.copy())
    smooth, g = objective.value_gradient(b)
    value = smooth + l1 * np.abs(b).sum()
    state.note(b, value, pseudo(b, g))
    while True:
        pg = pseudo(b, g)
        d = past.direction(pg)
        d = np.where(d * pg < 0, d, 0.0)
        orthant = np.where(b != 0, np.sign(b), -np.sign(pg))
        step = 1.0 if past.pairs else min(1.0, 1 / max(np.linalg.norm(pg), 1e-300))
        improved, before = False, value
        for _ in range(40):
            new = b + step * d
            new = box.project(np.where(new * orthant > 0, new, 0.0))
            s, ng = objective.value_gradient(new)
            v = s + l1 * np.abs(new).sum()
            if np.isfinite(v) and v <= value + 1e-4 * (pg @ (new - b)) and v <= value:
                improved = not np.array_equal(new, b)
                break
            step /= 2
        state.iteration += 1
        if improved:
            past.push(new - b, ng - g)
            b, g, value = new, ng, v
        state.note(b, value, pseudo(b, g))
        if reason := state.reason(before, value, pseudo(b, g), improved):
            return Result(b, value, pseudo(b, g), reason, state.iteration, list(state.states), state.path or [])


def lbfgsb(objective, start: np.ndarray, tolerance=1e-7, max_iterations=100, memory=10, bounds=None) -> Result:
    """Projected L-BFGS: coefficients held at a bound by the gradient leave the quasi-Newton step."""
    box = Box(len(start), bounds)
    state, past = _Progress(objective, len(start), tolerance, max_iterations), _Memory(memory)
    b = box.project(start.copy())
    value, g = objective.value_gradient(b)
    state.note(b, value, g)
    while True:
        held = ((b <= box.low) & (g > 0)) | ((b >= box.high) & (g < 0))
        pg = np.where(held, 0.0, g)
        d = np.where(held, 0.0, past.direction(pg))
        if pg @ d >= 0:
            past.pairs.clear()
            d = -pg
        step = 1.0 if past.pairs else min(1.0, 1 / max(np.linalg.norm(pg), 1e-300))
        improved, before = False, value
        for _ in range(40):
            new = box.project(b + step * d)
            v, ng = objective.value_gradient(new)
            if np.isfinite(v) and v <= value + 1e-4 * (pg @ (new - b)):
                improved = not np.array_equal(new, b)
                break
            step /= 2
        state.iteration += 1
        if improved:
            past.push(new - b, ng - g)
            b, g, value = new, ng, v
        held = ((b <= box.low) & (g > 0)) | ((b >= box.high) & (g < 0))
        left = np.where(held, 0.0, g)
        state.note(b, value, left)
        if reason := state.reason(before, value, left, improved):
            return Result(b, value, left, reason, state.iteration, list(state.states), state.path or [])


def tron(objective, start: np.ndarray, tolerance=1e-5, max_iterations=15, failures=5, bounds=None) -> Result:
    """Trust-region Newton: steps by truncated conjugate gradients, at most 20 products each."""
    box = Box(len(start), bounds)
    state = _Progress(objective, len(start), tolerance, max_iterations)
    b = box.project(start.copy())
    value, g = objective.value_gradient(b)
    radius, failed = np.linalg.norm(g), 0
    state.note(b, value, g)
    while True:
        step, residual = _steihaug(objective, b, g, radius)
        state.iteration += 1
        new = box.project(b + step)
        v, ng = objective.value_gradient(new)
        slope = g @ step
        predicted = -0.5 * (slope - step @ residual)
        actual, size = value - v, np.linalg.norm(step)
        if state.iteration == 1:
            radius = min(radius, size)
        # the step length at which a parabola through value, slope and new value is least
        scale = 4.0 if -actual - slope <= 0 else max(0.25, -0.5 * (slope / (-actual - slope)))
        if actual < 1e-4 * predicted:
            radius = min(max(scale, 0.25) * size, 0.5 * radius)
        elif actual < 0.25 * predicted:
            radius = max(0.25 * radius, min(scale * size, 0.5 * radius))
        elif actual < 0.75 * predicted:
            radius = max(0.25 * radius, min(scale * size, 4 * radius))
        else:
            radius = max(radius, min(scale * size, 4 * radius))
        improved, before = bool(actual > 1e-4 * predicted and np.isfinite(v)), value
        if improved:
            b, value, g, failed = new, v, ng, 0
        else:
            failed += 1
        state.note(b, value, g)
        if not improved and failed < failures and state.iteration < max_iterations:
            continue
        if reason := state.reason(before, value, g, improved):
            return Result(b, value, g, reason, state.iteration, list(state.states), state.path or [])


def _steihaug(objective, b, g, radius, most=20, share=0.1):
    """Step of the trust-region problem and its residual -g - H step."""
    step, r = np.zeros_like(g), -g.copy()
    d, limit, rr = r.copy(), share * np.linalg.norm(g), r @ r
    for _ in range(most):
        if np.sqrt(rr) <= limit:
            break
        hd = objective.hessian_vector(b, d)
        curve = d @ hd
        alpha = rr / curve if curve > 0 else np.inf
        if curve <= 0 or np.linalg.norm(step + alpha * d) > radius:
            sd, dd = step @ d, d @ d
            root = np.sqrt(sd * sd + dd * max(radius * radius - step @ step, 0))
            alpha = (root - sd) / dd
            return step + alpha * d, r - alpha * hd
        step, r = step + alpha * d, r - alpha * hd
        rr, old = r @ r, rr
        d = r + rr / old * d
    return step, r


def minimise(objective, start, optimizer="LBFGS", l1=0.0, tolerance=None, max_iterations=None, bounds=None) -> Result:
    """The optimizer a configuration names: LBFGS turns into OWL-QN for an L1 part; TRON allows none."""
    options = {k: v for k, v in (("tolerance", tolerance), ("max_iterations", max_iterations)) if v is not None}
    if optimizer == "LBFGS":
        return owlqn(objective, start, l1, bounds=bounds, **options) if l1 else lbfgs(objective, start, bounds=bounds, **options)
    if optimizer == "LBFGSB":
        return lbfgsb(objective, start, bounds=bounds, **options)
    if optimizer == "TRON":
        if l1:
            raise ValueError("TRON can't minimise an L1 penalty")
        return tron(objective, start, bounds=bounds, **options)
    raise ValueError(f"no optimizer {optimizer}")
