"""L-BFGS and TRON of many small problems side by side: the steps of ``optim``, problem by problem, as arrays.

``of`` of an objective has the problem of each coefficient and ``n`` their
number.  value_gradient(b, who) and hessian_vector(b, d, who) need only be
right for the problems of who.
"""

from __future__ import annotations

import numpy as np

from .optim import FUNCTION_VALUES, GRADIENT, MAX_ITERATIONS, NOT_IMPROVING


class _Progress:
    def __init__(self, objective, tolerance: float, max_iterations: int):
        self.of, self.n = objective.of, objective.n
        self.going = np.ones(self.n, bool)
        value, gradient = objective.value_gradient(np.zeros(len(self.of)), self.going)
        self.value_limit, self.gradient_limit = np.abs(value) * tolerance, self.norm(gradient) * tolerance
        self.max_iterations, self.iterations, self.reasons = max_iterations, np.zeros(self.n, int), np.full(self.n, None, object)

    def dot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, a * b, self.n)

    def norm(self, a: np.ndarray) -> np.ndarray:
        return np.sqrt(self.dot(a, a))

    def stop(self, who: np.ndarray, before: np.ndarray, value: np.ndarray, gradient: np.ndarray, improved: np.ndarray) -> None:
        for reason, holds in (
            (MAX_ITERATIONS, self.iterations >= self.max_iterations), (NOT_IMPROVING, ~improved),
            (FUNCTION_VALUES, np.abs(value - before) <= self.value_limit), (GRADIENT, self.norm(gradient) <= self.gradient_limit),
        ):
            now = who & self.going & holds
            self.reasons[now] = reason
            self.going &= ~now


def _wolfe(objective, dot, b, value, g, d, step, who, c1=1e-4, c2=0.9, tries=30):
    of, slope = objective.of, dot(g, d)
    low, high, low_value = np.zeros(len(step)), np.full(len(step), np.inf), value.copy()
    left, found, best, best_value, best_g = who.copy(), np.zeros(len(step), bool), step, value, g
    for _ in range(tries):
        v, gr = objective.value_gradient(b + step[of] * d, left)
        far = ~np.isfinite(v) | (v > value + c1 * step * slope) | ((v >= low_value) & (low > 0))
        take, now = left & ~far, dot(gr, d)
        best, best_value, best_g, found = np.where(take, step, best), np.where(take, v, best_value), np.where(take[of], gr, best_g), found | take
        left = left & ~(take & (np.abs(now) <= -c2 * slope))
        if not left.any():
            break
        up = take & (now < 0)
        high = np.where(left & ~up, step, high)
        low, low_value = np.where(left & up, step, low), np.where(left & up, v, low_value)
        step = np.where(left, np.where(np.isinf(high), 2 * step, (low + high) / 2), step)
    return found, best, best_value, best_g


def lbfgs(objective, start: np.ndarray, tolerance=1e-7, max_iterations=100, memory=10) -> tuple:
    """Coefficients, and the reasons to stop and iterations by problem."""
    p, of, n = _Progress(objective, tolerance, max_iterations), objective.of, objective.n
    b = start.copy()
    value, g = objective.value_gradient(b, p.going)
    s_of, y_of, inverse, count = np.zeros((memory, len(of))), np.zeros((memory, len(of))), np.zeros((memory, n)), np.zeros(n, int)
    while p.going.any():
        d, alphas, places = -g, [], range(memory - count.max(initial=0), memory)
        for j in reversed(places):
            alphas.append(a := inverse[j] * p.dot(s_of[j], d))
            d = d - a[of] * y_of[j]
        if len(places):
            yy = p.dot(y_of[-1], y_of[-1]) * inverse[-1]
            d = d * np.where(count > 0, 1 / np.where(count > 0, yy, 1.0), 1.0)[of]
        for j, a in zip(places, reversed(alphas)):
            d = d + (a - inverse[j] * p.dot(y_of[j], d))[of] * s_of[j]
        if (up := (p.dot(g, d) >= 0) & p.going).any():
            count[up], inverse[:, up] = 0, 0
            s_of[:, up[of]] = y_of[:, up[of]] = 0
            d = np.where(up[of], -g, d)
        first = np.where(count > 0, 1.0, np.minimum(1.0, 1 / np.maximum(p.norm(g), 1e-300)))
        found, step, new_value, new_g = _wolfe(objective, p.dot, b, value, g, d, first, p.going)
        p.iterations[p.going] += 1
        s, y = step[of] * d, new_g - g
        sy = p.dot(s, y)
        kept = found & (sy > 1e-10 * p.norm(s) * p.norm(y))
        if kept.any():
            k = kept[of]
            for m, last in ((s_of, s[k]), (y_of, y[k])):
                m[:-1, k] = m[1:, k]
                m[-1, k] = last
            inverse[:-1, kept] = inverse[1:, kept]
            inverse[-1, kept] = 1 / sy[kept]
            count[kept] = np.minimum(count[kept] + 1, memory)
        before, moved = value, found[of]
        value, b, g = np.where(found, new_value, value), np.where(moved, b + s, b), np.where(moved, new_g, g)
        p.stop(p.going.copy(), before, value, g, found)
    return b, p.reasons, p.iterations


def tron(objective, start: np.ndarray, tolerance=1e-5, max_iterations=15, failures=5) -> tuple:
    """Coefficients, and the reasons to stop and iterations by problem."""
    p, of, n = _Progress(objective, tolerance, max_iterations), objective.of, objective.n
    b = start.copy()
    value, g = objective.value_gradient(b, p.going)
    radius, failed = p.norm(g), np.zeros(n, int)
    while p.going.any():
        step, residual = _steihaug(objective, p, b, g, radius)
        p.iterations[p.going] += 1
        v, ng = objective.value_gradient(b + step, p.going)
        slope = p.dot(g, step)
        predicted, actual, size = -0.5 * (slope - p.dot(step, residual)), value - v, p.norm(step)
        radius = np.where(p.iterations == 1, np.minimum(radius, size), radius)
        with np.errstate(divide="ignore", invalid="ignore"):
            bend = -actual - slope
            scale = np.where(bend <= 0, 4.0, np.fmax(0.25, -0.5 * (slope / bend)))
            radius = np.select(
                [actual < 1e-4 * predicted, actual < 0.25 * predicted, actual < 0.75 * predicted],
                [np.minimum(np.maximum(scale, 0.25) * size, 0.5 * radius), np.maximum(0.25 * radius, np.minimum(scale * size, 0.5 * radius)), np.maximum(0.25 * radius, np.minimum(scale * size, 4 * radius))],
                np.maximum(radius, np.minimum(scale * size, 4 * radius)),
            )
            improved = p.going & (actual > 1e-4 * predicted) & np.isfinite(v)
        before, moved = value, improved[of]
        b, value, g = np.where(moved, b + step, b), np.where(improved, v, value), np.where(moved, ng, g)
        failed = np.where(improved, 0, failed + 1)
        again = ~improved & (failed < failures) & (p.iterations < max_iterations)
        p.stop(p.going & ~again, before, value, g, improved)
    return b, p.reasons, p.iterations


def _steihaug(objective, p, b, g, radius, most=20, share=0.1):
    of = p.of
    step, r, left = np.zeros_like(g), -g, p.going.copy()
    d, limit, rr = r, share * p.norm(g), p.dot(r, r)
    for _ in range(most):
        left = left & ~(np.sqrt(rr) <= limit)
        if not left.any():
            break
        hd = objective.hessian_vector(b, d, left)
        curve = p.dot(d, hd)
        with np.errstate(divide="ignore", invalid="ignore"):
            flat = curve <= 0
            alpha = np.where(flat, 0.0, rr / curve)
            out = left & (flat | (p.norm(step + alpha[of] * d) > radius))
            sd, dd = p.dot(step, d), p.dot(d, d)
            edge = (np.sqrt(sd * sd + dd * np.maximum(radius * radius - p.dot(step, step), 0)) - sd) / dd
        alpha = np.where(left, np.where(out, edge, alpha), 0.0)[of]
        step, r = step + alpha * d, r - alpha * hd
        left = left & ~out
        old, rr = rr, np.where(left, p.dot(r, r), rr)
        d = np.where(left[of], r + (rr / np.where(left, old, 1.0))[of] * d, d)
    return step, r
