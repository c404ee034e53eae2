"""Eigenvalues and eigenvectors of a sum of outer products that grows by one product at a time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

EPS = np.finfo(np.float64).eps
#: Rows of a block.
BLOCK = 1024


def secular_roots(poles: np.ndarray, squares: np.ndarray, rho: float, steps: int = 80, close: float = 1e-8) -> np.ndarray:
    """Matrix of pole i minus root j of ``1 + rho * sum(squares / (poles - root))``, poles rising, squares and rho positive.

    Every root lies right of its pole and left of the next one. It is kept as a distance from the nearer of both, so differences to
    poles are exact to the last digits however close a root is. A step fits both neighbouring poles; where it would leave the
    bracket, the bracket is halved.
    """
    k = len(poles)
    right = np.append(poles[1:], poles[-1] + rho * squares.sum())
    gap, columns, z2 = right - poles, np.arange(k), squares[:, None]
    below = columns[:, None] <= columns
    half = gap / 2
    with np.errstate(all="ignore"):
        at_half = 1 / rho + (z2 / ((poles[:, None] - poles) - half)).sum(axis=0)
        near_right = (at_half < 0) & (columns < k - 1)
        origin = np.where(near_right, right, poles)
        low, high = np.where(at_half < 0, half, 0.0), np.where(at_half < 0, gap, half)
        low, high = np.where(near_right, -half, low), np.where(near_right, 0.0, high)
        distance, tau = poles[:, None] - origin, (low + high) / 2
        to_right, inverse, ones, below = right - origin, 1 / rho, np.ones(k), below.astype(np.float64)
        for _ in range(steps):
            apart = distance - tau
            part = z2 / apart
            slope = part / apart
            f, total, left = inverse + ones @ part, ones @ slope, np.einsum("ij,ij->j", below, slope)
            above = f >= 0
            low, high = np.where(above, low, tau), np.where(above, tau, high)
            d1, d2 = apart.diagonal(), to_right - tau
            both = d1 * d2
            c, a = f - d1 * left - d2 * (total - left), (d1 + d2) * f - both * total
            root = np.sqrt(np.maximum(a * a - 4 * both * f * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * both * f / (a + root))
            step[-1] = d1[-1] + d1[-1] ** 2 * left[-1] / (f[-1] - d1[-1] * left[-1])  # no pole right of the last root
            new = tau + step
            inside = ((new > low) & (new < high)) | (np.abs(step) <= close * np.abs(tau))
            if not inside.all():
                new = np.where(inside, new, (low + high) / 2)
            settled = (np.abs(new - tau) <= close * np.abs(new)).all()
            tau = new
            if settled:  # a step is followed by one of about its square
                break
    return distance - tau


def _merge_equal(values: np.ndarray, z: np.ndarray, vectors: np.ndarray, active: np.ndarray, tol: float) -> np.ndarray:
    """Turns pairs of (nearly) equal eigenvalues so that one of the two is untouched by the update; the ones left active."""
    keep, last = [], active[0]
    for i in active[1:]:
        r = np.hypot(z[last], z[i])
        c, s = z[i] / r, z[last] / r
        if (values[i] - values[last]) * abs(c * s) <= tol:
            z[i], z[last] = r, 0.0
            a, b = vectors[:, last].copy(), vectors[:, i].copy()
            vectors[:, last], vectors[:, i] = c * a - s * b, s * a + c * b
            low, high = values[last], values[i]
            values[last], values[i] = low * c * c + high * s * s, low * s * s + high * c * c
        else:
            keep.append(last)
        last = i
    return np.array([*keep, last])


def rank_one(values: np.ndarray, vectors: np.ndarray, step: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of ``vectors diag(values) vectors^T + weight * step step^T``.

    Directions that the step does not touch, and all but one of equal eigenvalues, stay as they are (deflation). The others come from the
    secular equation; its vectors use the weights that belong to the computed roots, which keeps them orthogonal.
    """
    z = vectors.T @ step
    norm = float(z @ z)
    rho = weight * norm
    if not rho > 0:
        return values, vectors
    z = z / np.sqrt(norm)
    tol = 8 * EPS * max(abs(values[0]), abs(values[-1]), rho)
    active = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(active):
        return values, vectors
    touched = z[active]
    near = np.diff(values[active]) * np.abs(touched[1:] * touched[:-1]) <= tol * (touched[1:] ** 2 + touched[:-1] ** 2)
    if near.any():
        values, vectors = values.copy(), vectors.copy()
        active = _merge_equal(values, z, vectors, active, tol)
    poles, k = values[active], len(active)
    if k == 1:
        values = values.copy()
        values[active[0]] += rho * z[active[0]] ** 2
    else:
        apart = secular_roots(poles, z[active] ** 2, rho)
        others = (poles - poles[:, None])[~np.eye(k, dtype=bool)].reshape(k, k - 1)
        own = np.sqrt(np.abs(np.prod(-apart[:, :-1] / others, axis=1) * -apart[:, -1] / rho)) * np.sign(z[active])
        turn = own[:, None] / apart
        turn /= np.sqrt((turn * turn).sum(axis=0))
        nearest = np.abs(apart).argmin(axis=0)
        roots = poles[nearest] - apart[nearest, np.arange(k)]
        if k == len(values):
            return roots, vectors @ turn
        values, vectors = values.copy(), vectors.copy()
        values[active], vectors[:, active] = roots, vectors[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Rows seen so far: their number, mean, and the spectrum of the sum of their centred outer products."""

    size: int
    n: int = 0
    mean: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.mean is None:
            self.mean, self.values, self.vectors = np.zeros(self.size), np.zeros(self.size), np.eye(self.size)

    def add(self, row: np.ndarray) -> None:
        step = row - self.mean
        self.n += 1
        self.mean = self.mean + step / self.n
        self.values, self.vectors = rank_one(self.values, self.vectors, step, (self.n - 1) / self.n)

    def add_rows(self, rows: np.ndarray) -> None:
        """Adds many rows. The triangular factor of a centred block has the same outer products in as many rows as there are columns, so
        a block of more rows than columns costs that many updates, and one for the distance of its mean."""
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            if len(block) <= self.size:
                for row in block:
                    self.add(row)
                continue
            mean = block.mean(axis=0)
            for row in np.linalg.qr(block - mean, mode="r"):
                self.values, self.vectors = rank_one(self.values, self.vectors, row)
            self._shift(mean, len(block))

    def merge(self, other: Spectrum) -> None:
        """Takes up another spectrum: one update for each of its eigenvectors, and one for the distance of both means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self._shift(other.mean, other.n)

    def _shift(self, mean: np.ndarray, count: int) -> None:
        step, n = mean - self.mean, self.n + count
        self.values, self.vectors = rank_one(self.values, self.vectors, step, self.n * count / n)
        self.mean, self.n = self.mean + step * (count / n), n
