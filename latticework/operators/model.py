"""Piecewise-linear models of rank by mapping: rank(m) = sum of alpha_j * relu(m - beta_j), rising in m."""

from __future__ import annotations

import numpy as np

MOST_STEPS = 200
#: Step lengths that a search along a direction tries, from long to short, and the part of the loss that a step has to gain.
STEPS = tuple(2.0**-i for i in range(10))
GAIN = 1e-4


def hinges(m: np.ndarray, betas: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, m[:, None] - betas[None, :])


def predict(alphas: np.ndarray, betas: np.ndarray, m: np.ndarray, n: float) -> np.ndarray:
    """Ranks, in 0 .. n; a slope a piece, so the work grows with the rows and not with rows times knots."""
    slopes = np.cumsum(alphas)
    starts = np.append(0.0, np.cumsum(slopes[:-1] * np.diff(betas)))
    piece = np.clip(np.searchsorted(betas, m, side="right") - 1, 0, len(betas) - 1)
    return np.clip(np.where(m > betas[0], starts[piece] + slopes[piece] * (m - betas[piece]), 0.0), 0.0, n)


def loss(alphas: np.ndarray, betas: np.ndarray, m: np.ndarray, often: np.ndarray | None = None) -> float:
    """Squared errors over the rows of sorted mappings, of which each may stand for ``often`` equal ones.

    A run of equal mappings has one prediction; its rows' ranks vary about their mean.
    """
    often = np.ones(len(m)) if often is None else often
    middle = np.cumsum(often) - (often + 1) / 2
    return float((often * (predict(alphas, betas, m, often.sum()) - middle) ** 2 + often * (often * often - 1) / 12).sum())


def valid(alphas: np.ndarray, betas: np.ndarray) -> bool:
    """Knots rise strictly and no slope is negative (but for rounding), so predictions never fall."""
    slopes = np.cumsum(alphas)
    return bool((np.diff(betas) > 0).all() and (slopes >= -1e-12 * np.abs(alphas).max(initial=0.0)).all())


def ranks_below(m: np.ndarray, often: np.ndarray | None, betas: np.ndarray) -> np.ndarray:
    """Rows below each knot, and the last row's rank."""
    before = np.arange(len(m) + 1) if often is None else np.append(0, np.cumsum(often))
    return np.append(before[np.searchsorted(m, betas, side="left")], before[-1] - 1).astype(float)


def interpolation(m: np.ndarray, betas: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """Alphas of the line through the ranks at the knots and the last rank; always rising."""
    at = np.append(betas, max(m[-1], betas[-1] + 1e-12))
    ranks = ranks_below(m, often, betas)
    slopes = np.diff(np.maximum.accumulate(ranks)) / np.maximum(np.diff(at), 1e-300)
    return np.diff(np.append(0.0, slopes))


class Sums:
    """Running sums over different sorted mappings, which start at 0 and stand for ``often`` rows each: all that fitting needs.

    A model is described by its values at the knots and at the last mapping. Squared errors are then a quadratic form in the
    values whose matrix is tridiagonal and comes from six sums a piece.
    """

    def __init__(self, m: np.ndarray, often: np.ndarray):
        self.m, self.often = m, often
        first = np.cumsum(often) - often
        # the sums of the ranks first .. first + often - 1 and of their squares
        r = often * (first + (often - 1) / 2)
        rr = often * first * first + first * often * (often - 1) + (often - 1) * often * (2 * often - 1) / 6
        self.run = np.zeros((6, len(m) + 1))
        np.cumsum([often, often * m, often * m * m, r, r * m, rr], axis=1, out=self.run[:, 1:])

    def pieces(self, betas: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts, sums of t and of t^2, of the rank and of rank times t, by piece; t runs from 0 to 1 along a piece."""
        nodes = np.append(betas, self.m[-1])
        cut = np.append(np.searchsorted(self.m, betas, side="left"), len(self.m))
        n, x, xx, r, rx, _ = np.diff(self.run[:, cut], axis=1)
        low, width = nodes[:-1], np.diff(nodes)
        t = np.clip((x - low * n) / width, 0, n)
        tt = np.clip((xx - 2 * low * x + low * low * n) / width**2, 0, t)
        return n, t, tt, r, (rx - low * r) / width

    def system(self, pieces: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        n, t, tt, r, rt = pieces
        k = len(n)
        a, b, i = np.zeros((k + 1, k + 1)), np.zeros(k + 1), np.arange(k)
        a[i, i] += n - 2 * t + tt
        a[i + 1, i + 1] += tt
        a[i, i + 1] += t - tt
        a[i + 1, i] += t - tt
        b[:-1] += r - rt
        b[1:] += rt
        return a, b

    def solve(self, betas: np.ndarray) -> tuple[float, np.ndarray]:
        """(squared error, values at the nodes) of a rising model with these knots: least squares, and where values fall, pooled by the rows about them.

        Pooled values are the nearest rising ones to the solution; ordered ones are tried too, as errors at neighbouring nodes are not independent.
        """
        a, b = self.system(self.pieces(betas))
        ridge = 1e-9 * np.trace(a) / len(a)
        values = np.zeros(len(b))
        values[1:] = np.linalg.solve(a[1:, 1:] + ridge * np.eye(len(b) - 1), b[1:])
        if values[1] >= 0 and (np.diff(values) >= 0).all():
            return self.error(a, b, values), values
        made = []
        for repaired in (pooled(values[1:], np.diag(a)[1:] + ridge), np.sort(values[1:])):
            rising = np.append(0.0, np.maximum(repaired, 0.0))
            made.append((self.error(a, b, rising), rising))
        return min(made, key=lambda x: x[0])

    def error(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> float:
        return float(values @ a @ values - 2 * values @ b + self.run[5, -1])

    def interpolated(self, betas: np.ndarray) -> tuple[float, np.ndarray]:
        values = ranks_below(self.m, self.often, betas)
        return self.error(*self.system(self.pieces(betas)), values), values

    def slopes_at(self, betas: np.ndarray, values: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of half the squared error by the knots, and its Gauss-Newton curvature."""
        n, t, _, r, _ = self.pieces(betas)
        error = values[:-1] * (n - t) + values[1:] * t - r
        behind, above = np.cumsum(error[::-1])[::-1], np.cumsum(n[::-1])[::-1]
        later = np.maximum.outer(np.arange(len(betas)), np.arange(len(betas)))
        return -alphas * behind, alphas[:, None] * alphas[None, :] * above[later]


def alphas_of(betas: np.ndarray, values: np.ndarray, last: float) -> np.ndarray:
    slopes = np.diff(values) / np.diff(np.append(betas, last))
    return np.diff(np.append(0.0, slopes))


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``values`` in weighted squares: neighbours that fall are pooled into their mean until none does."""
    level, mass, size = [], [], []
    for v, w in zip(values.tolist(), weights.tolist()):
        level.append(v)
        mass.append(w)
        size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            v2, w2, s2 = level.pop(), mass.pop(), size.pop()
            both = mass[-1] + w2
            level[-1] = (level[-1] * mass[-1] + v2 * w2) / both if both > 0 else (level[-1] + v2) / 2
            mass[-1], size[-1] = both, size[-1] + s2
    return np.repeat(level, size)


def train_segment(sorted_m: np.ndarray, knots: int) -> tuple[np.ndarray, np.ndarray, float]:
    """As ``train_runs``, from one mapping a row."""
    m, often = np.unique(np.asarray(sorted_m, float), return_counts=True)
    return train_runs(m, often, knots)


def train_runs(m: np.ndarray, often: np.ndarray, knots: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(alphas, betas, loss) for different sorted mappings of ``often`` rows each, shifted to start at 0. The best rising model seen is kept.

    Knots start at equal counts and move by Gauss-Newton steps on the squared error, or downhill if that gains nothing,
    as long as a tried step length lowers the loss. Segments of equal or few mappings get one flat or straight piece.
    Mappings are passed over once, for running sums; a step costs what its knots cost.
    """
    m, often = np.asarray(m, float) - m[0], np.asarray(often, float)
    if m[-1] <= 0:
        return np.zeros(1), np.zeros(1), loss(np.zeros(1), np.zeros(1), m, often)
    n = int(often.sum())
    ranks = np.linspace(0, n - 1, min(knots, n), endpoint=False).astype(int)
    betas = np.unique(m[np.searchsorted(np.cumsum(often), ranks, side="right")])
    sums, last = Sums(m, often), m[-1]
    gap = last * 1e-9
    betas = betas[np.append(True, np.diff(betas) > gap)]
    betas = betas[(betas < last - gap) | (betas == 0)]
    (best, values), line = sums.solve(betas), sums.interpolated(betas)
    if line[0] < best:
        best, values = line
    first = (betas, alphas_of(betas, values, last))
    for _ in range(MOST_STEPS):
        gradient, curve = sums.slopes_at(betas, values, alphas_of(betas, values, last))
        ways = [-gradient * (np.diff(betas).min(initial=last) / max(np.abs(gradient).max(), 1e-300))]
        inner = curve[1:, 1:]
        if len(inner) and np.isfinite(inner).all() and np.linalg.cond(inner) < 1 / np.finfo(float).eps:
            ways.insert(0, np.append(0.0, -np.linalg.solve(inner, gradient[1:])))
        tried = ((betas + step * way) for way in ways for step in STEPS)
        for moved in tried:
            moved[0] = 0.0
            if (np.diff(moved) > gap).all() and moved[-1] < last - gap:
                value, v = sums.solve(moved)
                if value < best * (1 - GAIN):
                    best, values, betas = value, v, moved
                    break
        else:
            break
    made = [(loss(a, b, m, often), a, b) for b, a in ((betas, alphas_of(betas, values, last)), first, (betas, interpolation(m, betas, often))) if valid(a, b)]
    value, alphas, betas = min(made, key=lambda x: x[0])
    return alphas, betas, value
