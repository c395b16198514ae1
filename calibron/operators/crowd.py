"""Sums over a crowd of normal scores of the chance that each stands the wrong way round to a point, without pairs.

The chance for a point x with variance V and a score s with variance v is the normal tail of |x - s| / sqrt(V + v).
On either side of x it solves the heat equation in (x, v), so all scores of a cell that is small beside
sqrt(V + v) act through their first ``TERMS`` moments, to the precision of a double. Scores left of x enter with the
other sign; where x lies within a cell, the moments of the scores up to x are those of the cell's first so many.
"""

from __future__ import annotations

import math

import numpy as np

#: Moments of a cell, its width in standard deviations, the ratio of its variances, and that of the points it meets.
TERMS, WIDTH, SPREAD, POINTS = 40, 1.6, 1.4, 2.0
#: Standard deviations beyond which a tail is nothing, and points that are worked on at a time.
FAR, CHUNK = 9.0, 4096

#: Taylor coefficients of the normal distribution function around -FAR, -FAR + STEP, ...
STEP, DEGREE = 1 / 16, 8
_grid = np.arange(-FAR, FAR + STEP / 2, STEP)
_hermite = [np.ones_like(_grid), _grid]
for _k in range(1, DEGREE):
    _hermite.append(_grid * _hermite[-1] - _k * _hermite[-2])
_density = np.exp(-_grid * _grid / 2) / math.sqrt(2 * math.pi)
_TAYLOR = [np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _grid])] + [(-1) ** (k - 1) * _hermite[k - 1] * _density / math.factorial(k) for k in range(1, DEGREE + 1)]


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The normal distribution function to 1e-15; beyond ``FAR`` it is that at ``FAR``."""
    z = np.clip(z, -FAR, FAR)
    k = np.rint((z + FAR) / STEP).astype(np.intp)
    d = z - _grid[k]
    out = _TAYLOR[DEGREE][k]
    for c in reversed(_TAYLOR[:DEGREE]):
        out = out * d + c[k]
    return out


def _moments(delta: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """(TERMS x rows): the coefficients of exp(-delta t + eta t^2 / 2), times sqrt(n!)."""
    out = np.empty((TERMS, len(delta)))
    out[0], out[1] = 1, -delta
    for n in range(1, TERMS - 1):
        out[n + 1] = (eta * math.sqrt(n) * out[n - 1] - delta * out[n]) / math.sqrt(n + 1)
    return out


def _below(y: np.ndarray, var: np.ndarray, scale: float, moments: np.ndarray) -> np.ndarray:
    """The summed distribution function at distances ``y`` from a cell's centre; ``moments`` (TERMS) or (TERMS x points)."""
    total = np.empty_like(y)
    for i in range(0, len(y), CHUNK):
        part = slice(i, i + CHUNK)
        total[part] = _below_part(y[part], var[part], scale, moments[:, part] if moments.ndim > 1 else moments)
    return total


def _below_part(y: np.ndarray, var: np.ndarray, scale: float, moments: np.ndarray) -> np.ndarray:
    root = np.sqrt(var)
    z = y / root
    total = moments[0] * normal_cdf(z)
    a, b = -scale * z / root, -(scale * scale) / var
    last, now = np.zeros_like(z), np.exp(-z * z / 2) * (scale / (math.sqrt(2 * math.pi) * root))
    step = np.empty_like(z)
    for n in range(1, TERMS):
        np.multiply(now, moments[n], out=step)
        total += step
        np.multiply(a, now, out=step)
        last *= b
        last *= (n - 1) / math.sqrt(n)
        last += step
        last *= 1 / math.sqrt(n + 1)
        last, now = now, last
    return total


def wrong_order_sums(x: np.ndarray, var: np.ndarray, s: np.ndarray, v: np.ndarray, zone: float = 0.0) -> np.ndarray:
    """For each point (x, var) the sum over all scores (s, v) of the chance of standing the wrong way round by more than ``zone``."""
    out = np.zeros(len(x))
    if not len(x) or not len(s):
        return out
    kind = np.floor(np.log(var) / math.log(POINTS)).astype(int)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        at = at[np.argsort(x[at], kind="stable")]
        out[at] = _sums_of_kind(x[at], var[at], s, v, zone)
    return out


def _sums_of_kind(x: np.ndarray, var: np.ndarray, s: np.ndarray, v: np.ndarray, zone: float) -> np.ndarray:
    least, most = float(var.min()), float(var.max())
    spread = np.floor(np.log(v + least) / math.log(SPREAD)).astype(int)
    width = WIDTH * np.sqrt(SPREAD**spread.astype(float))
    column = np.floor(s / width).astype(np.int64)
    order = np.lexsort((s, column, spread))
    s, v, spread, column = s[order], v[order], spread[order], column[order]
    first = np.flatnonzero(np.r_[True, (np.diff(spread) != 0) | (np.diff(column) != 0)])
    last = np.r_[first[1:], len(s)]
    out = np.zeros(len(x))
    for i, j in zip(first, last, strict=True):
        part_s, part_v = s[i:j], v[i:j]
        centre, mid = (part_s[0] + part_s[-1]) / 2, (part_v.min() + part_v.max()) / 2
        scale = math.sqrt(least + mid)
        reach = FAR * math.sqrt(most + part_v.max()) + zone
        lo, hi = np.searchsorted(x, (part_s[0] - reach, part_s[-1] + reach))
        if lo == hi:
            continue
        each = _moments((part_s - centre) / scale, (part_v - mid) / scale**2)
        every = each.sum(axis=1)
        inner, outer = np.searchsorted(x, part_s[0], "right"), np.searchsorted(x, part_s[-1], "left")
        outer = max(inner, outer)
        if lo < inner:  # the whole cell is right of these points, or at them
            out[lo:inner] += _below(x[lo:inner] - zone - centre, var[lo:inner] + mid, scale, every)
        if outer < hi:
            out[outer:hi] += (j - i) - _below(x[outer:hi] + zone - centre, var[outer:hi] + mid, scale, every)
        if inner < outer:
            point, spread_of = x[inner:outer], var[inner:outer] + mid
            n = np.searchsorted(part_s, point, "left")
            upto = np.cumsum(each, axis=1)[:, n - 1]
            out[inner:outer] += n - _below(point + zone - centre, spread_of, scale, upto)
            out[inner:outer] += _below(point - zone - centre, spread_of, scale, every[:, None] - upto)
    return out
