"""Robust fits of lines, circles and curves to groups of points, and the choice among them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs

#: Groups of up to so many points list all their pairs; larger ones count ranks.
PAIR_POINTS = 1200
#: Free parameters of each primitive; weights of the two criteria in the choice.
PARAMETERS, AIC_WEIGHT, BIC_WEIGHT = {"line": 2, "arc": 3, "bezier": 6}, 0.7, 0.3


def inversions(z: np.ndarray) -> int:
    """Number of pairs i < j with z[i] >= z[j], by the bits of their ranks from the highest on."""
    n = len(z)
    if n < 2:
        return 0
    rank = np.empty(n, np.int64)
    rank[np.lexsort((-np.arange(n), z))] = np.arange(n)  # of equal values the later one is lower
    total, own = 0, rank
    for bit in range(int(n - 1).bit_length() - 1, -1, -1):
        one = own >> bit & 1
        group = own >> bit + 1
        ones = np.cumsum(one)
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before = np.repeat(ones[start] - one[start], np.diff(np.r_[start, n]))
        total += int((ones - before)[one == 0].sum())
        own = own[np.argsort(own >> bit, kind="stable")]
    return total


def _ordered(x: float) -> int:
    """A whole number in the order of doubles."""
    k = int(np.float64(x).view(np.int64))
    return k if k >= 0 else -(k & 0x7FFFFFFFFFFFFFFF)


def _double(k: int) -> float:
    return float(np.int64(k).view(np.float64)) if k >= 0 else -float(np.int64(-k).view(np.float64))


def _select(count, rank: int, guess: np.ndarray) -> float:
    """The least double that at least rank + 1 values do not exceed, count(v) being their number; guess is a sample of them."""
    guess = np.sort(guess)
    spread = max(1, len(guess) // 50)
    mid = len(guess) // 2
    lo, hi = float(guess[max(0, mid - spread)]), float(guess[min(len(guess) - 1, mid + spread)])
    if count(lo) > rank:
        lo = -np.finfo(float).max
    if count(hi) <= rank:
        hi = np.finfo(float).max
    a, b = _ordered(lo), _ordered(hi)
    while b - a > 1:
        mid = (a + b) // 2
        if count(_double(mid)) > rank:
            b = mid
        else:
            a = mid
    return _double(b)


def theil_sen(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """(a, b, c) of the line a x + b y + c = 0: the upper median of the slopes of all pairs, and of the pairs' intercepts.

    Large groups list no pairs: how many slopes do not exceed s is the number of inversions of y - s x in the order of x,
    and how many intercepts do not exceed c that of (y - c) / x on either side of 0, so medians come by bisection."""
    n = len(x)
    if n < 2:
        return None
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    _, same = np.unique(x, return_counts=True)
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return 1.0, 0.0, -float(x[0])
    if n <= PAIR_POINTS:
        i, j = np.triu_indices(n, 1)
        keep = x[j] > x[i]
        slopes = (y[j] - y[i])[keep] / (x[j] - x[i])[keep]
        cuts = y[i][keep] - slopes * x[i][keep]
        return float(np.partition(slopes, pairs // 2)[pairs // 2]), -1.0, float(np.partition(cuts, pairs // 2)[pairs // 2])
    rng = np.random.default_rng(0)
    i, j = np.sort(rng.integers(0, n, (2, 40_000)), axis=0)
    i, j = i[x[i] < x[j]], j[x[i] < x[j]]
    twins = np.unique(np.stack([x, y]), axis=1, return_counts=True)[1]
    twin_pairs = int((twins * (twins - 1) // 2).sum())
    slope = _select(lambda s: inversions(y - s * x) - twin_pairs, pairs // 2, (y[j] - y[i]) / (x[j] - x[i]))
    left, zero, right = x < 0, x == 0, x > 0

    def cuts_upto(c: float) -> int:
        # Of a pair on one side of 0, left x first, the intercept is at most c if (y - c) / x does not fall; of two sides if it does not rise.
        own = 0
        for side in (left, right):
            w = (y[side] - c) / x[side]
            at = np.lexsort((-w, x[side]))  # equal x: falling, so that they do not count unless equal
            m = len(w)
            equal = np.unique(np.stack([x[side], w]), axis=1, return_counts=True)[1]
            own += m * (m - 1) // 2 - (inversions(w[at]) - _ties(w)) - int((equal * (equal - 1) // 2).sum())
        a, b = np.sort((y[left] - c) / x[left]), (y[right] - c) / x[right]
        own += int((len(a) - np.searchsorted(a, b, side="left")).sum())
        return own + int((y[zero] <= c).sum()) * int((~zero).sum())

    at_ends = (x[j] * y[i] - x[i] * y[j]) / (x[j] - x[i])
    return slope, -1.0, _select(cuts_upto, pairs // 2, at_ends)


def _ties(w: np.ndarray) -> int:
    n = np.unique(w, return_counts=True)[1]
    return int((n * (n - 1) // 2).sum())


def line_off(line, x, y) -> np.ndarray:
    a, b, c = line
    return np.abs(a * x + b * y + c) / np.hypot(a, b)


def straight(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """The line of least squared distances."""
    mx, my = x.mean(), y.mean()
    cov = np.cov(np.stack([x, y]), bias=True) if len(x) > 1 else np.zeros((2, 2))
    a, b = np.linalg.eigh(cov)[1][:, 0]
    return float(a), float(b), float(-a * mx - b * my)


def ransac_line(x: np.ndarray, y: np.ndarray, limit: float, tries: int, seed: int) -> tuple[tuple[float, float, float], np.ndarray] | None:
    """The line through the inliers of the pair of points that has most within limit, of tries pairs from seed, and its inliers.

    All hypotheses are scored in one pass over blocks of points, so memory does not grow with tries times points."""
    n = len(x)
    if n < 2:
        return None
    i, j = np.random.default_rng(seed).integers(0, n, (2, tries))
    a, b = y[j] - y[i], x[i] - x[j]
    norm = np.hypot(a, b)
    a, b, norm, i = a[norm > 0], b[norm > 0], norm[norm > 0], i[norm > 0]
    if not len(a):
        return (straight(x, y), np.ones(n, bool)) if np.ptp(x) + np.ptp(y) > 0 else ((1.0, 0.0, -float(x[0])), np.ones(n, bool))
    c = -a * x[i] - b * y[i]
    hits = np.zeros(len(a), np.int64)
    for s in range(0, n, 8192):
        hits += (np.abs(np.outer(a, x[s : s + 8192]) + np.outer(b, y[s : s + 8192]) + c[:, None]) < limit * norm[:, None]).sum(axis=1)
    k = int(hits.argmax())
    inside = np.abs(a[k] * x + b[k] * y + c[k]) < limit * norm[k]
    return straight(x[inside], y[inside]), inside


def circle(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float, float] | None:
    """(cx, cy, r) of least squared differences to the radius, by damped Gauss-Newton steps from the algebraic fit."""
    if len(x) < 3:
        return None
    mx, my = x.mean(), y.mean()
    u, v = x - mx, y - my
    m = np.stack([2 * u, 2 * v, np.ones_like(u)], axis=1)
    if np.linalg.matrix_rank(m) < 3:
        return None
    p = np.linalg.lstsq(m, u * u + v * v, rcond=None)[0]
    at = np.array([p[0], p[1], np.sqrt(max(p[2] + p[0] ** 2 + p[1] ** 2, 0.0))])
    off = lambda q: np.hypot(u - q[0], v - q[1]) - q[2]
    damp, now = 1e-3, (off(at) ** 2).sum()
    for _ in range(rounds):
        d = np.maximum(np.hypot(u - at[0], v - at[1]), 1e-12)
        jac = np.stack([(at[0] - u) / d, (at[1] - v) / d, -np.ones_like(d)], axis=1)
        h = jac.T @ jac
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h)), -jac.T @ (d - at[2]), rcond=None)[0]
        new = (off(at + step) ** 2).sum()
        if new < now:
            at, now, damp = at + step, new, damp / 2
            if np.abs(step).max() < 1e-12 * (1 + np.abs(at).max()):
                break
        else:
            damp *= 2
    return float(at[0] + mx), float(at[1] + my), float(abs(at[2]))


def ransac_circle(x: np.ndarray, y: np.ndarray, limit: float, tries: int, seed: int) -> tuple[tuple[float, float, float], np.ndarray] | None:
    """The circle fitted to the inliers of the three points whose circle has most within limit, of tries from seed, and its inliers."""
    n = len(x)
    if n < 3:
        return None
    i, j, k = np.random.default_rng(seed).integers(0, n, (3, tries))
    ax, ay, bx, by = x[j] - x[i], y[j] - y[i], x[k] - x[i], y[k] - y[i]
    d = 2 * (ax * by - ay * bx)
    ok = np.abs(d) > 1e-12
    if not ok.any():
        return None
    ax, ay, bx, by, d, i = (q[ok] for q in (ax, ay, bx, by, d, i))
    px, py = (by * (ax**2 + ay**2) - ay * (bx**2 + by**2)) / d, (ax * (bx**2 + by**2) - bx * (ax**2 + ay**2)) / d
    r, cx, cy = np.hypot(px, py), px + x[i], py + y[i]
    hits = np.zeros(len(r), np.int64)
    for s in range(0, n, 8192):
        hits += (np.abs(np.hypot(x[s : s + 8192] - cx[:, None], y[s : s + 8192] - cy[:, None]) - r[:, None]) < limit).sum(axis=1)
    b = int(hits.argmax())
    inside = np.abs(np.hypot(x - cx[b], y - cy[b]) - r[b]) < limit
    found = circle(x[inside], y[inside]) or (float(cx[b]), float(cy[b]), float(r[b]))
    return found, inside


def bezier(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Four control points (x, y) of the cubic from the first point to the last that is nearest to the others, the k-th of n at k / (n - 1)."""
    n = len(x)
    if n < 4:
        return None
    t = np.arange(n) / (n - 1)
    w = np.stack([(1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2, t**3], axis=1)
    p = np.stack([x, y], axis=1)
    inner = np.linalg.lstsq(w[:, 1:3], p - np.outer(w[:, 0], p[0]) - np.outer(w[:, 3], p[-1]), rcond=None)[0]
    return np.vstack([p[:1], inner, p[-1:]])


def bezier_off(control: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    t = np.arange(len(x)) / (len(x) - 1)
    w = np.stack([(1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2, t**3], axis=1)
    return np.hypot(*(w @ control - np.stack([x, y], axis=1)).T)


def criteria(rms: float, n: int, k: int) -> tuple[float, float]:
    """AIC and BIC of a fit of k parameters under normal errors of deviation rms."""
    fit = n * np.log(2 * np.pi * (rms * rms + 1e-10)) + n
    return 2 * k + fit, k * np.log(n) + fit


def _per_group(points: DataFrame, group: str, work, schema: str) -> DataFrame:
    """work(x, y, seed) as rows for the points of each group in the order of k; points without place are left out."""
    kind = points.schema[group].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[group].iloc[0]
        p = pdf.sort_values(["k", "x", "y"])
        rows = work(p["x"].to_numpy(float), p["y"].to_numpy(float), zlib.crc32(str(own).encode()))
        return pd.DataFrame([(own, *r) for r in rows], columns=[group, *names])

    placed = points.select(group, "k", F.col("x").cast("double"), F.col("y").cast("double")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return graphs.spread(placed, group).groupBy(group).applyInPandas(run, f"{group} {kind}, {schema}")


def line_fits(points: DataFrame, group: str) -> DataFrame:
    """(group, n, a, b, c, rms) of points (group, k, x, y): the median line of each group; groups of one point have no row.

    A group is one task's, with three numbers a point; a million points take as much memory as a hundred megabytes."""

    def work(x, y, seed):
        line = theil_sen(x, y)
        return [(len(x), *line, float(np.sqrt((line_off(line, x, y) ** 2).mean())))] if line else []

    return _per_group(points, group, work, "n long, a double, b double, c double, rms double")


def circle_fits(points: DataFrame, group: str, limit: float = 1.0, tries: int = 100) -> DataFrame:
    """(group, n, inliers, cx, cy, r, rms) of points (group, k, x, y): the circle of most inliers within limit, refined over them."""

    def work(x, y, seed):
        found = ransac_circle(x, y, limit, tries, seed)
        if found is None:
            return []
        (cx, cy, r), inside = found
        off = np.hypot(x[inside] - cx, y[inside] - cy) - r
        return [(len(x), int(inside.sum()), cx, cy, r, float(np.sqrt((off**2).mean())))]

    return _per_group(points, group, work, "n long, inliers long, cx double, cy double, r double, rms double")


def primitive_fits(points: DataFrame, group: str, limit: float = 1.0, tries: int = 100) -> DataFrame:
    """(group, kind, n, rms, inlier_share, aic, bic, score, best, values) of every primitive that fits the points of each group.

    line: a, b, c over inliers of seeded pairs; arc: cx, cy, r; bezier: four control points. best has the least weighed sum of
    the two criteria; equal ones go by kind."""

    def work(x, y, seed):
        n, rows = len(x), []
        fits = {}
        if line := ransac_line(x, y, limit, tries, seed):
            rms = float(np.sqrt((line_off(line[0], x[line[1]], y[line[1]]) ** 2).mean()))
            fits["line"] = rms, float((line_off(line[0], x, y) < limit).mean()), list(line[0])
        if round_ := circle(x, y):
            off = np.abs(np.hypot(x - round_[0], y - round_[1]) - round_[2])
            fits["arc"] = float(np.sqrt((off**2).mean())), float((off < limit).mean()), list(round_)
        if (curve := bezier(x, y)) is not None:
            fits["bezier"] = float(np.sqrt((bezier_off(curve, x, y) ** 2).mean())), 1.0, curve.reshape(-1).tolist()
        for kind, (rms, share, values) in fits.items():
            aic, bic = criteria(rms, n, PARAMETERS[kind])
            rows.append((kind, n, rms, share, float(aic), float(bic), float(AIC_WEIGHT * aic + BIC_WEIGHT * bic), values))
        top = min(((r[6], r[0]) for r in rows), default=None)
        return [(*r[:7], (r[6], r[0]) == top, r[7]) for r in rows]

    return _per_group(points, group, work, "kind string, n long, rms double, inlier_share double, aic double, bic double, score double, best boolean, values array<double>")
