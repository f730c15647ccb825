"""Smoothers of single series in numpy: local regression, seasonal-trend
decomposition, and the line with the least largest error."""

from __future__ import annotations

import math

import numpy as np


def loess(y: np.ndarray, window: int, at: np.ndarray | None = None, degree: int = 1) -> np.ndarray:
    """Local regression of equidistant values: for each place of ``at`` the
    ``window`` nearest values, weighted by the cube of the cubed distance."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    size = min(window, n)
    first = np.clip(np.round(at).astype(int) - size // 2, 0, n - size)
    x = first[:, None] + np.arange(size)
    far = x - at[:, None]
    reach = np.maximum(np.abs(far).max(1), 1e-12) * (1.001 if window <= n else 1 + (window - n) / (2 * n))
    w = (1 - np.minimum(np.abs(far) / reach[:, None], 1) ** 3) ** 3
    values = y[x]
    mean = (w * values).sum(1) / w.sum(1)
    if degree == 0:
        return mean
    centre = (w * far).sum(1) / w.sum(1)
    spread = (w * (far - centre[:, None]) ** 2).sum(1)
    slope = (w * (far - centre[:, None]) * values).sum(1) / np.where(spread > 1e-12, spread, np.inf)
    return mean - slope * centre


def _moving(y: np.ndarray, k: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(y)])
    return (total[k:] - total[:-k]) / k


def stl(y: np.ndarray, period: int, season_window: int = 7, inner: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season.  Each round smooths the places of a period one by one
    (one step beyond both ends), takes what is slow out of that, and smooths what
    the season leaves as the trend."""
    y = np.asarray(y, float)
    n = len(y)
    if period < 2 or n < 2 * period:
        raise ValueError("a season needs two whole periods")
    trend_window = math.ceil(1.5 * period / (1 - 1.5 / season_window)) | 1
    low_window = period | 1
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(inner):
        rest = y - trend
        cycle = np.zeros(n + 2 * period)
        for k in range(period):
            own = rest[k::period]
            cycle[k::period][: len(own) + 2] = loess(own, season_window, np.arange(-1, len(own) + 1))
        slow = loess(_moving(_moving(_moving(cycle, period), period), 3), low_window)
        season = cycle[period : period + n] - slow[:n]
        trend = loess(y - season, trend_window)
    return trend, season


def minimax_line(y: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and error of the line over 0..n-1 whose largest absolute
    error is least: half way between an edge of one hull and the farthest point
    of the other."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 3:
        slope = float(y[1] - y[0]) if n == 2 else 0.0
        return slope, float(y[0]), 0.0

    def hull(sign: float) -> np.ndarray:
        kept: list[int] = []
        for i in range(n):
            while len(kept) > 1 and sign * ((kept[-1] - kept[-2]) * (y[i] - y[kept[-2]]) - (y[kept[-1]] - y[kept[-2]]) * (i - kept[-2])) >= 0:
                kept.pop()
            kept.append(i)
        return np.array(kept)

    above, below = hull(1.0), hull(-1.0)
    best = (math.inf, 0.0, 0.0)
    for own, other in ((above, below), (below, above)):
        for a, b in zip(own[:-1], own[1:], strict=True):
            slope = (y[b] - y[a]) / (b - a)
            off = y[other] - y[a] - slope * (other - a)
            far = off[np.abs(off).argmax()]
            if abs(far) / 2 < best[0]:
                best = (abs(far) / 2, slope, y[a] - slope * a + far / 2)
    return float(best[1]), float(best[2]), float(best[0])
