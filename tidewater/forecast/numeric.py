"""Fits of single series in numpy: exponential smoothing and autoregression.

Small helpers that run inside tasks; Spark deals the series out by key.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np

#: So many values a fit stores; ``roll`` gives any number from the state.
HORIZON = 64


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, spread: float = 0.1, rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Nelder-Mead minimisation."""
    points = np.vstack([start, *(start + spread * e for e in np.eye(len(start)))])
    costs = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = costs.argsort(kind="stable")
        points, costs = points[order], costs[order]
        if abs(costs[-1] - costs[0]) <= tol * (abs(costs[0]) + tol):
            break
        centre = points[:-1].mean(0)
        for factor in (-1.0, -2.0):
            tried = centre + factor * (points[-1] - centre)
            cost = f(tried)
            if factor == -1.0:
                mirrored, mirrored_cost = tried, cost
                if cost >= costs[0]:
                    break
        best, best_cost = (tried, cost) if cost < mirrored_cost else (mirrored, mirrored_cost)
        if best_cost < costs[-2]:
            points[-1], costs[-1] = best, best_cost
            continue
        inner = centre + 0.5 * (points[-1] - centre)
        cost = f(inner)
        if cost < costs[-1]:
            points[-1], costs[-1] = inner, cost
        else:
            points[1:] = points[0] + 0.5 * (points[1:] - points[0])
            costs[1:] = [f(p) for p in points[1:]]
    return points[costs.argmin()]


def holt_winters(y: np.ndarray, alpha: float, beta: float, gamma: float, period: int, trend: bool, multiplicative: bool, damping: float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
    """Squared one-step errors, and the state after the last value; ``season``
    starts with the next step's.  A slope is damped from step to step."""
    seasonal = period > 1 and len(y) >= 2 * period
    if seasonal:
        first, second = y[:period].mean(), y[period : 2 * period].mean()
        level, slope = first, (second - first) / period if trend else 0.0
        season = list(y[:period] / first if multiplicative and first else y[:period] - first)
        at = period
    else:
        level, slope, season, at = y[0], (y[1] - y[0] if trend and len(y) > 1 else 0.0), [], 1
    total = 0.0
    for i in range(at, len(y)):
        s = season[i % period] if seasonal else (1.0 if multiplicative else 0.0)
        slope *= damping
        guess = (level + slope) * s if multiplicative and seasonal else level + slope + (s if seasonal else 0.0)
        total += (y[i] - guess) ** 2
        before = level
        plain = (y[i] / s if s else y[i]) if multiplicative and seasonal else y[i] - (s if seasonal else 0.0)
        level = alpha * plain + (1 - alpha) * (level + slope)
        if trend:
            slope = beta * (level - before) + (1 - beta) * slope
        if seasonal:
            new = (y[i] / level if level else 1.0) if multiplicative else y[i] - level
            season[i % period] = gamma * new + (1 - gamma) * s
    out = {"level": np.array([level]), "trend": np.array([slope]), "multiplicative": np.array([float(multiplicative and seasonal)]), "damping": np.array([damping])}
    if seasonal:
        out["season"] = np.roll(np.array(season), -(len(y) % period))
    return total, out


def fit_holt_winters(y: np.ndarray, period: int = 1, trend: bool = True, multiplicative: bool = False, damped: bool = False, weights: tuple[float, float, float] | None = None) -> dict[str, np.ndarray]:
    """``weights`` fixes the three smoothing weights; else all are fitted, with
    ``damped`` the damping too (between 0.8 and 1)."""

    def run(p: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        inside = np.clip(p, 1e-4, 1 - 1e-4)
        return holt_winters(y, *inside[:3], period, trend, multiplicative, 0.8 + 0.2 * inside[3] if damped else 1.0)

    def cost(p: np.ndarray) -> float:
        return run(p)[0] + 1e6 * float(np.abs(p - np.clip(p, 0, 1)).sum())

    if weights is not None:
        total, state = holt_winters(y, *weights, period, trend, multiplicative)
        return state | {"weights": np.array(weights), "sse": np.array([total])}
    p = np.clip(simplex(cost, np.array([0.3, 0.1, 0.1, 0.9][: 4 if damped else 3])), 1e-4, 1 - 1e-4)
    total, state = run(p)
    return state | {"weights": p[:3], "sse": np.array([total])}


def difference(y: np.ndarray, d: int, lag: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    tails = []
    for _ in range(d):
        tails.append(y[-lag:])
        y = y[lag:] - y[:-lag]
    return y, tails


def undo(path: np.ndarray, tails: list[np.ndarray], lag: int = 1) -> np.ndarray:
    for tail in reversed(tails):
        out = list(tail)
        for v in path:
            out.append(v + out[-lag])
        path = np.array(out[lag:])
    return path


def _residuals(z: np.ndarray, phi: np.ndarray, theta: np.ndarray, lags: np.ndarray) -> np.ndarray:
    e = np.zeros(len(z))
    p = int(lags.max(initial=0))
    for i in range(p, len(z)):
        e[i] = z[i] - phi @ z[i - lags] - sum(theta[j] * e[i - 1 - j] for j in range(min(len(theta), i)))
    return e[p:]


def fit_arima(y: np.ndarray, ar: int = 1, d: int = 0, ma: int = 0, period: int = 1, sar: int = 0, sd: int = 0, horizon: int = HORIZON) -> dict[str, np.ndarray]:
    """Conditional sum of squares; seasonal lags are additive.  ``path`` is the
    forecast of the next ``horizon`` values, ``spread`` its standard error."""
    w, seasonal_tails = difference(y.astype(float), sd, period)
    w, tails = difference(w, d)
    mean = w.mean() if len(w) else 0.0
    z = w - mean
    lags = np.array([*range(1, ar + 1), *(period * i for i in range(1, sar + 1))], int)
    most = int(lags.max(initial=0))
    phi, theta = np.zeros(len(lags)), np.zeros(ma)
    if len(z) > most + len(lags) + ma + 1 and (len(lags) or ma):
        if len(lags):
            past = np.stack([z[most - k : len(z) - k] for k in lags], 1)
            phi = np.linalg.lstsq(past, z[most:], rcond=None)[0]
        if ma:
            cost = lambda p: float((_residuals(z, p[: len(lags)], np.clip(p[len(lags) :], -0.99, 0.99), lags) ** 2).sum())
            best = simplex(cost, np.concatenate([phi, theta]))
            phi, theta = best[: len(lags)], np.clip(best[len(lags) :], -0.99, 0.99)
    e = _residuals(z, phi, theta, lags)
    sigma = float(np.sqrt((e**2).mean())) if len(e) else 0.0
    state = {
        "phi": phi if len(phi) else np.zeros(1), "theta": theta if ma else np.zeros(1), "mean": np.array([mean]), "lags": lags.astype(float), "ma": np.array([ma]), "sigma": np.array([sigma]),
        "past": z[-most:] if most else z[:0], "shocks": e[-ma:] if ma else e[:0], "orders": np.array([d, sd, period]), "tails": np.concatenate([*tails, np.empty(0)]), "seasonal_tails": np.concatenate([*seasonal_tails, np.empty(0)]),
    }
    values, spread = roll(state, horizon)
    return {"path": values, "spread": spread} | state


def roll(state: dict[str, np.ndarray], horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """The next ``horizon`` values of a fitted ARIMA model and their standard errors."""
    state = {k: np.asarray(v, float) for k, v in state.items()}
    lags, ma, mean = state["lags"].astype(int), int(state["ma"][0]), state["mean"][0]
    d, sd, period = state["orders"].astype(int)
    phi, theta = state["phi"][: len(lags)], state["theta"][:ma]
    tails, seasonal_tails = np.split(state["tails"], d) if d else [], np.split(state["seasonal_tails"], sd) if sd else []
    past, shocks, path = list(state["past"]), list(state["shocks"]), []
    for _ in range(horizon):
        v = sum(f * (past[-k] if k <= len(past) else 0.0) for f, k in zip(phi, lags, strict=True))
        v += sum(theta[j] * (shocks[-1 - j] if j < len(shocks) else 0.0) for j in range(ma))
        past.append(v)
        shocks.append(0.0)
        path.append(v + mean)
    # weights of past shocks; a difference sums them
    psi = np.zeros(horizon)
    psi[0] = 1.0
    for i in range(1, horizon):
        psi[i] = (theta[i - 1] if i <= ma else 0.0) + sum(f * psi[i - k] for f, k in zip(phi, lags, strict=True) if k <= i)
    for _ in range(d):
        psi = np.cumsum(psi)
    values = undo(undo(np.array(path), tails), seasonal_tails, period)
    return values, state["sigma"][0] * np.sqrt(np.cumsum(psi**2))


def fit_ets(y: np.ndarray, period: int = 1) -> dict[str, np.ndarray]:
    """Exponential smoothing whose trend (none, straight, damped) and season are
    chosen by AIC."""
    best = None
    for trend, damped in ((False, False), (True, False), (True, True)):
        for p, mult in {(1, False), (period, False), (period, bool((y > 0).all()))}:
            found = fit_holt_winters(y, p, trend, mult, damped)
            k = 2 + trend + damped + (p + 1 if p > 1 else 0)
            score = len(y) * np.log(max(found["sse"][0], 1e-12) / max(len(y), 1)) + 2 * k
            if best is None or (score, p, trend, damped) < best[0]:
                best = ((score, p, trend, damped), found)
    return best[1]


def fit_auto_arima(y: np.ndarray, period: int = 1, most: int = 3, horizon: int = HORIZON) -> dict[str, np.ndarray]:
    """ARIMA whose orders are chosen: differences while they lower the spread,
    then the autoregressive and moving-average orders by corrected AIC."""
    d, sd, z = 0, 0, y.astype(float)
    if period > 1 and len(y) > 3 * period and (z[period:] - z[:-period]).std() < 0.9 * z.std():
        sd, z = 1, z[period:] - z[:-period]
    while d < 2 and len(z) > 4 and np.diff(z).std() < z.std():
        d, z = d + 1, np.diff(z)
    best = None
    for ar in range(most + 1):
        for ma in range(most + 1 - ar):
            found = fit_arima(y, ar, d, ma, period, 0, sd, horizon)
            n, k = len(z) - ar, ar + ma + 2
            if n <= k + 1:
                continue
            score = n * np.log(max(found["sigma"][0] ** 2, 1e-12)) + 2 * k * n / (n - k - 1)
            if best is None or (score, ar + ma, ar) < best[0]:
                best = ((score, ar + ma, ar), found)
    return best[1] if best else fit_arima(y, 0, d, 0, period, 0, sd, horizon)


def fit(algorithm: str, y: np.ndarray, options: dict[str, float]) -> dict[str, np.ndarray]:
    if not len(y):
        raise ValueError("the training set is empty")
    if algorithm == "hwmodel":
        weights = (options["alpha"], options["beta"], options["gamma"]) if "alpha" in options else None
        return fit_holt_winters(y, int(options.get("period", 1)), bool(options.get("trend", True)), bool(options.get("multiplicative", False)), bool(options.get("damped", False)), weights)
    if algorithm == "armodel":
        if options.get("multiplicative"):
            raise NotImplementedError("multiplicative seasonal models can't forecast")
        return fit_arima(y, **{k: int(v) for k, v in options.items() if k != "multiplicative"})
    if algorithm == "auto.arima":
        return fit_auto_arima(y, int(options.get("period", 1)))
    if algorithm == "gnur":
        return fit_ets(y, int(options.get("period", 1)))
    raise ValueError(f"unknown algorithm {algorithm!r}")
