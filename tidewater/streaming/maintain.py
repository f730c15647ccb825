"""Keeping models fresh as rows arrive.

A policy takes one value at a time for its key, compares it with the model's
forecast and decides when to estimate anew, from all values so far.  The same
code runs over a batch (replay) and over a stream, with state by key.  A model's
state has the same size however many values it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.forecast.graph import smape


@dataclass
class Model:
    """A mean with its sums, its error window and counters; ``carry`` is what
    rounding took from ``total``."""

    total: float = 0.0
    carry: float = 0.0
    n: int = 0
    base: float = 0.0
    since: int = 0
    reference: float = 0.0
    estimates: int = 0
    limit: int = 0
    errors: list[float] = field(default_factory=list)

    def guess(self) -> float:
        return self.base


def update(m: Model, y: float, policy: str, window: int = 10, alpha: float = 0.5, every: int = -1) -> float:
    """One value: returns the error of the forecast made before it.

    ``empty`` only records errors; ``simple`` estimates anew when the mean
    error over the window exceeds the reference by 5 % / alpha, or after so many
    values: ``every``, or else a number that starts with the window, is halved
    (not below the window) when the error fell since the last time, and doubled
    when it didn't.
    """
    error = smape(y, m.guess()) if m.n else 0.0
    m.errors = [*m.errors, error][-window:]
    total = m.total + y
    m.carry += (m.total - total) + y if abs(m.total) >= abs(y) else (y - total) + m.total
    m.total, m.n, m.since = total, m.n + 1, m.since + 1
    mean = sum(m.errors) / len(m.errors)
    due = m.n == 1
    if policy == "simple":
        due |= m.since >= window and mean > m.reference * (1 + 0.05 / alpha)
        m.limit = every if every > 0 else (m.limit or window)
        if m.since >= m.limit:
            if every <= 0:
                m.limit = max(m.limit // 2, window) if mean < m.reference else m.limit * 2
            due = True
    if due:
        m.base = (m.total + m.carry) / m.n
        m.reference, m.since, m.estimates = mean, 0, m.estimates + 1
    return error


SCHEMA = "key string, n bigint, estimates bigint, forecast double, mean_error double"
STATE = "total double, carry double, n bigint, base double, since bigint, reference double, estimates bigint, limit bigint, errors array<double>"


def _row(key: str, m: Model, errors: float) -> pd.DataFrame:
    return pd.DataFrame([{"key": key, "n": m.n, "estimates": m.estimates, "forecast": m.guess(), "mean_error": errors}])


def replay(df: DataFrame, key: str, time: str, tie: str, value: str, policy: str = "simple", **options: float) -> DataFrame:
    """The state of each key after all rows in the order of time.  A key's rows
    pass through one task, as each forecast needs those before, but batch by
    batch: the task holds no more than a batch and one model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, key, total = Model(), None, 0.0
        for pdf in batches:
            for k, y in zip(pdf["key"], pdf["y"], strict=True):
                if m.n and k != key:
                    yield _row(key, m, total / m.n)
                    m, total = Model(), 0.0
                key = k
                total += update(m, float(y), policy, **options)
        if m.n:
            yield _row(key, m, total / m.n)

    rows = df.selectExpr(f"cast({key} as string) key", f"{time} t", f"{tie} tie", f"cast({value} as double) y").na.drop(subset=["y"])
    ordered = rows.repartition("key").sortWithinPartitions("key", F.col("t").asc_nulls_last(), F.col("tie").asc_nulls_last())
    return ordered.select("key", "y").mapInPandas(run, SCHEMA)


def maintain(stream: DataFrame, key: str, time: str, tie: str, value: str, policy: str = "simple", **options: float) -> DataFrame:
    """The same over a stream: each micro-batch updates the keys it holds."""

    def run(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Model(*state.get) if state.exists else Model()
        m.errors = list(m.errors)
        pdf = pd.concat(parts).sort_values(["t", "tie"])
        for y in pdf["y"]:
            update(m, float(y), policy, **options)
        state.update(tuple(asdict(m).values()))
        yield _row(names[0], m, sum(m.errors) / len(m.errors))

    rows = stream.selectExpr(f"cast({key} as string) key", f"{time} t", f"{tie} tie", f"cast({value} as double) y").na.drop(subset=["y"])
    return rows.groupBy("key").applyInPandasWithState(run, SCHEMA, STATE, "update", GroupStateTimeout.NoTimeout)


@dataclass
class ArModel:
    """An autoregressive model kept fresh on demand.  ``gram`` and ``cross`` are
    the sums of its normal equations over all values, so a new estimate uses all
    of them; each neighbour is the model with one coefficient moved by ``step``."""

    order: int
    phi: np.ndarray
    past: list[float]
    gram: np.ndarray
    cross: np.ndarray
    squares: np.ndarray
    n: int = 0
    estimates: int = 0

    @classmethod
    def new(cls, order: int) -> ArModel:
        return cls(order, np.zeros(order + 1), [], np.zeros((order + 1, order + 1)), np.zeros(order + 1), np.zeros(2 * order + 3))

    def estimate(self) -> None:
        self.phi = np.linalg.solve(self.gram + 1e-9 * np.eye(self.order + 1), self.cross)
        self.squares = np.zeros_like(self.squares)
        self.estimates += 1


def update_ar(m: ArModel, y: float, step: float = 0.05, barrier: float = 0.01, warm: int = 20) -> float | None:
    """One value: the forecast's error, or None before there is one.  Estimates
    anew when a neighbour's squared errors undercut the model's by ``barrier``."""
    error = None
    if len(m.past) == m.order:
        x = np.array([1.0, *m.past[::-1]])
        if m.estimates:
            moves = step * np.eye(m.order + 1)
            neighbours = np.vstack([m.phi, m.phi + moves, m.phi - moves])
            off = y - neighbours @ x
            m.squares += off**2
            error = float(off[0])
        m.gram += np.outer(x, x)
        m.cross += x * y
        m.n += 1
        if (not m.estimates and m.n >= warm) or (m.estimates and m.squares[1:].min() < m.squares[0] * (1 - barrier) and m.n % warm == 0):
            m.estimate()
    m.past = [*m.past, y][-m.order :]
    return error


def replay_ar(df: DataFrame, key: str, time: str, tie: str, value: str, order: int = 2, **options: float) -> DataFrame:
    """key, n, estimates, forecast and the mean squared error of each key after
    all rows in the order of time; batch by batch, as ``replay``."""

    def row(key: str, m: ArModel, errors: list[float]) -> pd.DataFrame:
        known = bool(m.estimates) and len(m.past) == m.order
        guess = float(m.phi @ np.array([1.0, *m.past[::-1]])) if known else None
        return pd.DataFrame([{"key": key, "n": m.n, "estimates": m.estimates, "forecast": guess, "mean_error": errors[0] / errors[1] if errors[1] else None}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, key, errors = None, None, [0.0, 0]
        for pdf in batches:
            for k, y in zip(pdf["key"], pdf["y"], strict=True):
                if m is None or k != key:
                    if m is not None:
                        yield row(key, m, errors)
                    m, key, errors = ArModel.new(order), k, [0.0, 0]
                off = update_ar(m, float(y), **options)
                if off is not None:
                    errors = [errors[0] + off * off, errors[1] + 1]
        if m is not None:
            yield row(key, m, errors)

    rows = df.selectExpr(f"cast({key} as string) key", f"{time} t", f"{tie} tie", f"cast({value} as double) y").na.drop(subset=["y"])
    ordered = rows.repartition("key").sortWithinPartitions("key", F.col("t").asc_nulls_last(), F.col("tie").asc_nulls_last())
    return ordered.select("key", "y").mapInPandas(run, SCHEMA)
