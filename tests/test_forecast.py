"""Forecast operators against numpy and against their own rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.approx import segment
from tidewater.forecast import graph, models, numeric
from tidewater.forecast.decompose import decompose
from tidewater.forecast.series import check_equidistant, number
from tidewater.operators import joins, ordering, recursion
from tidewater.streaming import maintain


def frame(spark, values, start="2020-01-31"):
    rows = [(pd.Timestamp(start).date() + pd.Timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return number(spark.createDataFrame([(t, v) for t, v in rows], "t date, y double"), [])


def test_linreg_beyond_1024_rows(spark):
    made = models.train(frame(spark, [3 + 2 * i for i in range(1, 1501)]), [], "linreg")
    assert models.forecast(made, 2, "day").orderBy("h").collect()[1]["value"] == pytest.approx(3 + 2 * 1502)


def test_one_row_and_constant_series(spark):
    for values in ([5.0], [5.0] * 4):
        for name in ("medium", "linreg", "ses", "hwmodel", "armodel"):
            made = models.train(frame(spark, values), [], name)
            assert models.forecast(made, 1, "day").first()["value"] == pytest.approx(5.0)


def test_integer_measure_and_early_target(spark):
    made = models.train(frame(spark, [1, 2]), [], "medium")
    assert models.forecast(made, 1, "day", "int").first()["value"] == 1
    with pytest.raises(Exception, match="behind"):
        models.forecast_until(made, "2019-01-01", "day").collect()


def test_gaps_are_an_error(spark):
    gappy = number(spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-03", 1.0)], "t string, y double").withColumn("t", F.col("t").cast("date")), [])
    with pytest.raises(Exception, match="gaps"):
        check_equidistant(gappy, [], "day").collect()


def test_month_ends_clamp_step_by_step(spark):
    made = models.train(frame(spark, [1.0]), [], "medium")
    assert [str(r["t"]) for r in models.forecast(made, 2).orderBy("h").collect()] == ["2020-02-29", "2020-03-29"]


def test_smape_cases(spark):
    cases = [(0.0, 0.0, 0.0), (0.0, -1.0, 1.0), (2.0, -1.0, 0.0), (1.0, 3.0, 0.5)]
    got = spark.createDataFrame(cases, "x double, g double, want double").select(models.smape(F.col("x"), F.col("g")).alias("e"), "want").collect()
    assert all(r["e"] == r["want"] for r in got)
    assert all(graph.smape(x, g) == w for x, g, w in cases)


@pytest.mark.parametrize("window", [3, 4])
def test_decompose_equals_direct_rule(spark, window):
    y = np.array([3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8])
    wide = window if window % 2 else window + 1
    k = wide // 2
    w = np.ones(wide)
    if window % 2 == 0:
        w[[0, -1]] = 0.5
    trend = np.full(len(y), np.nan)
    for i in range(k, len(y) - k):
        trend[i] = (w * y[i - k : i + k + 1]).sum() / wide
    trend[:k], trend[len(y) - k :] = trend[k], trend[len(y) - k - 1]
    season = np.array([(y - trend)[i % 3 :: 3].mean() for i in range(len(y))])
    got = decompose(frame(spark, y), [], window, 3).orderBy("x").toPandas()
    assert np.allclose(got["trend"], trend) and np.allclose(got["season"], season) and np.allclose(got["rest"], y - trend - season)


def test_arima_recovers_coefficients():
    rng = np.random.default_rng(1)
    y = np.zeros(3000)
    e = rng.normal(size=3000)
    for i in range(1, 3000):
        y[i] = 0.6 * y[i - 1] + e[i] + 0.4 * e[i - 1]
    found = numeric.fit_arima(y + 10, ar=1, ma=1)
    assert found["phi"][0] == pytest.approx(0.6, abs=0.08) and found["theta"][0] == pytest.approx(0.4, abs=0.08)
    assert found["spread"][0] == pytest.approx(1, abs=0.1)


def test_arima_undoes_differences():
    y = np.arange(40.0) * 3 + np.tile([0, 5, -5, 1], 10)
    found = numeric.fit_arima(y, ar=0, d=1, sd=1, period=4, horizon=8)
    want = np.arange(40.0, 48) * 3 + np.tile([0, 5, -5, 1], 2)
    assert np.allclose(found["path"], want)


def test_holt_winters_follows_season():
    y = 10 + np.arange(48.0) + np.tile([4.0, -2, 0, -2], 12)
    state = numeric.fit_holt_winters(y, 4)
    want = 10 + np.arange(48.0, 52) + np.array([4.0, -2, 0, -2])
    got = state["level"][0] + state["trend"][0] * np.arange(1, 5) + state["season"]
    assert np.abs(got - want).max() < 0.5


def test_greedy_never_raises_the_objective(spark, sf):
    from tidewater.plans.models import _DIMS, _graph

    errors = graph.rolling_errors(_graph(spark, sf), _DIMS, held=3).toPandas()
    chosen, path = graph.greedy(errors, _DIMS, alpha=0.9)
    assert chosen[0] == ("*", "*") and all(b < a for a, b in zip(path, path[1:], strict=False))


def test_scan_error_on_a_line(spark):
    s = frame(spark, [2.0 * i for i in range(64)])
    got = segment.scan(segment.build(s, [], layers=3), [], error=0.01).toPandas()
    assert (got["layer"] == 0).all() and np.allclose(got.sort_values("p")["value"], 2.0 * np.arange(64))


def test_stream_ends_like_replay(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").filter("user_id < 8")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = maintain.maintain(stream, "user_id", "ts", "event_id", "value").writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {r["key"]: (r["n"], r["estimates"], r["forecast"]) for r in maintain.replay(events, "user_id", "ts", "event_id", "value").collect()}
    assert {r["key"]: (r["n"], r["estimates"], r["forecast"]) for r in spark.table("kept").collect()} == want


def test_reestimation_uses_all_values_of_a_hot_key(spark):
    value = lambda i: float(i * 37 % 1000 if i < 900 else 5000 + i)
    rows = [("hot", i, i, value(i)) for i in range(1200)] + [("b", i, i, 2.0) for i in range(3)] + [(None, 1, 1, 7.0)]
    df = spark.createDataFrame(rows, "k string, t long, e long, v double").repartition(3)
    got = {r["key"]: r for r in maintain.replay(df, "k", "t", "e", "v", policy="simple", every=400).collect()}
    # the policy again, from its definition, with all rows kept
    seen, errors, since, ref, base, times = [], [], 0, 0.0, 0.0, 0
    for y in map(value, range(1200)):
        errors = [*errors, maintain.smape(y, base) if seen else 0.0][-10:]
        seen, since, mean = [*seen, y], since + 1, sum(errors) / len(errors)
        if len(seen) == 1 or (since >= 10 and mean > ref * 1.1) or since >= 400:
            base, ref, since, times = sum(seen) / len(seen), mean, 0, times + 1
    assert set(got) == {"hot", "b", None} and got[None]["forecast"] == 7.0 and got["b"]["n"] == 3
    assert (got["hot"]["n"], got["hot"]["estimates"]) == (1200, times) and abs(got["hot"]["forecast"] - base) < 1e-9 * base


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (None,)], "b int")
    assert joins.not_in(left, "a", right, "b").count() == 0
    assert [r["a"] for r in joins.not_in(left, "a", right.na.drop(), "b").collect()] == [2]
    assert joins.not_in(left, "a", right.filter("b > 5"), "b").count() == 3


def test_scalar_subquery_of_two_rows(spark):
    with pytest.raises(Exception, match="more than one row"):
        joins.scalar(spark.range(1), spark.range(2).toDF("v")).collect()


def test_union_of_rounds_ends_on_cycles_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, None)], "f int, t int")
    seed = spark.createDataFrame([(1,)], "k int")
    got = recursion.recursive_union(seed, lambda r: r.join(edges, F.col("f") == F.col("k")).select(F.col("t").alias("k")))
    assert sorted((r["k"] or 0) for r in got.collect()) == [0, 1, 2]


def test_connect_by_finds_loops(spark):
    loop = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c")], "k string, p string")
    with pytest.raises(Exception, match="infinite recursion"):
        recursion.connect_by(loop, "k", "p", "a").collect()


def test_numbered_is_one_to_n(spark):
    rows = spark.range(0, 5000, numPartitions=7).withColumn("v", F.col("id") * 7919 % 5000)
    got = ordering.numbered(rows, ["-v"]).select((F.col("rn") + F.col("v")).alias("s")).distinct().collect()
    assert [r["s"] for r in got] == [5000]


def test_running_sum_spreads_over_tasks(spark, sf):
    from tidewater.registry import QUERIES

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len({r["p"] for r in QUERIES["win_agg_over_agg"](spark, sf).withColumn("p", F.spark_partition_id()).collect()}) > 1
        data = [(i // 3 if i % 50 else None, None if i % 7 == 0 or i < 9 else i) for i in range(2000)]
        got = ordering.running_sum(spark.createDataFrame(data, "k int, v long"), ["k"], "v", "r", "t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, peers = {}, {}
    for k, v in data:
        peers.setdefault(k, []).append(v)
    so_far = None
    for k in sorted(peers, key=lambda k: (k is None, k)):
        kept = [v for v in peers[k] if v is not None]
        so_far = (so_far or 0) + sum(kept) if kept else so_far
        sums[k] = so_far
    assert len(got) == 2000 and all(row["r"] == sums[row["k"]] and row["t"] == so_far for row in got)


def test_user_aggregate_holds_no_whole_group(spark, sf, monkeypatch):
    from tidewater.operators import aggregates
    from tidewater.registry import QUERIES

    plan = QUERIES["user_aggregate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 3 and "_chunk" in plan  # rows are listed by chunk, then only states
    monkeypatch.setattr(aggregates, "CHUNK", 16)
    rows = spark.createDataFrame([("hot", float(i)) for i in range(3000)] + [("b", 2.0), (None, 3.0)], "k string, v double").repartition(5)
    got = aggregates.merged_aggregate(rows, ["k"], F.col("v"), "n", F.lit(0.0), lambda a, x: a + x * x, lambda a, b: a + b, F.sqrt)
    want = {"hot": sum(i * i for i in range(3000)) ** 0.5, "b": 2.0, None: 3.0}
    assert {r["k"]: round(r["n"], 6) for r in got.collect()} == {k: round(v, 6) for k, v in want.items()}


def test_arima_and_target_beyond_the_stored_horizon(spark):
    y = np.cumsum(np.sin(np.arange(80.0)) + 1)
    made = models.train(frame(spark, y), [], "arima", ar=2, d=1, ma=1)
    got = models.forecast(made, 150, "day").orderBy("h").toPandas()
    want = numeric.fit_arima(y, ar=2, d=1, ma=1, horizon=150)
    assert np.allclose(got["value"], want["path"]) and np.allclose(got["spread"], want["spread"])
    until = models.forecast_until(made, "2021-01-01", "day").orderBy("h").toPandas()
    assert len(until) > 200 and np.allclose(until["value"][:150], want["path"])
    with pytest.raises(Exception, match="steps ahead"):
        models.forecast_until(made, "2021-01-01", "day", most=100).collect()


def test_minimax_line_equals_brute_force():
    import numpy as np

    from tidewater.forecast import smoothers

    rng = np.random.default_rng(0)
    for k in range(200):
        n = int(rng.integers(1, 25))
        y = rng.integers(0, 4, n).astype(float) if k % 3 == 0 else rng.normal(size=n)
        slope, intercept, error = smoothers.minimax_line(y)
        x = np.arange(n)
        slopes = {0.0} | {(y[b] - y[a]) / (b - a) for a in range(n) for b in range(a + 1, n)}
        assert abs(np.abs(y - intercept - slope * x).max() - error) < 1e-9
        assert abs(min(np.ptp(y - s * x) / 2 for s in slopes) - error) < 1e-9


def test_stl_finds_trend_and_season():
    import numpy as np

    from tidewater.forecast import smoothers

    x = np.arange(240)
    trend, season = smoothers.stl(0.3 * x + 10 * np.sin(x / 12 * 2 * np.pi), 12)
    assert np.abs(trend - 0.3 * x)[6:-6].max() < 0.2 and np.abs(season - 10 * np.sin(x / 12 * 2 * np.pi))[6:-6].max() < 0.2


def test_orders_are_chosen_and_trends_damped():
    import numpy as np

    from tidewater.forecast import numeric

    rng = np.random.default_rng(3)
    e = rng.normal(size=600)
    y = np.zeros(600)
    for i in range(2, 600):
        y[i] = 0.6 * y[i - 1] - 0.3 * y[i - 2] + e[i]
    found = numeric.fit_auto_arima(y)
    assert found["orders"][0] == 0 and len(found["phi"]) + found["ma"][0] >= 1 and found["sigma"][0] < 1.1
    assert numeric.fit_auto_arima(np.cumsum(np.cumsum(e)))["orders"][0] >= 1
    flat = numeric.fit_ets(100 - 50 * 0.9 ** np.arange(80))
    assert flat["damping"][0] < 1


def test_star_is_a_value_of_its_own(spark):
    import datetime

    from tidewater.forecast import graph

    rows = [(v, datetime.date(2024, m, 1), 1.0) for v in ("*", "?", None, "a", "\\") for m in (1, 2, 3)]
    df = spark.createDataFrame(rows, "d string, t date, y double")
    nodes = graph.nodes(df, ["d"], df.t, df.y).collect()
    assert {r.d for r in nodes} == {"*", "\\*", "?", "\\?", "a", "\\\\"}
    assert all(r.y == (5.0 if r.d == "*" else 1.0) for r in nodes) and max(r.x for r in nodes) == 3


def test_names_in_the_catalog_are_single(spark, tmp_path):
    import datetime

    from pyspark.sql import functions as F
    from tidewater.forecast import catalog, models

    s = spark.createDataFrame([(datetime.date(2024, m, 1), float(m), m) for m in range(1, 7)], "t date, y double, x int")
    told = lambda name=None, **o: catalog.describe(models.train(s, [], "ses", **o), "a", "t", "y", "month", "sum", options=o, name=name)
    path = str(tmp_path / "models")
    catalog.store(told(alpha=0.5), path)
    with pytest.raises(ValueError):
        catalog.store(told(alpha=0.5), path)
    catalog.store(told("other", alpha=0.9), path)
    found = catalog.match(catalog.restore(spark, path), "a", "t", "y", "month", "sum", options={"alpha": 0.9})
    assert [r["name"] for r in found.select(F.col("name")).collect()] == ["other"]


def test_upkeep_widens_and_narrows_its_interval():
    from tidewater.streaming.maintain import Model, update

    m, seen = Model(), []
    for i in range(200):
        update(m, 10.0 + (i % 2), "simple")
        seen.append(m.limit)
    assert max(seen) > 10  # an error that doesn't fall: less often


def test_autoregression_is_kept_on_demand(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    y = [0.0]
    for i in range(600):
        y.append((0.8 if i < 300 else -0.8) * y[-1] + rng.normal())
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(y)], "k int, t int, e int, v double")
    got = maintain.replay_ar(df, "k", "t", "e", "v", order=1).first()
    assert got.estimates >= 2 and got.n == 600 and got.mean_error < 4


def test_appended_parts_are_scanned_behind_the_first(spark):
    from pyspark.sql import functions as F
    from tidewater.approx import segment

    s = spark.range(1, 81).select(F.lit("a").alias("k"), F.col("id").alias("x"), (F.col("id") * 2.0).alias("y"))
    nodes = segment.append(segment.build(s.filter("x <= 60"), ["k"], 2), ["k"], s.filter("x > 60"), 2)
    got = {r.p: r.value for r in segment.scan_parts(nodes, ["k"], 1).collect()}
    assert got == pytest.approx({i: 2.0 * (i + 1) for i in range(80)})
