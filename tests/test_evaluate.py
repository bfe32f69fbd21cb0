"""Worked examples with known answers."""

import math
from datetime import timedelta

import numpy as np
import pytest
from frames import at
from pyspark.sql import functions as F

from cityflux.operators import evaluate as e

START = at("2023-01-02 00:00")


def frame(spark, ddl, rows):
    return spark.createDataFrame([tuple(r) for r in rows], ddl)


def test_forecast_errors(spark):
    df = frame(spark, "pickups bigint, forecast double",
               [(100, 90.0), (140, 100.0), (160, 110.0), (120, 105.0)])
    got = e.forecast_errors(df).head()
    assert (got.n, got.mae, got.bias) == (4, 28.75, -28.75)
    assert round(got.mape * 100, 1) == 20.6
    errors = [2, -1, 3, 0, -4, 1, 2, -2, 5, -1]
    df = frame(spark, "pickups double, forecast double", [(10.0, 10.0 + x) for x in errors])
    got = e.forecast_errors(df).head()
    assert got.mae == pytest.approx(2.1) and round(got.rmse, 2) == 2.55


def weekly_panel(spark, weeks):
    return spark.range(weeks * 168).select(
        F.lit(1).cast("long").alias("zone_id"),
        (F.lit(START).cast("timestamp_ntz") + F.expr("make_dt_interval(0, id)")).alias("ts"),
        (F.col("id") % 168 + F.floor(F.col("id") / 168)).alias("pickups"),
    )


def test_seasonal_naive_and_folds(spark):
    panel = e.seasonal_naive(weekly_panel(spark, 6))
    assert panel.where("forecast IS NULL").count() == 168
    assert panel.where("forecast = pickups - 1").count() == 5 * 168
    folds = e.backtest_folds(panel).orderBy("fold").collect()
    assert [f.fold for f in folds] == [1, 2, 3]
    assert folds[0].train_rows == 3 * 168 and folds[0].test_mae == 1.0
    assert folds[0].test_start == START + timedelta(weeks=3)
    assert folds[0].train_end == START + timedelta(weeks=3, hours=-1)
    assert all(f.leak_free and f.train_start == START for f in folds)
    e.check_folds(e.backtest_folds(panel))
    with pytest.raises(e.LeakageError):
        e.check_folds(e.backtest_folds(panel).withColumn("train_end", F.col("test_start")))


def test_coverage_report(spark):
    def report(hits, n, nominal):
        df = spark.range(n).select(
            F.when(F.col("id") < hits, 1.0).otherwise(9.0).alias("y"),
            F.lit(0.0).alias("lower"),
            F.lit(2.0).alias("upper"),
        )
        return e.coverage(df, "y", nominal).head()

    got = report(612, 720, 0.8)
    assert got.observed_coverage == 0.85 and got.gap_pp == pytest.approx(5.0) and got.passes
    assert not report(870, 1000, 0.8).passes


def test_conformal_coverage(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a),) for a in rng.normal(0, 3, 999)]
    width = e.conformal_widths(frame(spark, "r double", rows), "r", 0.1).head().half_width
    assert width == sorted(abs(r) for (r,) in rows)[math.ceil(1000 * 0.9) - 1]
    fresh = frame(spark, "y double, forecast double", [(float(a), 0.0) for a in rng.normal(0, 3, 4000)])
    got = e.coverage(e.add_interval(fresh, F.lit(width)), "y", 0.9).head()
    assert got.observed_coverage == pytest.approx(0.9, abs=0.03) and got.passes


def test_thresholds(spark):
    parts = [(0.6, 1, 300), (0.4, 1, 100), (0.1, 1, 100), (0.6, 0, 700), (0.4, 0, 1100), (0.1, 0, 7700)]
    df = frame(spark, "score double, y int, n int", parts).select(
        "score", "y", F.explode(F.sequence(F.lit(1), "n"))
    )
    got = {r.threshold: r for r in e.threshold_sweep(df, "score", "y", [0.5, 0.3]).collect()}
    half = got[0.5]
    assert (half.tp, half.fn, half.fp, half.tn) == (300, 200, 700, 8800)
    assert (half.precision, half.recall, half.cost) == (0.3, 0.6, 1700.0)
    assert half.f1 == pytest.approx(0.4)
    assert got[0.3].cost == 2300.0 and round(got[0.3].precision, 2) == 0.18
    bins = {r.bin: r for r in e.calibration_bins(df, "score", "y").collect()}
    assert bins[4].n == 1200 and bins[4].observed_rate == pytest.approx(100 / 1200)


def test_ab_interval(spark):
    stats = frame(
        spark,
        "n_control bigint, n_treatment bigint, mean_control double, mean_treatment double, "
        "_v0 double, _v1 double",
        [(5000, 5000, 8.0, 6.5, 36.0, 30.25)],
    )
    got = e.interval_from_stats(stats).head()
    assert got.diff == -1.5 and round(got.t, 1) == -13.0
    assert (round(got.ci_low, 2), round(got.ci_high, 2)) == (-1.73, -1.27)


def test_ab_from_rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(8, 6, 400), rng.normal(6.5, 5.5, 300)
    df = frame(spark, "arm int, y double", [(0, float(x)) for x in a] + [(1, float(x)) for x in b])
    got = e.ab_test(df, "arm", "y").head()
    assert got.diff == pytest.approx(b.mean() - a.mean())
    assert got.se == pytest.approx(math.sqrt(a.var(ddof=1) / 400 + b.var(ddof=1) / 300))


def test_power(spark):
    # two values 6 * sqrt(1/2) around the mean have sample variance 36
    step = 6 / math.sqrt(2)
    df = frame(spark, "y double", [(step,), (-step,)])
    assert e.ab_power(df, "y", 0.5).head().n_per_arm == 2258


def test_cuped(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 3000)
    y = 0.6 * x + 0.8 * rng.normal(0, 1, 3000)
    df = frame(spark, "y double, x double", zip(map(float, y), map(float, x)))
    report = e.cuped_report(df, "y", "x").head()
    adjusted = e.cuped(df, "y", "x").agg(F.var_samp("adjusted"), F.avg("adjusted")).head()
    assert adjusted[0] == pytest.approx(report.adjusted_variance)
    assert adjusted[1] == pytest.approx(y.mean())
    assert report.adjusted_variance / report.variance == pytest.approx(0.64, abs=0.04)


def test_peeking_inflates(spark):
    rng = np.random.default_rng(4)
    rows = [(i, START + timedelta(minutes=i), float(v)) for i, v in enumerate(rng.normal(8, 6, 2000))]
    df = frame(spark, "id bigint, ts timestamp_ntz, y double", rows)
    got = e.peeking_inflation(df, ["id"], "y", "ts", replicas=600, looks=10, seed=1).head()
    assert got.replicas == 600
    assert got.single_rate == pytest.approx(0.05, abs=0.03)
    assert got.peeking_rate == pytest.approx(0.19, abs=0.05)
    again = e.peeking_inflation(df.repartition(7), ["id"], "y", "ts", 600, 10, 1).head()
    assert again == got


def test_off_policy(spark):
    rows = [("A", 100.0), ("B", 80.0), ("A", 120.0), ("A", 90.0), ("B", 110.0)]
    df = frame(spark, "a string, r double", rows).select(
        F.lit(0.5).alias("b"),
        F.when(F.col("a") == "A", 0.8).otherwise(0.2).alias("pi"),
        "r",
        F.when(F.col("a") == "A", 105.0).otherwise(95.0).alias("q"),
        F.lit(103.0).alias("v"),
    )
    got = e.off_policy_value(df, "b", "pi", "r", "q", "v").head()
    assert (round(got.ips, 1), round(got.snips, 1), round(got.doubly_robust, 1)) == (114.4, 102.1, 101.4)
    assert got.logged_mean == 100.0


def test_bootstrap(spark):
    rng = np.random.default_rng(6)
    values = rng.normal(10, 2, 1500)
    df = frame(spark, "id bigint, y double", [(i, float(v)) for i, v in enumerate(values)])
    got = e.bootstrap_mean(df, ["id"], "y", replicas=400, seed=2).head()
    se = values.std(ddof=1) / math.sqrt(len(values))
    assert got.mean == pytest.approx(values.mean(), abs=0.2 * se)
    assert got.ci_high - got.ci_low == pytest.approx(2 * 1.96 * se, rel=0.2)
    assert e.bootstrap_mean(df.repartition(6), ["id"], "y", 400, 2).head() == pytest.approx(got)


def test_psi(spark):
    parts = [("none", 1, 80), ("light", 1, 15), ("heavy", 1, 5),
             ("none", 0, 60), ("light", 0, 25), ("heavy", 0, 15)]
    df = frame(spark, "b string, ref int, n int", parts).select(
        "b", "ref", F.explode(F.sequence(F.lit(1), "n"))
    )
    got = e.psi(df, "b", F.col("ref") == 1).head()
    assert round(got.psi, 4) == 0.2185 and got["shift"] == "moderate" and got.bins == 3


def test_latency(spark):
    times = [12, 13, 13, 14, 15, 15, 16, 17, 18, 19, 20, 21, 22, 24, 27, 30, 35, 42, 55, 98]
    got = e.latency_percentiles(frame(spark, "ms double", [(float(t),) for t in times]), "ms").head()
    assert (got.p50, got.p99) == (19.5, 98.0)


def test_training_set(spark):
    rows = [(1, 5, None, 1.0), (1, 6, 2.0, 1.0)]
    df = frame(spark, "zone_id bigint, pickups bigint, lag_1h double, lag_24h double", rows)
    got = e.training_set(df, ["lag_1h", "lag_24h"])
    assert got.columns == ["zone_id", "lag_1h", "lag_24h", "pickups"] and got.count() == 1


def test_weather(spark):
    panel = frame(spark, "zone_id bigint, ts timestamp_ntz, pickups bigint",
                  [(1, START + timedelta(hours=h), h) for h in range(3)])
    weather = frame(spark, "ts timestamp_ntz, precip double",
                    [(START + timedelta(hours=2, minutes=10), 1.0), (START + timedelta(hours=2), 3.0)])
    got = {r.pickups: (r.precip, r.precip_x_hour) for r in e.join_weather(panel, weather).collect()}
    assert got == {0: (None, None), 1: (None, None), 2: (2.0, 4.0)}
