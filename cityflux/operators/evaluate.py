"""Forecast, classifier, experiment and drift evaluation as aggregations.

Each operator is one pass of algebraic aggregates; replicated ones hash each row
once and combine per replicate before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import LAG_HOURS
from ..functions import clock
from ..functions.numbers import REPLICA_PRIME, ratio, replica_draw, replica_words
from .ranks import exact_quantiles, global_quantiles

WEEK_HOURS = 168
Z_95 = 1.96  # two-sided 5 % (fixed value)
Z_80 = 0.84  # 80 % power (fixed value)


class LeakageError(RuntimeError):
    """A fold trains on data that is not strictly before its test window."""


# ---- forecasts -----------------------------------------------------------------


def seasonal_naive(
    panel: DataFrame, season: int = WEEK_HOURS, key: str = "zone_id", ts: str = "ts",
    value: str = "pickups",
) -> DataFrame:
    """Forecast = value one season earlier on the dense panel; null in the first one."""
    order = Window.partitionBy(key).orderBy(ts)
    return panel.withColumn("forecast", F.lag(value, season).over(order).cast("double"))


def _error_aggregates(actual: str, forecast: str) -> list[Column]:
    a, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    e = f - a
    return [
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(a != 0, F.abs(e) / F.abs(a))).alias("mape"),
        F.avg(e).alias("bias"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    ]


def forecast_errors(
    df: DataFrame, actual: str = "pickups", forecast: str = "forecast", by: Sequence[str] = ()
) -> DataFrame:
    """MAE, MAPE (over non-zero actuals), bias and RMSE, in all or per group."""
    aggregates = _error_aggregates(actual, forecast)
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def backtest_folds(
    panel: DataFrame, ts: str = "ts", min_train_weeks: int = 3, actual: str = "pickups",
    forecast: str = "forecast",
) -> DataFrame:
    """Expanding weekly folds: train on all weeks before, test on one whole week.

    Only weekly totals meet the fold windows (one row per week), so rows are not
    repeated per fold.
    """
    start = panel.agg(F.min(ts)).scalar()
    hours = F.floor((clock.seconds(F.col(ts)) - clock.seconds(F.col("_start"))) / 3600)
    a, f = F.col(actual).cast("double"), F.col(forecast)
    weekly = (
        panel.withColumn("_start", start)
        .withColumn("_week", F.floor(hours / WEEK_HOURS).cast("long"))
        .groupBy("_week")
        .agg(
            F.min(ts).alias("test_start"),
            F.max(ts).alias("test_end"),
            F.count(F.lit(1)).alias("test_rows"),
            F.count_distinct(hours).alias("_hours"),
            F.avg(F.abs(f - a)).alias("test_mae"),
        )
    )
    past = Window.orderBy("_week").rowsBetween(Window.unboundedPreceding, -1)
    return (
        weekly.withColumns(
            {
                "train_start": F.min("test_start").over(past),
                "train_end": F.max("test_end").over(past),
                "train_rows": F.sum("test_rows").over(past),
            }
        )
        .where((F.col("_week") >= min_train_weeks) & (F.col("_hours") == WEEK_HOURS))
        .select(
            (F.col("_week") - min_train_weeks + 1).alias("fold"),
            "train_start",
            "train_end",
            "train_rows",
            "test_start",
            "test_end",
            "test_rows",
            "test_mae",
            (F.col("train_end") < F.col("test_start")).alias("leak_free"),
        )
    )


def check_folds(folds: DataFrame) -> DataFrame:
    """Refuse folds (one row each) whose training data reaches into the test window."""
    bad = folds.where(~(F.col("train_end") < F.col("test_start"))).count()
    if bad:
        raise LeakageError(f"{bad} folds train on data from their test window")
    return folds


def conformal_widths(
    residuals: DataFrame, residual: str, alpha: float, by: Sequence[str] = ()
) -> DataFrame:
    """Split-conformal half width: the ceil((n+1)(1-alpha))-th smallest |residual|.

    Null where that rank is beyond ``n``: no finite width has the coverage then.
    """
    scores = residuals.select(*by, F.abs(F.col(residual)).alias("_score"))
    return exact_quantiles(scores, "_score", {"half_width": 1.0 - alpha}, by, "conformal")


def add_interval(df: DataFrame, half_width: Column, point: str = "forecast") -> DataFrame:
    return df.withColumns(
        {"lower": F.col(point) - half_width, "upper": F.col(point) + half_width}
    )


def coverage(df: DataFrame, actual: str, nominal: float, tolerance_pp: float = 5.0) -> DataFrame:
    """Share of actuals inside [lower, upper] against the nominal level."""
    inside = F.col(actual).between(F.col("lower"), F.col("upper")).cast("double")
    return df.agg(F.count(inside).alias("n"), F.avg(inside).alias("observed_coverage")).select(
        "n",
        "observed_coverage",
        ((F.col("observed_coverage") - nominal) * 100.0).alias("gap_pp"),
        (F.round(F.abs(F.col("observed_coverage") - nominal) * 100.0, 9) <= tolerance_pp).alias(
            "passes"
        ),
    )


def training_set(
    features: DataFrame, required: Sequence[str] = tuple(LAG_HOURS), target: str = "pickups"
) -> DataFrame:
    """Rows whose required history is complete: keys, features, target and time."""
    columns = [c for c in features.columns if c != target]
    return features.dropna(subset=list(required)).select(*columns, target)


def join_weather(panel: DataFrame, weather: DataFrame, ts: str = "ts") -> DataFrame:
    """Hourly weather (ts, precip) on the panel, plus ``precip x hour``."""
    hourly = weather.groupBy(clock.hour_floor(F.col("ts")).alias(ts)).agg(
        F.avg("precip").alias("precip")
    )
    return panel.join(hourly, ts, "left").withColumn(
        "precip_x_hour", F.col("precip") * F.hour(ts)
    )


# ---- classifiers ---------------------------------------------------------------


def threshold_sweep(
    df: DataFrame, score: str, label: str, thresholds: Sequence[float],
    miss_cost: float = 5.0, alarm_cost: float = 1.0,
) -> DataFrame:
    """Confusion counts, precision, recall, F1 and cost per threshold, in one pass."""
    s, y = F.col(score), F.col(label) == 1
    aggregates, rows = [], []
    for i, t in enumerate(thresholds):
        hit = s >= F.lit(float(t))
        aggregates += [
            F.count_if(hit & y).alias(f"tp{i}"),
            F.count_if(hit & ~y).alias(f"fp{i}"),
            F.count_if(~hit & y).alias(f"fn{i}"),
            F.count_if(~hit & ~y).alias(f"tn{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn", "tn")],
            )
        )
    table = df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return table.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "cost": fn * F.lit(float(miss_cost)) + fp * F.lit(float(alarm_cost)),
        }
    )


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score against observed rate per score bin."""
    cell = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(cell.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )


# ---- experiments ---------------------------------------------------------------


def ab_test(df: DataFrame, arm: str, metric: str, z: float = Z_95) -> DataFrame:
    """Difference treatment (arm 1) minus control (arm 0), interval and t value."""
    y = F.col(metric).cast("double")
    y0, y1 = F.when(F.col(arm) == 0, y), F.when(F.col(arm) == 1, y)
    stats = df.agg(
        F.count(y0).alias("n_control"),
        F.count(y1).alias("n_treatment"),
        F.avg(y0).alias("mean_control"),
        F.avg(y1).alias("mean_treatment"),
        F.var_samp(y0).alias("_v0"),
        F.var_samp(y1).alias("_v1"),
    )
    return interval_from_stats(stats, z)


def interval_from_stats(stats: DataFrame, z: float = Z_95) -> DataFrame:
    """Same, from per-arm counts, means and sample variances (``_v0``, ``_v1``)."""
    se = F.sqrt(F.col("_v0") / F.col("n_control") + F.col("_v1") / F.col("n_treatment"))
    return (
        stats.withColumn("diff", F.col("mean_treatment") - F.col("mean_control"))
        .withColumn("se", se)
        .withColumn("ci_low", F.col("diff") - z * F.col("se"))
        .withColumn("ci_high", F.col("diff") + z * F.col("se"))
        .withColumn("t", F.try_divide("diff", "se"))
        .drop("_v0", "_v1")
    )


def ab_power(
    df: DataFrame, metric: str, effect: float, by: Sequence[str] = (), z_alpha: float = Z_95,
    z_beta: float = Z_80,
) -> DataFrame:
    """Sample size per arm from the pilot variance, in all or per stratum."""
    variance = F.var_samp(F.col(metric).cast("double")).alias("variance")
    n = F.count(metric).alias("pilot_n")
    stats = df.groupBy(*by).agg(n, variance) if by else df.agg(n, variance)
    need = F.lit((z_alpha + z_beta) ** 2 * 2.0 / effect**2) * F.col("variance")
    return stats.withColumn("n_per_arm", F.ceil(F.round(need, 6)).cast("long"))


def cuped(df: DataFrame, metric: str, covariate: str) -> DataFrame:
    """Rows plus ``adjusted`` = metric - theta * (covariate - mean covariate)."""
    stats = df.agg(
        F.struct(
            F.try_divide(F.covar_samp(metric, covariate), F.var_samp(covariate)).alias("theta"),
            F.avg(covariate).alias("mean_x"),
        )
    ).scalar()
    return (
        df.withColumn("_s", stats)
        .withColumn(
            "adjusted",
            F.col(metric)
            - F.coalesce("_s.theta", F.lit(0.0)) * (F.col(covariate) - F.col("_s.mean_x")),
        )
        .drop("_s")
    )


def cuped_report(df: DataFrame, metric: str, covariate: str) -> DataFrame:
    """Slope, correlation and variance before and after the adjustment, in one pass."""
    return df.agg(
        F.count(metric).alias("n"),
        F.try_divide(F.covar_samp(metric, covariate), F.var_samp(covariate)).alias("theta"),
        F.corr(metric, covariate).alias("rho"),
        F.var_samp(metric).alias("variance"),
    ).withColumn("adjusted_variance", F.col("variance") * (1.0 - F.col("rho") * F.col("rho")))


def _replicated(df: DataFrame, unit: Sequence[str], keep: Sequence[str], seed: int, replicas: int):
    w1, w2 = replica_words(seed, *unit)
    return (
        df.select(*keep, w1.alias("_w1"), w2.alias("_w2"))
        .withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))
        .withColumn("_draw", replica_draw(F.col("_w1"), F.col("_w2"), F.col("replica")))
    )


def peeking_inflation(
    df: DataFrame, unit: Sequence[str], metric: str, ts: str, replicas: int = 200,
    looks: int = 10, seed: int = 0, z: float = Z_95,
) -> DataFrame:
    """False-positive rates of A/A replicates on the given rows.

    Each replicate splits the units at random; looks come at equal steps of time.
    ``peeking_rate`` stops at the first significant look, ``single_rate`` only looks
    at the end.
    """
    span = df.agg(F.struct(F.min(ts).alias("lo"), F.max(ts).alias("hi")).alias("s")).scalar()
    at, lo, hi = (clock.micros(F.col(c)) for c in (ts, "_s.lo", "_s.hi"))
    timed = df.withColumn("_s", span).withColumn(
        "_look",
        F.least(F.floor(ratio((at - lo) * looks, hi - lo)).cast("long") + 1, F.lit(looks)),
    )
    rows = _replicated(timed, unit, [metric, "_look"], seed, replicas)
    y = F.col(metric).cast("double")
    sums = rows.groupBy("replica", "_look", (F.col("_draw") % 2).alias("arm")).agg(
        F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")
    )
    grid = sums.groupBy("replica", "_look").agg(
        *[
            F.sum(F.when(F.col("arm") == a, F.col(c)).otherwise(0)).alias(f"{c}{a}")
            for a in (0, 1)
            for c in ("n", "s", "q")
        ]
    )
    upto = (
        Window.partitionBy("replica")
        .orderBy("_look")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = grid.withColumns(
        {f"{c}{a}": F.sum(f"{c}{a}").over(upto) for a in (0, 1) for c in ("n", "s", "q")}
    )

    def mean(a):
        return F.try_divide(f"s{a}", F.col(f"n{a}").cast("double"))

    def variance_of_mean(a):
        n = F.col(f"n{a}").cast("double")
        spread = F.col(f"q{a}") - F.try_divide(F.col(f"s{a}") * F.col(f"s{a}"), n)
        return F.try_divide(F.try_divide(spread, n - 1), n)

    t = F.try_divide(mean(1) - mean(0), F.sqrt(variance_of_mean(0) + variance_of_mean(1)))
    last = Window.partitionBy("replica")
    return (
        total.withColumn("_hit", F.coalesce(F.abs(t) > z, F.lit(False)))
        .withColumn("_last", F.col("_look") == F.max("_look").over(last))
        .groupBy("replica")
        .agg(
            F.bool_or("_hit").alias("any_hit"),
            F.bool_or(F.col("_hit") & F.col("_last")).alias("last_hit"),
        )
        .agg(
            F.count(F.lit(1)).alias("replicas"),
            F.avg(F.col("last_hit").cast("double")).alias("single_rate"),
            F.avg(F.col("any_hit").cast("double")).alias("peeking_rate"),
        )
    )


def poisson_one_limits() -> list[float]:
    """Cumulative probabilities of a Poisson(1) count, from 0 on, until nothing is left."""
    out, term = [math.exp(-1.0)], math.exp(-1.0)
    while out[-1] + term / len(out) > out[-1]:
        term /= len(out)
        out.append(out[-1] + term)
    return out


def bootstrap_mean(
    df: DataFrame, unit: Sequence[str], metric: str, replicas: int = 200, seed: int = 0,
    level: float = 0.95,
) -> DataFrame:
    """Poisson bootstrap interval of a mean.

    Each row enters each replicate with a Poisson(1) weight, so replicates need no
    row count and combine map-side. The last step sees one row per replicate.
    """
    rows = _replicated(df.where(F.col(metric).isNotNull()), unit, [metric], seed, replicas)
    u = F.col("_draw") / F.lit(float(REPLICA_PRIME))
    weight = sum(
        (F.when(u > limit, 1).otherwise(0) for limit in poisson_one_limits()), F.lit(0)
    ).cast("double")
    means = (
        rows.withColumn("_w", weight)
        .groupBy("replica")
        .agg(F.try_divide(F.sum(F.col("_w") * F.col(metric)), F.sum("_w")).alias("m"))
    )
    tail = (1.0 - level) / 2.0
    return means.agg(
        F.count("m").alias("replicas"),
        F.avg("m").alias("mean"),
        F.percentile("m", F.lit(tail)).alias("ci_low"),
        F.percentile("m", F.lit(1.0 - tail)).alias("ci_high"),
    )


def off_policy_value(
    df: DataFrame, behavior: str, target: str, reward: str, q_taken: str, model_value: str
) -> DataFrame:
    """IPS, self-normalised IPS and doubly-robust value of the target policy.

    ``q_taken`` is the modelled reward of the logged action, ``model_value`` the
    modelled reward averaged under the target policy.
    """
    w = F.col(target) / F.col(behavior)
    r = F.col(reward)
    return df.agg(
        F.count(r).alias("n"),
        F.avg(r).alias("logged_mean"),
        F.avg(w * r).alias("ips"),
        F.try_divide(F.sum(w * r), F.sum(w)).alias("snips"),
        F.avg(F.col(model_value) + w * (r - F.col(q_taken))).alias("doubly_robust"),
    )


# ---- monitoring ----------------------------------------------------------------


def psi_terms(df: DataFrame, bin_col: str, is_reference: Column, floor: float = 1e-6) -> DataFrame:
    """Reference and current share per bin, from one grouped count.

    Shares of empty bins are lifted to ``floor``.
    """
    counts = df.groupBy(F.col(bin_col).alias("bin")).agg(
        F.count_if(is_reference).alias("n_ref"), F.count_if(~is_reference).alias("n_cur")
    )
    totals = counts.agg(
        F.struct(F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur")).alias("t")
    ).scalar()
    return (
        counts.withColumn("_t", totals)
        .select(
            "bin",
            F.greatest(ratio(F.col("n_ref"), F.col("_t.ref")), F.lit(floor)).alias("p"),
            F.greatest(ratio(F.col("n_cur"), F.col("_t.cur")), F.lit(floor)).alias("q"),
        )
        .withColumn("term", (F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))
    )


def psi(df: DataFrame, bin_col: str, is_reference: Column, floor: float = 1e-6) -> DataFrame:
    """Population stability index with its usual reading (0.1 and 0.25)."""
    total = F.sum("term")
    return psi_terms(df, bin_col, is_reference, floor).agg(
        F.count(F.lit(1)).alias("bins"),
        total.alias("psi"),
        F.when(total < 0.1, "stable")
        .when(total <= 0.25, "moderate")
        .otherwise("significant")
        .alias("shift"),
    )


def latency_percentiles(df: DataFrame, value: str) -> DataFrame:
    """Interpolated median, nearest-rank p99."""
    found = global_quantiles(df, value, {"p50": ("linear", 0.5), "p99": ("nearest", 0.99)})
    return df.sparkSession.createDataFrame([(found["p50"], found["p99"])], "p50 double, p99 double")
