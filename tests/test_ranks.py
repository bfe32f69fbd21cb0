import math
from datetime import timedelta

import numpy as np
import pytest
from frames import at

from pyspark.sql import functions as F

from cityflux.operators import ranks
from cityflux.operators.ranks import exact_quantiles
from cityflux.operators.split import eta_features, split_balance, time_split
from frames import trip, trips

START = at("2023-01-02 06:00")


def reference_cutoff(stamps, holdout=0.2):
    n = len(stamps)
    at_rank = min(max(int(n * (1.0 - holdout)), 1), n - 1)
    return sorted(stamps)[at_rank]


def stamp_frame(spark, stamps):
    return spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")


def labels(df):
    return [(r.ts, r.split) for r in df.collect()]


@pytest.mark.parametrize("seed", range(4))
def test_split_matches_sorted_order(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 400))
    # many ties: several rows in one second, some in one microsecond, over many days
    us = rng.integers(0, 3, n) * 86_400_000_000 * 40 + rng.integers(0, 50, n) * 400_000
    stamps = [START + timedelta(microseconds=int(u)) for u in us]
    cutoff = reference_cutoff(stamps)
    got = labels(time_split(stamp_frame(spark, stamps), "ts"))
    assert sorted(got) == sorted((s, "train" if s < cutoff else "holdout") for s in stamps)


def test_split_hot_microsecond(spark):
    """A third of all rows in one microsecond, at the cutoff: all of them held out."""
    stamps = [START + timedelta(minutes=i) for i in range(60)]
    hot = START + timedelta(minutes=200)
    stamps += [hot] * 40 + [hot + timedelta(minutes=i + 1) for i in range(5)]
    got = labels(time_split(stamp_frame(spark, stamps), "ts"))
    assert sum(s == hot and label == "holdout" for s, label in got) == 40
    assert sum(label == "train" for _, label in got) == 60


def test_split_of_one_row_is_holdout(spark):
    assert labels(time_split(stamp_frame(spark, [START]), "ts")) == [(START, "holdout")]


def test_all_equal_is_holdout(spark):
    got = labels(time_split(stamp_frame(spark, [START] * 9), "ts"))
    assert {label for _, label in got} == {"holdout"}


def test_eta_features(spark):
    made = trips(
        spark,
        [
            trip(START + timedelta(minutes=7 * i), 10 + i % 5, 100 + i % 3, 200 + i % 4,
                 1.0 + i % 7, 1 + i % 3)
            for i in range(50)
        ],
    )
    out = eta_features(made)
    rows = sorted(out.collect())
    assert out.columns == [
        "pickup_ts", "pu_location_id", "do_location_id", "hour", "dow", "trip_distance",
        "passenger_count", "duration_min", "split",
    ]
    assert [r.duration_min for r in rows] == [10 + i % 5 for i in range(50)]
    assert (rows[0].hour, rows[0].dow) == (6, 0)
    spans = {r.split: r for r in split_balance(out).collect()}
    assert spans["holdout"].n == 10
    assert spans["train"].last_ts < spans["holdout"].first_ts


def values_frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


CASES = {
    "uniform": lambda rng: rng.uniform(0, 180, 501),
    "ties": lambda rng: rng.integers(0, 4, 400) / 10,
    "one": lambda rng: np.array([3.25]),
    "constant": lambda rng: np.full(50, 7.5),
    "hot": lambda rng: np.concatenate([np.full(200, 2.0), rng.uniform(0, 5, 100)]),
    "outlier": lambda rng: np.concatenate([rng.uniform(0, 1e-6, 300), [1e12]]),
    "negative": lambda rng: rng.normal(0, 10, 333),
    "extreme": lambda rng: np.concatenate(
        [[-1e308, 1e308, 5e-324, -5e-324, 0.0, -0.0, 1.7e308], rng.normal(0, 1, 20)]
    ),
    "many": lambda rng: np.concatenate([rng.lognormal(0, 40, 12_000), -rng.lognormal(0, 40, 3_000)]),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_quantiles_match_numpy(spark, case):
    values = CASES[case](np.random.default_rng(5))
    probs = {"p50": 0.5, "p90": 0.9, "p100": 1.0, "p0": 0.0}
    got = exact_quantiles(values_frame(spark, values), "x", probs).head()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)
    nearest = exact_quantiles(values_frame(spark, values), "x", {"q": 0.99}, method="nearest")
    assert nearest.head()["q"] == sorted(values)[math.ceil(0.99 * len(values)) - 1]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_with_infinities(spark, keys):
    """More rows than any pass keeps, spread over all magnitudes, with both infinities."""
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.lognormal(0, 200, 12_000), [-math.inf] * 3, [math.inf] * 150, [1e308, -1e308]])
    probs = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = values_frame(spark, values).withColumn("k", F.lit(1))
    got = exact_quantiles(df, "x", probs, keys, method="nearest").head()
    ordered = sorted(values)
    for name, p in probs.items():
        assert got[name] == ordered[max(math.ceil(p * len(values)), 1) - 1]
    linear = exact_quantiles(df, "x", probs, keys).head()
    assert (linear.p0, linear.p99, linear.p100) == (-math.inf, math.inf, math.inf)


def test_passes_are_bounded(spark, monkeypatch):
    calls = []
    real = ranks._with_offset
    monkeypatch.setattr(ranks, "_with_offset", lambda *a: calls.append(1) or real(*a))
    rng = np.random.default_rng(2)
    values = np.concatenate([np.nextafter(1.0, 2.0, dtype=float) ** rng.integers(0, 9, 4000), rng.lognormal(0, 300, 9000), [math.inf]])
    got = exact_quantiles(values_frame(spark, values), "x", {"q": 0.2}, method="nearest").head().q
    assert got == sorted(values)[math.ceil(0.2 * len(values)) - 1]
    assert len(calls) <= ranks.PASSES


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_conformal_rank_beyond_the_last_value_is_null(spark, keys):
    df = values_frame(spark, range(1, 20)).withColumn("k", F.lit("a"))
    got = exact_quantiles(df, "x", {"in": 0.95, "out": 0.951}, keys, method="conformal").head()
    assert (got["in"], got["out"]) == (19.0, None)


def test_hot_key_is_spread_over_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 6000)] + [(f"k{i}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows + [(None, 3.0)], "k string, x double")
    got = {r.k: (r.m, r.q) for r in exact_quantiles(df, "x", {"m": 0.5, "q": 0.9}, ["k"]).collect()}
    hot = [v for k, v in rows if k == "hot"]
    assert got["hot"] == pytest.approx((np.quantile(hot, 0.5), np.quantile(hot, 0.9)))
    assert got["k7"] == (7.0, 7.0) and got[None] == (3.0, 3.0) and len(got) == 202


def test_quantiles_per_key_and_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 5, 700), rng.uniform(0, 9, 700))]
    df = spark.createDataFrame(
        rows + [(0, None), (1, float("nan")), (9, None)], "k bigint, x double"
    )
    got = {r.k: r.m for r in exact_quantiles(df, "x", {"m": 0.5}, ["k"]).collect()}
    assert got == pytest.approx(
        {k: np.median([v for j, v in rows if j == k]) for k in range(5)}
    )


def test_quantiles_of_nothing(spark):
    got = exact_quantiles(values_frame(spark, []), "x", {"m": 0.5}).collect()
    assert [r.m for r in got] == [None]
    assert exact_quantiles(
        values_frame(spark, []).withColumn("k", F.lit(1)), "x", {"m": 0.5}, ["k"]
    ).collect() == []


def test_split_of_nothing_is_refused(spark):
    with pytest.raises(ValueError):
        time_split(stamp_frame(spark, []), "ts")


def test_cutoff_bounds_reach_the_scan(spark, tmp_path, capsys):
    """The final label and the narrow counts use literals."""
    path = str(tmp_path / "t")
    stamp_frame(spark, [START + timedelta(minutes=i) for i in range(50)]).write.parquet(path)
    time_split(spark.read.parquet(path), "ts").explain("formatted")
    plan = capsys.readouterr().out
    assert "Subquer" not in plan and "Exchange" not in plan
