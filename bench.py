"""Time the headline queries; prints one JSON line.

``queries`` holds the registered queries at ``BENCH_SF_DIR``. ``sec_per_million_rows`` is
the slope between the builds of one month's and of four months' rows. ``month`` holds the
three table builds on one month of about three million raw rows (the given rows
repeated with shifted times), each reading and writing parquet with its contract
check. Spark start-up is reported apart.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cityflux.functions import clock  # noqa: E402
from cityflux.operators import cleaning, panel, profile, split  # noqa: E402
from cityflux.plans.queries import QUERIES  # noqa: E402
from cityflux.session import local_session  # noqa: E402
from cityflux.sources import testdata as td  # noqa: E402
from cityflux.sources.catalog import Catalog  # noqa: E402

HEADLINE = (
    "clean_trips", "clean_months", "check_report", "hourly_counts", "demand_features",
    "time_split", "eta_features", "demand_profile", "zone_weights", "arrival_rate",
    "expected_arrivals", "travel_time", "leg_times", "drivers_in_radius", "nearest_driver",
    "assign_fifo", "event_order", "lifecycle_order", "rider_outcome", "patience_cancels",
    "double_booking", "illegal_transitions", "invariants", "ride_metrics", "sample_arrivals",
    "place_fleet", "backtest_folds", "conformal", "threshold_sweep", "ab_test",
    "peeking_inflation", "bootstrap_mean", "psi", "latency",
)
MONTH_ROWS = 3_000_000


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def month_input(spark, sf_dir: str, root: str, wanted: int) -> str:
    """About ``wanted`` raw rows with taxi-like trips of 1 to 60 minutes."""
    raw = td.raw_trips(td.table(spark, sf_dir, "events"))
    copies = max(1, wanted // raw.count())
    pickup = F.col("tpep_pickup_datetime")
    path = f"{root}/raw.parquet"
    (
        raw.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("tpep_pickup_datetime", clock.add_minutes(pickup, F.col("i") / 7.0))
        .withColumn(
            "tpep_dropoff_datetime",
            clock.add_minutes(pickup, F.col("i") / 7.0 + F.col("DOLocationID") % 60),
        )
        .withColumn("PULocationID", (F.col("PULocationID") + F.col("i") * 13) % 263 + 1)
        .drop("i")
        .repartition(8)
        .write.parquet(path)
    )
    return path


def month_builds(spark, sf_dir: str, wanted: int = MONTH_ROWS, rounds: int = 2) -> dict:
    root = tempfile.mkdtemp(prefix="run-bench-")
    path = month_input(spark, sf_dir, root, wanted)
    out = {"raw_rows": spark.read.parquet(path).count()}
    for k in range(rounds):
        catalog = Catalog(spark, f"{root}/data{k}")
        raw = spark.read.parquet(path)
        out["clean"] = timed(
            lambda: catalog.publish("cleaned_trips", cleaning.clean_trips(raw, td.START, td.END))  # noqa: B023
        )
        trips = catalog.read("cleaned_trips")
        out["gate"] = timed(lambda: catalog.validate("cleaned_trips"))  # noqa: B023
        out["demand"] = timed(
            lambda: catalog.publish("demand_features", panel.demand_features(trips))  # noqa: B023
        )
        out["eta"] = timed(lambda: catalog.publish("eta_features", split.eta_features(trips)))  # noqa: B023
        out["calibrate"] = timed(
            lambda: catalog.publish("demand_profile", profile.demand_profile(trips))  # noqa: B023
        )
    out["clean_rows"] = trips.count()
    return out


def slope(small: dict, large: dict) -> dict:
    """Seconds per million raw rows, without the fixed cost of a build."""
    rows = (large["raw_rows"] - small["raw_rows"]) / 1e6
    steps = ("clean", "gate", "demand", "eta", "calibrate")
    return {s: round((large[s] - small[s]) / rows, 3) for s in steps}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    start = time.perf_counter()
    spark = local_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    drain(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    startup = round(time.perf_counter() - start, 3)
    times = {}
    for name in names:
        drain(QUERIES[name](spark, sf_dir))  # warm up code generation
        times[name] = timed(lambda: drain(QUERIES[name](spark, sf_dir)))  # noqa: B023
    month = month_builds(spark, sf_dir)
    more = month_builds(spark, sf_dir, 4 * MONTH_ROWS, rounds=1)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cores": int(cores),
                "startup_sec": startup,
                "month": month,
                "four_months": more,
                "sec_per_million_rows": slope(month, more),
            }
        )
    )


if __name__ == "__main__":
    main()
