"""Trip-duration features with a leak-free time split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import HOLDOUT_FRACTION
from ..functions import clock
from .ranks import time_cutoff

ETA_COLUMNS = (
    "pickup_ts", "pu_location_id", "do_location_id", "hour", "dow",
    "trip_distance", "passenger_count", "duration_min", "split",
)


def time_split(
    df: DataFrame, ts: str = "pickup_ts", holdout: float = HOLDOUT_FRACTION, out: str = "split"
) -> DataFrame:
    """Label rows before the cutoff ``train``, the others ``holdout``.

    All rows that share the cutoff timestamp go to ``holdout``. The cutoff is found
    by counting; labelling itself moves no rows.
    """
    cutoff = time_cutoff(df, ts, 1.0 - holdout)
    if cutoff is None:
        raise ValueError("cannot split a table without rows")
    return df.withColumn(
        out, F.when(F.col(ts) < cutoff, F.lit("train")).otherwise(F.lit("holdout"))
    )


def eta_features(trips: DataFrame, holdout: float = HOLDOUT_FRACTION) -> DataFrame:
    pickup = F.col("pickup_ts")
    rows = trips.select(
        "pickup_ts",
        "pu_location_id",
        "do_location_id",
        clock.hour_of_day(pickup).alias("hour"),
        clock.weekday(pickup).alias("dow"),
        "trip_distance",
        "passenger_count",
        clock.minutes_between(pickup, F.col("dropoff_ts")).alias("duration_min"),
    )
    return time_split(rows, "pickup_ts", holdout).select(*ETA_COLUMNS)


def split_balance(features: DataFrame) -> DataFrame:
    """Rows and time span per split."""
    return features.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pickup_ts").alias("first_ts"),
        F.max("pickup_ts").alias("last_ts"),
    )
