import pytest
from frames import RAW_DDL, at, trip, trips
from pyspark.sql import functions as F

from cityflux.operators.contracts import (
    CLEANED_TRIPS,
    DEMAND_FEATURES,
    ETA_FEATURES,
    RAW_TRIPS,
    ContractViolation,
    check,
    enforce,
    observed,
)

DEMAND_DDL = (
    "zone_id bigint, ts timestamp_ntz, pickups bigint, hour bigint, dow bigint, "
    "is_holiday boolean, lag_1h double, lag_24h double, lag_168h double, "
    "roll_mean_24h double, roll_mean_168h double"
)
ETA_DDL = (
    "pickup_ts timestamp_ntz, pu_location_id bigint, do_location_id bigint, hour bigint, "
    "dow bigint, trip_distance double, passenger_count bigint, duration_min double, split string"
)


def good_trip(spark):
    return trips(spark, [trip(at("2023-01-02 08:00"), 12, 161, 230, 2.4)])


@pytest.mark.parametrize(
    "column, value",
    [
        ("pu_location_id", 300),
        ("do_location_id", 0),
        ("duration_min", -1.0),
        ("duration_min", 0.0),
        ("trip_distance", float("nan")),
        ("passenger_count", -1),
        ("pickup_ts", None),
    ],
)
def test_cleaned_contract_refuses(spark, column, value):
    enforce(good_trip(spark), CLEANED_TRIPS)
    with pytest.raises(ContractViolation, match=column):
        bad = F.lit(value) if value is not None else F.lit(None).cast("timestamp_ntz")
        enforce(good_trip(spark).withColumn(column, bad), CLEANED_TRIPS)


def test_strict_contract_refuses_extra_and_missing_columns(spark):
    with pytest.raises(ContractViolation, match="surprise: extra_column"):
        enforce(good_trip(spark).withColumn("surprise", F.lit(1)), CLEANED_TRIPS)
    with pytest.raises(ContractViolation, match="duration_min: missing_column"):
        enforce(good_trip(spark).drop("duration_min"), CLEANED_TRIPS)


def test_all_failures_are_told_at_once(spark):
    bad = good_trip(spark).withColumns(
        {"pu_location_id": F.lit(999), "trip_distance": F.lit(0.0)}
    )
    with pytest.raises(ContractViolation) as told:
        enforce(bad, CLEANED_TRIPS)
    assert "pu_location_id" in str(told.value) and "trip_distance" in str(told.value)
    assert "999" in str(told.value)


def test_raw_contract(spark):
    raw = spark.createDataFrame(
        [(at("2023-01-01"), at("2023-01-01 00:10"), 1.0, 2.0, 1.5, None)], RAW_DDL
    )
    # other columns are welcome, integer-like values are coerced
    out = enforce(raw.withColumn("fare_amount", F.lit(9.5)), RAW_TRIPS)
    assert dict(out.dtypes)["PULocationID"] == "bigint" and "fare_amount" in out.columns
    with pytest.raises(ContractViolation, match="PULocationID: coerce"):
        enforce(raw.withColumn("PULocationID", F.lit("not-an-int")), RAW_TRIPS)


def test_demand_contract(spark):
    row = (161, at("2023-01-02 08:00"), 3, 8, 0, True, 1.0, None, None, 1.0, 1.0)
    good = spark.createDataFrame([row], DEMAND_DDL)
    assert enforce(good, DEMAND_FEATURES).count() == 1
    with pytest.raises(ContractViolation, match="hour"):
        enforce(good.withColumn("hour", F.lit(24)), DEMAND_FEATURES)


def test_eta_contract(spark):
    row = (at("2023-01-02 08:00"), 161, 230, 8, 0, 2.4, None, 12.0, "train")
    good = spark.createDataFrame([row], ETA_DDL)
    assert enforce(good, ETA_FEATURES).count() == 1
    for column, value in (("trip_distance", 0.0), ("split", "test")):
        with pytest.raises(ContractViolation, match=column):
            enforce(good.withColumn(column, F.lit(value)), ETA_FEATURES)


def test_report_is_one_pass(spark):
    plan = check(good_trip(spark), CLEANED_TRIPS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange") <= 1


def test_counts_ride_on_the_write(spark, tmp_path):
    table, verdict = observed(good_trip(spark), CLEANED_TRIPS)
    table.write.parquet(str(tmp_path / "good"))
    assert verdict() == 1
    bad = good_trip(spark).withColumn("pu_location_id", F.lit(264))
    table, verdict = observed(bad, CLEANED_TRIPS)
    table.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ContractViolation, match="pu_location_id"):
        verdict()
