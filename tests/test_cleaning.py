from functools import reduce

import pytest
from frames import GOOD, KEPT, RAW_DDL, REPEATED, at, raw_fixture
from pyspark.sql import DataFrame, functions as F

from cityflux.operators.cleaning import TRIP_COLUMNS, CleaningRules, clean_months, clean_trips
from cityflux.operators.contracts import CLEANED_TRIPS, enforce


def clean(raw, rules=CleaningRules()):
    return clean_trips(raw, "2024-05-01", "2024-06-01", rules)


def test_every_rule(spark):
    cleaned = clean(raw_fixture(spark))
    assert cleaned.columns == list(TRIP_COLUMNS)
    got = {(r.pickup_ts, r.pu_location_id, r.do_location_id, r.trip_distance, r.passenger_count) for r in cleaned.collect()}
    want = set()
    for r in (GOOD | changes for changes in KEPT + REPEATED):
        pax = None if r["pax"] is None else int(r["pax"])
        want.add((at(f"{r['day']} {r['start']}"), int(r["pu"]), int(r["do"]), r["miles"], pax))
    assert got == want
    assert cleaned.count() == len(KEPT) + 1  # the repeated trip once


def test_output_meets_contract(spark):
    assert enforce(clean(raw_fixture(spark)), CLEANED_TRIPS).count() == len(KEPT) + 1


def test_limits_are_parameters(spark):
    # 25-minute trips go, and so do the longest and the farthest
    short = clean(raw_fixture(spark), CleaningRules(max_duration_min=20, max_distance=5))
    assert {r.duration_min for r in short.collect()} == {1.0, 59 / 60, 9.0}


def test_second_boundaries_and_half_even_casts(spark):
    raw = spark.createDataFrame(
        [
            (at("2024-05-01T00:00:00.900000"), at("2024-05-01T00:00:01.100000"),
             1.5, 2.5, 1.0, 2.5),
            (at("2024-05-01T00:00:00.100000"), at("2024-05-01T00:00:00.900000"),
             1.0, 2.0, 1.0, 1.0),
            (at("2024-05-01T00:00:00"), at("2024-05-01T00:01:00"), 1.0, 2.0, float("nan"), 1.0),
        ],
        RAW_DDL,
    )
    (row,) = clean(raw).collect()
    assert row.duration_min == pytest.approx(1 / 60)
    assert (row.pu_location_id, row.do_location_id, row.passenger_count) == (2, 2, 2)


def test_months_keep_to_their_own_file(spark):
    raw = raw_fixture(spark)
    filed = reduce(
        DataFrame.unionByName, [raw.withColumn("month", F.lit(m)) for m in ("2024-05", "2024-06")]
    )
    got = clean_months(filed, ["2024-05", "2024-06"])
    # the file of June holds the same rows; only its own June trip counts
    counts = {r["month"]: r["count"] for r in got.groupBy("month").count().collect()}
    assert counts == {"2024-05": len(KEPT) + 1, "2024-06": 1}
    assert clean_months(filed, ["2024-06"]).count() == 1
    with pytest.raises(ValueError):
        clean_months(filed, [])


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "raw")
    raw_fixture(spark).write.parquet(path)
    clean(spark.read.parquet(path)).explain("formatted")
    (pushed,) = [line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line]
    for column in ("tpep_pickup_datetime", "trip_distance", "PULocationID", "DOLocationID"):
        assert f"LessThanOrEqual({column}" in pushed or f"LessThan({column}" in pushed
