"""Small tables the tests share."""

from __future__ import annotations

from datetime import datetime, timedelta

TRIP_DDL = (
    "pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, pu_location_id bigint, "
    "do_location_id bigint, trip_distance double, passenger_count bigint, duration_min double"
)
RAW_DDL = (
    "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
    "PULocationID double, DOLocationID double, trip_distance double, passenger_count double"
)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def trip(pickup, minutes, pu, do=200, distance=1.0, pax=1):
    return (pickup, pickup + timedelta(minutes=minutes), pu, do, distance, pax, float(minutes))


def trips(spark, rows):
    return spark.createDataFrame(rows, TRIP_DDL)


def hourly_trips(spark, start, hours, per_hour, minutes=10):
    """``per_hour(zone, ts)`` trips for each (zone, hour)."""
    rows = []
    for h in range(hours):
        ts = start + timedelta(hours=h)
        for zone, n in per_hour(ts, h).items():
            rows += [trip(ts + timedelta(minutes=1), minutes, zone, zone)] * n
    return trips(spark, rows)


# Raw trips of May 2024, keyed by what the cleaner must do with them. A row starts from
# ``GOOD`` and differs in the fields named.
GOOD = {"day": "2024-05-14", "start": "10:00", "end": "10:25", "pu": 88.0, "do": 12.0, "miles": 4.0, "pax": 2.0}
KEPT = [
    {},
    {"day": "2024-05-01", "start": "00:00", "end": "00:01"},
    {"day": "2024-05-31", "start": "23:59", "end": "23:59:59"},
    {"pu": 1.0, "do": 263.0},
    {"end": "13:00", "miles": 100.0},
    {"pax": None, "miles": 0.01},
    {"pax": 0.0, "pu": 12.0, "do": 12.0},
]
REPEATED = [{"start": "17:00", "end": "17:09", "pu": 33.0, "do": 34.0}] * 3
DROPPED = [
    {"day": "2024-04-30", "start": "23:50", "end": "23:58"},
    {"day": "2024-06-01", "start": "00:00", "end": "00:10"},
    {"end": "10:00"},
    {"end": "09:55"},
    {"end": "13:00:01"},
    {"miles": 0.0},
    {"miles": -3.0},
    {"miles": 100.5},
    {"pu": 0.0},
    {"pu": 264.0},
    {"pu": None},
    {"do": 264.0},
    {"do": 300.0},
]


def raw_fixture(spark):
    def row(changes):
        r = GOOD | changes
        start, end = at(f"{r['day']} {r['start']}"), at(f"{r['day']} {r['end']}")
        return start, end, r["pu"], r["do"], r["miles"], r["pax"]

    return spark.createDataFrame([row(r) for r in KEPT + REPEATED + DROPPED], RAW_DDL)
