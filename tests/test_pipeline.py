import os
import shutil
from datetime import timedelta

import pytest
from frames import RAW_DDL, at, trip, trips
from pyspark.sql import functions as F

from cityflux.operators import contracts
from cityflux.operators.contracts import ContractViolation
from cityflux.operators.events import as_event_log
from cityflux.operators.panel import carry_over, demand_features, later_features
from cityflux.plans.pipeline import add_month, build_all, build_features, calibrate, publish_cleaned
from cityflux.sources import catalog, files
from cityflux.sources.catalog import (
    Catalog,
    parse_months,
    raw_month_path,
    read_zone_lookup,
    write_metrics,
)
from cityflux.sources.verify import (
    ChecksumMismatch,
    file_hashes,
    manifest_entry,
    manifest_table,
    require_verified,
    verify_files,
)


def test_month_ranges():
    assert parse_months("2019-09..2019-12") == [f"2019-{m:02d}" for m in range(9, 13)]
    assert parse_months("2021-12..2022-02")[1:] == ["2022-01", "2022-02"]
    assert parse_months("2020-02..2020-02") == parse_months("2020-02") == ["2020-02"]
    for bad in ("2022-01..2021-12", "2020-00", "2020-02..", "..2020-02", "soon"):
        with pytest.raises(ValueError):
            parse_months(bad)


def write_month(spark, raw_dir, month, n=30):
    """A trip every quarter of an hour from noon of the ninth, 7 to 11 minutes long."""
    rows = []
    for k in range(n):
        left = at(f"{month}-09 12:00") + timedelta(minutes=15 * k)
        zones = 60.0 + k % 4, 140.0 + k % 3
        rows.append((left, left + timedelta(minutes=7 + k % 5), *zones, 0.8 + 0.1 * (k % 9), 2.0))
    spark.createDataFrame(rows, RAW_DDL).write.parquet(raw_month_path(raw_dir, month))


def test_two_months_end_to_end(spark, tmp_path):
    raw = str(tmp_path / "data" / "raw")
    for month in ("2023-01", "2023-02"):
        write_month(spark, raw, month)
    catalog = build_all(spark, "2023-01..2023-02", str(tmp_path / "data"))
    catalog.validate()
    assert catalog.read("cleaned_trips").count() == 60
    assert catalog.read("cleaned_trips", ["2023-02"]).count() == 30
    assert catalog.read("eta_features").where("split = 'holdout'").count() == 12
    hours = catalog.read("demand_features").select("ts").distinct().count()
    assert catalog.read("demand_features").count() == 263 * hours
    calibrate(catalog)
    assert catalog.read("demand_profile").count() == 263 * 168
    # a month alone is replaced beside the others, or the whole table is
    publish_cleaned(catalog, raw, ["2023-01"], keep_months=True)
    assert catalog.read("cleaned_trips").count() == 60
    publish_cleaned(catalog, raw, ["2023-01"])
    assert catalog.read("cleaned_trips").count() == 30
    assert catalog.read("cleaned_trips", ["2023-02"]).count() == 0


def test_months_of_differing_types(spark, tmp_path):
    """Passenger counts and zones change type from month to month, as public files do."""
    raw = str(tmp_path / "data" / "raw")
    write_month(spark, raw, "2023-01")
    write_month(spark, raw, "2023-03")
    for month, kinds in (
        ("2023-02", {"passenger_count": "bigint", "PULocationID": "int", "trip_distance": "float"}),
        ("2023-04", {"passenger_count": "int", "DOLocationID": "bigint"}),
    ):
        write_month(spark, raw, f"{month}")
        path = raw_month_path(raw, month)
        df = spark.read.parquet(path)
        rows = df.withColumns({c: df[c].cast(k) for c, k in kinds.items()}).withColumn("extra", df[0])
        rows.write.parquet(path + ".new")
        shutil.rmtree(path)
        os.rename(path + ".new", path)
    catalog = build_all(spark, "2023-01..2023-04", str(tmp_path / "data"))
    assert catalog.read("cleaned_trips").count() == 120
    assert dict(catalog.read("cleaned_trips").dtypes)["passenger_count"] == "bigint"


def test_values_of_the_wrong_type_are_refused(spark, tmp_path):
    raw = str(tmp_path / "raw")
    write_month(spark, raw, "2023-01")
    good = spark.read.parquet(raw_month_path(raw, "2023-01"))
    text = good.withColumn("trip_distance", F.lit("far"))
    text.write.parquet(raw_month_path(raw, "2023-02"))
    catalog = Catalog(spark, str(tmp_path))
    with pytest.raises(ContractViolation, match="trip_distance: coerce"):
        publish_cleaned(catalog, raw, ["2023-02"])
    assert not catalog.exists("cleaned_trips")


def test_bad_trips_stop_the_build(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        build_features(catalog)
    trips(spark, [trip(at("2023-01-02 08:00"), 12, 999)]).write.parquet(
        catalog.path("cleaned_trips")
    )
    with pytest.raises(ContractViolation, match="pu_location_id"):
        build_features(catalog)
    assert not catalog.exists("demand_features")


def test_publish_is_all_or_nothing(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    good = trips(spark, [trip(at("2023-01-02 08:00"), 12, 161)])
    catalog.publish("cleaned_trips", good)
    bad = trips(spark, [trip(at("2023-01-02 08:00"), 12, 264)])
    with pytest.raises(ContractViolation):
        catalog.publish("cleaned_trips", bad)
    with pytest.raises(ContractViolation, match="no rows"):
        catalog.publish("cleaned_trips", good.where("false"))
    assert [r.pu_location_id for r in catalog.read("cleaned_trips").collect()] == [161]
    # nothing of the refused versions stays, and readers of the last version can go on
    versions = lambda: [c for c in os.listdir(catalog.path("cleaned_trips")) if c.startswith("v-")]
    assert len(versions()) == 1
    under_way = catalog.read("cleaned_trips")
    for zone in (7, 8):
        catalog.publish("cleaned_trips", trips(spark, [trip(at("2023-01-02 08:00"), 12, zone)]))
        assert len(versions()) == 2
        if zone == 7:
            assert [r.pu_location_id for r in under_way.collect()] == [161]


def test_profiles_and_logs_are_judged_too(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    rates = spark.createDataFrame([(5, 168, 1.0)], "zone_id bigint, how bigint, rate_per_hour double")
    with pytest.raises(ContractViolation, match="how"):
        catalog.publish("demand_profile", rates)
    log = spark.createDataFrame([(1, "Teleported", at("2023-01-02 08:00"))], "seq bigint, kind string, ts timestamp_ntz")
    with pytest.raises(ContractViolation, match="missing_column"):
        catalog.publish("event_log", log)
    with pytest.raises(ContractViolation, match="kind"):
        catalog.publish("event_log", as_event_log(log))


def test_catalog_names(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert {"cleaned_trips", "demand_features", "eta_features"} <= set(catalog.datasets())
    with pytest.raises(KeyError, match="unknown dataset"):
        catalog.path("nope")
    assert not catalog.exists("eta_features")
    with pytest.raises(FileNotFoundError, match="is not built"):
        catalog.read("eta_features")


def test_raw_gate(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    spark.createDataFrame([(1.0,)], "trip_distance double").write.parquet(
        raw_month_path(str(tmp_path / "raw"), "2023-01")
    )
    with pytest.raises(ContractViolation, match="tpep_pickup_datetime: missing_column"):
        publish_cleaned(catalog, str(tmp_path / "raw"), ["2023-01"])


def test_zone_lookup_csv(spark, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text(
        '"LocationID","Borough","Zone","service_zone"\n'
        '56,"Queens","Corona","Boro Zone"\n1,"EWR","Newark Airport","EWR"\n'
        '264,"Unknown","NV","N/A"\n'
    )
    rows = [tuple(r) for r in read_zone_lookup(spark, str(path)).collect()]
    assert rows == [(1, "Newark Airport", "EWR"), (56, "Corona", "Queens")]


def test_metrics_json(spark, tmp_path):
    df = spark.createDataFrame([(4, 0.25)], "requests bigint, cancel_rate double")
    write_metrics(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).head().asDict() == {
        "requests": 4, "cancel_rate": 0.25,
    }


ABC = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def entry(name, sha256=None, **more):
    return {"name": name, "url": f"file:///{name}", "sha256": sha256, "kind": "csv"} | more


def test_file_hashes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"abc")
    (tmp_path / "b.csv").write_bytes(b"other")
    hashes = file_hashes(spark, str(tmp_path))
    assert {r.name: r.sha256 for r in hashes.collect()}["a"] == ABC

    def status(*entries):
        return {
            r.name: r.status
            for r in verify_files(hashes, manifest_table(spark, list(entries))).collect()
        }

    assert status(entry("a", ABC.upper()), entry("b")) == {"a": "ok", "b": "unverified"}
    assert status(entry("a", "0" * 64)) == {"a": "mismatch", "b": "unlisted"}
    require_verified(hashes, manifest_table(spark, [entry("a", ABC), entry("b")]))
    with pytest.raises(ChecksumMismatch, match="a"):
        require_verified(hashes, manifest_table(spark, [entry("a", "0" * 64)]))
    with pytest.raises(ChecksumMismatch, match="missing: .*gone"):
        require_verified(hashes, manifest_table(spark, [entry("gone")]))


def test_manifest_rows(spark):
    table = manifest_table(spark, [entry("a", ABC), entry("b", kind="zip")])
    assert manifest_entry(table, "b")["kind"] == "zip"
    with pytest.raises(KeyError, match="nope"):
        manifest_entry(table, "nope")
    for bad, told in (
        (entry("a", kind="exe"), "kind"),
        (entry("a", url=None), "url: not_null"),
        (entry(""), "name: non_empty"),
        (entry("a", surprise="x"), "surprise: extra_column"),
        ({"name": "a", "kind": "csv"}, "url: missing_column"),
    ):
        with pytest.raises(ContractViolation, match=told):
            manifest_table(spark, [bad])


def test_adding_months_equals_a_full_build(spark, tmp_path):
    raw = str(tmp_path / "raw")
    for month in ("2023-01", "2023-02", "2023-03"):
        write_month(spark, raw, month)
    whole = build_all(spark, "2023-01..2023-03", str(tmp_path / "whole"), raw_dir=raw)
    step = build_all(spark, "2023-01", str(tmp_path / "step"), raw_dir=raw)
    for month in ("2023-02", "2023-03"):
        add_month(step, raw, month)
    want, got = whole.read("demand_features"), step.read("demand_features")
    assert want.count() == got.count() > 263 * 24 * 50
    assert want.exceptAll(got).isEmpty()
    assert whole.read("demand_carry").exceptAll(step.read("demand_carry")).isEmpty()
    step.validate()
    # the plan reads the month and the carried hours, nothing else
    new = later_features(step.read("cleaned_trips", ["2023-03"]), step.read("demand_carry"))
    folders = {f.split("/processed/")[1].split("/v-")[0] for f in new.inputFiles()}
    assert folders == {"cleaned_trips", "demand_carry"}
    assert all("demand_carry" in f or "month=2023-03" in f for f in new.inputFiles())
    with pytest.raises(Exception, match="already holds"):
        add_month(step, raw, "2023-02")


def test_later_features_of_a_short_past(spark):
    """Past of fewer hours than the longest window: rows still count from the first hour."""
    rows = [trip(at("2023-01-01 00:10") + timedelta(hours=h), 9, 1 + h % 3) for h in range(0, 60, 2)]
    some = trips(spark, rows)
    cut = at("2023-01-02 03:00")
    early, late = (some.where(F.col("pickup_ts") < cut), some.where(F.col("pickup_ts") >= cut))
    want = demand_features(some, 1, 4).where(F.col("ts") >= F.lit("2023-01-02 03:00").cast("timestamp_ntz"))
    carry = carry_over(demand_features(early, 1, 4))
    got = later_features(late, carry, 1, 4)
    assert carry.count() == 27 * 4 and want.exceptAll(got).isEmpty() and got.where("ts >= '2023-01-02 03:00'").count() == want.count()
    assert later_features(late.limit(0), carry, 1, 4).count() == 0
    assert later_features(some, carry.limit(0), 1, 4).exceptAll(demand_features(some, 1, 4)).isEmpty()


def test_tables_are_judged_from_statistics(spark, tmp_path, monkeypatch):
    raw = str(tmp_path / "raw")
    write_month(spark, raw, "2023-01")
    root = build_all(spark, "2023-01", str(tmp_path / "data"), raw_dir=raw)
    read = []
    monkeypatch.setattr(catalog, "enforce", lambda df, contract: read.append((contract.name, df.columns)))
    root.validate()
    # nothing of the other tables is read
    assert read == [("eta_features", ["split"])]
    monkeypatch.undo()
    # a file that the statistics do not speak of: the rows are read, and the report is whole
    folder = root._current("cleaned_trips")["2023-01"]
    bad = trips(spark, [trip(at("2023-01-09 12:00"), 500, 999)])
    bad.write.mode("append").parquet(f"{root.path('cleaned_trips')}/{folder}")
    with pytest.raises(ContractViolation, match="duration_min.*pu_location_id"):
        root.validate("cleaned_trips")
    with pytest.raises(ContractViolation):
        root.checked("cleaned_trips")
    # without statistics a table is read as before
    files.delete(spark, f"{root.path('demand_features')}/_statistics")
    monkeypatch.setattr(catalog, "enforce", lambda df, contract: read.append((contract.name, len(df.columns))))
    root.validate("demand_features")
    assert read[-1] == ("demand_features", 11)


def test_statistics_that_break_a_rule_are_not_trusted(spark):
    contract = contracts.DEMAND_CARRY
    good = {"nulls zone_id": "0", "min zone_id": "1", "max zone_id": "263", "nulls ts": "0",
            "min ts": "2023-01-01 00:00:00", "max ts": "2023-01-31 23:00:00",
            "nulls pickups": "0", "min pickups": "0", "max pickups": "9"}
    assert contracts.undecided(spark, contract, [good]) == []
    assert contracts.undecided(spark, contract, [good, good | {"max zone_id": "264"}]) is None
    assert contracts.undecided(spark, contract, [good | {"min pickups": "-1"}]) is None
    assert contracts.undecided(spark, contract, [good | {"nulls ts": "2"}]) is None
    none = {k: "0" if k.startswith("nulls") else None for k in good}
    assert contracts.undecided(spark, contract, [none]) == []


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    import hashlib

    for name, size in (("small one", 10), ("edge", 1000), ("large", 1001), ("larger", 20_000_000)):
        (tmp_path / f"{name}.bin").write_bytes(os.urandom(size))
    want = {p.stem: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    for limit in (1000, 5, 1 << 30):
        got = file_hashes(spark, str(tmp_path), whole=limit)
        assert {r.name: r.sha256 for r in got.collect()} == want
    plan = file_hashes(spark, str(tmp_path), whole=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("content#") >= 1 and "MapInArrow" in plan
