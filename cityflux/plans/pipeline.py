"""Raw files to published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cleaning import RAW_COLUMNS, CleaningRules, clean_months
from ..operators.contracts import RAW_TRIPS, judged_types
from ..functions.clock import month_key
from ..operators.panel import carry_over, demand_features, later_features
from ..operators.profile import demand_profile
from ..operators.split import eta_features
from ..sources.catalog import Catalog, parse_months, read_raw_months
from ..sources.verify import file_hashes, manifest_table, require_verified


def publish_cleaned(
    catalog: Catalog, raw_dir: str, months: list[str], rules: CleaningRules = CleaningRules(),
    keep_months: bool = False,
) -> str:
    """Clean the months and publish them, judging the raw rows while they are read.

    Raw files with missing columns or values of the wrong type are refused. Nulls and
    values out of range are the cleaner's business, not a broken file.
    """
    raw, verdict = judged_types(read_raw_months(catalog.spark, raw_dir, months), RAW_TRIPS)
    cleaned = clean_months(raw.select(*RAW_COLUMNS, "month"), months, rules)
    return catalog.publish("cleaned_trips", cleaned, keep_months=keep_months, verdicts=[verdict])


def build_features(catalog: Catalog) -> tuple[str, str]:
    """Demand and duration features from the published trips, which must be valid."""
    if not catalog.exists("cleaned_trips"):
        raise FileNotFoundError(f"cleaned_trips not built: {catalog.path('cleaned_trips')}")
    trips = catalog.checked("cleaned_trips")
    demand = catalog.publish("demand_features", _by_month(demand_features(trips)))
    catalog.publish("demand_carry", carry_over(catalog.read("demand_features")), allow_empty=True)
    return demand, catalog.publish("eta_features", eta_features(trips))


def _by_month(features: DataFrame) -> DataFrame:
    return features.withColumn("month", month_key(F.col("ts")))


def add_month(
    catalog: Catalog, raw_dir: str, month: str, rules: CleaningRules = CleaningRules()
) -> str:
    """Clean one more month and extend the demand features by its hours.

    Of the features only the carried hours are read, of the trips only the new month; the
    table then equals a full build over all months. Months come in order; hours without trips
    before the new month's first are stored with it. Duration features split all trips by
    time, so they are not extended: ``build_features`` makes them.
    """
    if not catalog.exists("demand_carry"):
        raise FileNotFoundError("demand features are extended after build_features has made them")
    publish_cleaned(catalog, raw_dir, [month], rules, keep_months=True)
    trips = catalog.read("cleaned_trips", [month])
    carry = catalog.read("demand_carry")
    new = later_features(trips, carry).withColumn("month", F.lit(month))
    target = catalog.publish("demand_features", new, keep_months=True)
    seen = catalog.read("demand_features", [month]).select("zone_id", "ts", "pickups")
    catalog.publish("demand_carry", carry_over(carry.unionByName(seen)))
    return target


def calibrate(catalog: Catalog) -> str:
    return catalog.publish("demand_profile", demand_profile(catalog.read("cleaned_trips")))


def build_all(
    spark: SparkSession, months_spec: str, root: str, manifest: list[dict] | None = None,
    raw_dir: str | None = None,
) -> Catalog:
    """Verify the raw files against the manifest, clean them, build both feature tables."""
    raw_dir = raw_dir or f"{str(root).rstrip('/')}/raw"
    if manifest is not None:
        require_verified(file_hashes(spark, raw_dir), manifest_table(spark, manifest))
    catalog = Catalog(spark, root)
    publish_cleaned(catalog, raw_dir, parse_months(months_spec))
    build_features(catalog)
    return catalog
