"""One registered query per operator, over the given tables.

Doubles are rounded to 6 places, so that sums taken in another order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import CANCELLED, COMPLETED, MATCHED, PICKED_UP, REQUESTED
from ..functions import clock
from ..operators import (
    cleaning,
    contracts,
    dispatch,
    evaluate,
    events as ev,
    generate,
    geo,
    matching,
    panel,
    profile,
    split,
)
from ..session import configure, scratch_path
from ..sources import catalog, testdata as td, verify
from ..streaming import live, runs

HORIZON_MIN = 30 * 24 * 60.0
SEED = 7
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Rounded doubles, no negative zero."""
    return df.selectExpr(
        *[
            f"round(`{name}`, 6) + 0.0D AS `{name}`" if kind == "double" else f"`{name}`"
            for name, kind in df.dtypes
        ]
    )


_stored: dict[tuple[str, str, str], str] = {}


class Tables:
    """The given tables and what the operators start from.

    Raw trips, cleaned trips and the event log are files for their operators, so they
    are derived and written once per application and read back from there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = configure(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return td.table(self.spark, self.sf_dir, name)

    def stored_path(self, name: str, derive: Callable[[], DataFrame]) -> str:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            _stored[key] = runs.save_table(derive(), name)
        return _stored[key]

    def in_order(self, name: str, derive: Callable[[], DataFrame], ts: str) -> str:
        """Several files in time order, for streams of several batches."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            _stored[key] = runs.save_in_order(derive(), name, ts)
        return _stored[key]

    def stored(self, name: str, derive: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(self.stored_path(name, derive))

    def raw(self) -> DataFrame:
        return self.stored("raw-trips", lambda: td.raw_trips(self.events))

    def cleaned(self) -> DataFrame:
        return cleaning.clean_trips(self.raw(), td.START, td.END)

    def trips(self) -> DataFrame:
        return self.stored("cleaned-trips", self.cleaned)

    def shipping(self) -> DataFrame:
        return self.stored(
            "shipping-trips",
            lambda: td.shipping_trips(self.lineitem).repartitionByRange("month"),
        )

    def panel(self) -> DataFrame:
        return panel.dense_grid(panel.hourly_counts(self.trips()))

    def profile(self) -> DataFrame:
        return profile.demand_profile(self.trips())

    def log_path(self) -> str:
        return self.stored_path("event-log", lambda: td.ride_events(self.events))

    def log(self) -> DataFrame:
        return self.spark.read.parquet(self.log_path())

    def distances(self) -> DataFrame:
        return geo.zone_distances(td.centroids(self.events))

    def fleet_size(self):
        users = self.events.select("user_id").distinct()
        return users.agg(F.count(F.lit(1)).alias("n")).scalar()

    def month(self):
        lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (td.START, td.END))
        return lo, hi

    def zones(self) -> DataFrame:
        return panel.zones_table(self.spark)

    def units(self) -> DataFrame:
        """Mean value per user before and after the middle of the month."""
        early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
        return (
            self.events.groupBy("user_id")
            .agg(
                F.avg(F.when(early, F.col("value"))).alias("pre"),
                F.avg(F.when(~early, F.col("value"))).alias("post"),
            )
            .where(F.col("pre").isNotNull() & F.col("post").isNotNull())
            .withColumn("arm", F.col("user_id") % 2)
        )

    def scored(self) -> DataFrame:
        """A risk score and the cancellation label of finished riders."""
        score = F.col("value") / (F.col("value") + 50.0)
        return ev.risk_label(self.log()).join(
            self.events.select(F.col("event_id").alias("rider_id"), score.alias("score")),
            "rider_id",
        )


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(build(Tables(spark, sf_dir)))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


# ---- scans and cleaning --------------------------------------------------------


@query
def scan_raw_trips(t):
    return cleaning.project_raw(t.raw())


@query
def scan_multi(t):
    """Two stored months of differing types read as one table."""
    early = F.col("tpep_pickup_datetime") < F.lit("2024-01-16").cast("timestamp_ntz")
    raw, folder = t.raw(), scratch_path(t.spark, "raw-months")
    other = {"passenger_count": "bigint", "PULocationID": "int", "DOLocationID": "int"}
    retyped = raw.withColumns({c: F.col(c).cast(kind) for c, kind in other.items()})
    raw.where(early).write.parquet(catalog.raw_month_path(folder, "2024-01"))
    retyped.where(~early).write.parquet(catalog.raw_month_path(folder, "2024-02"))
    both = catalog.read_raw_months(t.spark, folder, ["2024-01", "2024-02"])
    return cleaning.project_raw(both)


@query
def verify_files(t):
    """Page contents as files: some promised hashes are wrong, missing or not listed."""
    html = F.col("html").cast("binary")
    kind = F.col("page_id") % 7
    hashes = t.pages.select(
        "page_id",
        F.col("page_id").cast("string").alias("name"),
        F.octet_length(html).cast("long").alias("length"),
        F.sha2(html, 256).alias("sha256"),
    )
    promised = F.when(kind == 1, "0" * 64).when(kind != 2, F.upper("sha256")).alias("sha256")
    return verify.verify_files(hashes, hashes.where(kind != 3).select("name", promised))


@query
def clean_trips(t):
    return t.cleaned()


@query
def clean_months(t):
    filed = t.shipping()
    months = [r.month for r in filed.select("month").distinct().collect()]  # a calendar's worth
    return cleaning.clean_months(filed, months)


@query
def dedupe_trips(t):
    return cleaning.dedupe_trips(cleaning.project_raw(t.raw()))


@query
def union_months(t):
    raw = t.raw()
    middle = "2024-01-16"
    return cleaning.union_trips(
        cleaning.clean_trips(raw, td.START, middle), cleaning.clean_trips(raw, middle, td.END)
    )


# ---- contracts -----------------------------------------------------------------

_TEXT_CONTRACT = contracts.Contract(
    "text_trips",
    (
        contracts.Field("event_id", "bigint"),
        contracts.Field("zone", "bigint", rule=contracts.in_range(1, 263)),
        contracts.Field("amount", "double", rule=contracts.at_least(0)),
    ),
)


@query
def check_coerce(t):
    """Zones and amounts as text, every 9th zone and 11th amount unreadable."""
    e = F.col("event_id")
    text = t.events.select(
        e.cast("string").alias("event_id"),
        F.when(e % 9 == 0, F.concat(F.lit("zone "), e)).otherwise((e % 265).cast("string")).alias(
            "zone"
        ),
        F.when(e % 11 == 0, F.lit("n/a")).otherwise((e % 100 - 1).cast("string")).alias("amount"),
    )
    return contracts.check(text, _TEXT_CONTRACT)


def _dirty(t) -> DataFrame:
    trips = cleaning.dedupe_trips(cleaning.project_raw(t.raw()))
    return trips.withColumn(
        "trip_distance",
        F.when(F.col("passenger_count") == 6, F.lit(float("nan"))).otherwise(
            F.col("trip_distance")
        ),
    )


@query
def check_nulls(t):
    report = contracts.check(_dirty(t), contracts.CLEANED_TRIPS)
    return report.where(F.col("rule") == "not_null").drop("sample")


@query
def check_ranges(t):
    report = contracts.check(_dirty(t), contracts.CLEANED_TRIPS)
    return report.where(~F.col("rule").isin("not_null", "coerce")).drop("sample")


@query
def check_report(t):
    """The whole report for a table with a missing and an extra column."""
    wrong = t.trips().withColumnRenamed("duration_min", "minutes")
    return contracts.check(wrong, contracts.CLEANED_TRIPS)


# ---- demand --------------------------------------------------------------------


@query
def hourly_counts(t):
    return panel.hourly_counts(t.trips())


@query
def dense_grid(t):
    return t.panel()


@query
def calendar_features(t):
    """Calendar of every ship date."""
    days = t.lineitem.select(F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).distinct()
    return panel.add_calendar(days)


@query
def demand_lags(t):
    return panel.add_lags(t.panel())


@query
def demand_rolls(t):
    return panel.add_rolling_means(t.panel())


@query
def demand_features(t):
    return panel.demand_features(t.trips())


@query
def extended_features(t):
    """The first half of the month, and the second half added from the carried hours."""
    late = F.col("pickup_ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    first = t.stored("first-half", lambda: panel.demand_features(t.trips().where(~late)))
    carry = t.stored("carried-hours", lambda: panel.carry_over(first))
    return first.unionByName(panel.later_features(t.trips().where(late), carry))


@query
def time_split(t):
    return split.time_split(t.events.select("event_id", "ts"), "ts")


@query
def eta_features(t):
    return split.eta_features(t.trips())


@query
def split_balance(t):
    return split.split_balance(split.eta_features(t.trips()))


@query
def demand_profile(t):
    return t.profile()


@query
def weekly_totals(t):
    return profile.weekly_totals(t.profile())


@query
def active_zones(t):
    return profile.active_zones(t.profile())


@query
def zone_weights(t):
    return profile.zone_weights(t.profile())


@query
def arrival_rate(t):
    events = t.events.select("event_id", "ts", (F.col("user_id") % 300).alias("zone_id"))
    return profile.arrival_rate(events, t.profile(), "zone_id", "ts")


@query
def expected_arrivals(t):
    lo, hi = t.month()
    return profile.expected_arrivals(
        t.profile(), t.zones(), clock.add_minutes(lo, F.lit(30.5)), clock.add_minutes(hi, F.lit(-7.25))
    )


# ---- zones ---------------------------------------------------------------------


@query
def zone_lookup(t):
    """Names of the zones events happen in, and the id each name leads back to."""
    zones = td.named_zones(t.part)
    events = t.events.select("event_id", (F.col("user_id") % 300).alias("zone_id"))
    named = geo.name_zones(events, zones, "zone_id")
    back = geo.ids_by_name(zones).select(
        F.col("zone").alias("zone_name"), F.col("zone_id").alias("id_of_name")
    )
    return named.join(F.broadcast(back), "zone_name", "left")


@query
def zone_distances(t):
    return t.distances()


@query
def travel_time(t):
    trips = cleaning.project_raw(t.raw()).select("pickup_ts", "pu_location_id", "do_location_id")
    return geo.add_travel_time(trips, t.distances(), "pu_location_id", "do_location_id")


@query
def leg_times(t):
    e = F.col("event_id")
    rides = t.events.select(
        e.alias("rider_id"),
        (F.col("user_id") * 7 % 263 + 1).alias("driver_zone"),
        (F.col("user_id") % 263 + 1).alias("origin"),
        (e % 263 + 1).alias("dest"),
        F.col("ts").alias("match_ts"),
    )
    return geo.leg_times(rides, t.distances())


# ---- matching ------------------------------------------------------------------


def _tick(t):
    return td.tick_riders(t.events), td.tick_drivers(t.events), t.distances()


@query
def drivers_in_radius(t):
    return matching.drivers_in_radius(*_tick(t))


@query
def nearest_driver(t):
    return matching.nearest_driver(*_tick(t))


@query
def assign_fifo(t):
    return matching.assign_fifo(*_tick(t))


@query
def closest_drivers(t):
    return dispatch.closest_drivers(*_tick(t), k=3)


# ---- event log -----------------------------------------------------------------


@query
def event_union(t):
    """Tables of single kinds, each with its own fields, as one log."""
    log = t.log()
    fields = {
        REQUESTED: ["rider_id", "zone_id"],
        MATCHED: ["rider_id", "driver_id", "wait_min"],
        CANCELLED: ["rider_id", "zone_id", "wait_min"],
        PICKED_UP: ["rider_id", "driver_id"],
        COMPLETED: ["rider_id", "driver_id", "zone_id"],
    }
    parts = [
        log.where(F.col("kind") == kind).select("seq", "kind", "ts", *columns)
        for kind, columns in fields.items()
    ]
    return ev.event_union(*parts)


@query
def event_order(t):
    return ev.event_order(t.log(), "driver_id").select("driver_id", "ts", "seq", "position")


@query
def lifecycle_order(t):
    return ev.lifecycle_order(t.log())


@query
def rider_outcome(t):
    return ev.rider_outcome(t.log())


@query
def risk_label(t):
    return ev.risk_label(t.log())


@query
def patience_cancels(t):
    return ev.patience_cancels(t.log())


@query
def ride_spans(t):
    return ev.ride_spans(t.log())


@query
def double_booking(t):
    return ev.double_booking(t.log())


@query
def illegal_transitions(t):
    return ev.illegal_transitions(t.log())


@query
def invariants(t):
    """Conservation rules; the fleet leaves out every 10th user."""
    fleet = t.events.where(F.col("user_id") % 10 != 0).select(
        F.col("user_id").alias("driver_id")
    )
    return ev.invariants(t.log(), fleet.distinct())


@query
def ride_metrics(t):
    return ev.ride_metrics(t.log(), t.fleet_size(), HORIZON_MIN)


# ---- generators ----------------------------------------------------------------


@query
def sample_arrivals(t):
    return generate.sample_arrivals(t.profile(), t.zones(), *t.month(), seed=SEED)


@query
def place_fleet(t):
    drivers = t.customer.select(F.col("c_custkey").alias("driver_id"))
    return generate.place_fleet(drivers, profile.zone_weights(t.profile()), SEED)


@query
def draw_destinations(t):
    riders = t.events.select(
        F.col("event_id").alias("rider_id"), (F.col("user_id") % 263 + 1).alias("origin")
    )
    return generate.draw_destinations(riders, profile.zone_weights(t.profile()), SEED)


# ---- streaming -----------------------------------------------------------------


def _log_stream(t):
    path = t.in_order("live-log", t.log, "ts")
    return runs.stream_in_order(t.spark, path, t.log().schema)


@query
def live_ride_metrics(t):
    return live.run_live_metrics(_log_stream(t), "metrics", t.log(), t.fleet_size(), HORIZON_MIN)


@query
def live_hourly_counts(t):
    path = t.in_order("live-events", lambda: t.events, "ts")
    events = runs.stream_in_order(t.spark, path, t.events.schema)
    stream = events.select("ts", (F.col("user_id") % 263 + 1).alias("zone"))
    return live.latest_counts(
        runs.run_update(live.live_hourly_counts(stream, "zone", "ts"), "hourly")
    )


@query
def live_patience_cancels(t):
    found = runs.run_append(live.live_patience_cancels(_log_stream(t)), "patience")
    return live.finish_patience(found, t.log())


@query
def live_illegal_transitions(t):
    return live.run_lifecycle_check(_log_stream(t), "lifecycle")


@query
def live_unique_trips(t):
    path = t.in_order("live-trips", t.raw, "tpep_pickup_datetime")
    raw = runs.stream_in_order(t.spark, path, t.raw().schema)
    return runs.run_append(live.live_unique_trips(raw, td.START, td.END), "unique")


# ---- evaluation ----------------------------------------------------------------


def _naive(t, season=168):
    return evaluate.seasonal_naive(t.panel(), season)


@query
def seasonal_naive(t):
    return _naive(t)


@query
def backtest_folds(t):
    return evaluate.backtest_folds(_naive(t), min_train_weeks=1)


@query
def forecast_errors(t):
    return evaluate.forecast_errors(
        _naive(t).where(F.col("forecast").isNotNull()), by=["zone_id"]
    )


def _calibration(t):
    return _naive(t).where(F.col("forecast").isNotNull()).withColumn(
        "residual", F.col("pickups") - F.col("forecast")
    )


@query
def conformal(t):
    """Half widths per hour of day from the residuals of the seasonal forecast."""
    rows = _calibration(t).withColumn("hour", clock.hour_of_day(F.col("ts")))
    return evaluate.conformal_widths(rows, "residual", 0.01, ["hour"])


@query
def coverage(t):
    rows = _calibration(t)
    width = evaluate.conformal_widths(rows, "residual", 0.02).scalar()
    return evaluate.coverage(evaluate.add_interval(rows, width), "pickups", 0.98)


@query
def training_set(t):
    return evaluate.training_set(panel.demand_features(t.trips()))


@query
def weather_features(t):
    """Hourly weather from error events on the panel."""
    weather = t.events.where(F.col("event_type") == "error").select(
        "ts", F.col("value").alias("precip")
    )
    return evaluate.join_weather(t.panel(), weather)


@query
def threshold_sweep(t):
    return evaluate.threshold_sweep(t.scored(), "score", "cancelled", THRESHOLDS)


@query
def calibration_bins(t):
    return evaluate.calibration_bins(t.scored(), "score", "cancelled")


@query
def ab_test(t):
    return evaluate.ab_test(t.events.withColumn("arm", F.col("user_id") % 2), "arm", "value")


@query
def ab_power(t):
    return evaluate.ab_power(t.events, "value", 0.5, ["event_type"])


@query
def cuped(t):
    adjusted = evaluate.cuped(t.units(), "post", "pre")
    return evaluate.ab_test(adjusted, "arm", "adjusted")


@query
def cuped_report(t):
    return evaluate.cuped_report(t.units(), "post", "pre")


@query
def peeking_inflation(t):
    return evaluate.peeking_inflation(t.events, ["event_id"], "value", "ts", 100, 10, SEED)


@query
def bootstrap_mean(t):
    return evaluate.bootstrap_mean(t.events, ["event_id"], "value", 100, SEED)


@query
def off_policy_value(t):
    """Logged action A for purchases and signups; the target policy favours A."""
    a = F.col("event_type").isin("purchase", "signup")
    log = t.events.select(
        F.when(a, 0.4).otherwise(0.6).alias("b"),
        F.when(a, 0.8).otherwise(0.2).alias("pi"),
        F.col("value").alias("r"),
        F.when(a, 105.0).otherwise(95.0).alias("q"),
        F.lit(0.8 * 105.0 + 0.2 * 95.0).alias("v"),
    )
    return evaluate.off_policy_value(log, "b", "pi", "r", "q", "v")


@query
def psi(t):
    """Drift of the value distribution between the two halves of the month."""
    rows = t.events.withColumn("bin", F.least(F.floor(F.col("value") / 10), F.lit(20)))
    return evaluate.psi(rows, "bin", F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))


@query
def latency(t):
    return evaluate.latency_percentiles(t.events, "value")
