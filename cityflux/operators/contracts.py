"""Data contracts: declared columns, checked in one aggregation before publishing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..constants import (
    CANCELLED,
    COMPLETED,
    HOURS_PER_WEEK,
    MATCHED,
    MAX_DURATION_MIN,
    MAX_TRIP_MILES,
    PICKED_UP,
    REPOSITIONED,
    REQUESTED,
    ZONE_MAX,
    ZONE_MIN,
)


class ContractViolation(RuntimeError):
    """A table breaks its contract; the message lists every failed rule."""


@dataclass(frozen=True)
class Rule:
    """``span``: it holds for all values between two for which it holds."""

    name: str
    holds: Callable[[Column], Column]
    span: bool = False


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = False
    rule: Rule | None = None


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    strict: bool = True

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]


def in_range(low, high, include_low: bool = True) -> Rule:
    left = "[" if include_low else "("
    return Rule(
        f"in_range{left}{low},{high}]",
        lambda c: ((c >= low) if include_low else (c > low)) & (c <= high),
        span=True,
    )


def at_least(low) -> Rule:
    return Rule(f"ge[{low}]", lambda c: c >= low, span=True)


def one_of(*values: str) -> Rule:
    return Rule(f"isin[{','.join(values)}]", lambda c: c.isin(*values))


def _schema_failures(df: DataFrame, contract: Contract) -> list[tuple[str, str]]:
    """Rules decided by the schema alone."""
    have, want = set(df.columns), set(contract.columns)
    out = [("missing_column", c) for c in contract.columns if c not in have]
    if contract.strict:
        out += [("extra_column", c) for c in df.columns if c not in want]
    return out


def _is_null(df: DataFrame, name: str, value: Column) -> Column:
    floating = dict(df.dtypes).get(name) in ("double", "float")
    return value.isNull() | F.isnan(value) if floating else value.isNull()


def _coerced(field: Field) -> Column:
    return F.col(f"`{field.name}`").try_cast(field.type)


def _row_rules(df: DataFrame, contract: Contract) -> list[tuple[str, str, Column]]:
    """(rule, column, failed) for every rule that needs the rows."""
    out = []
    present = set(df.columns)
    for field in contract.fields:
        if field.name not in present:
            continue
        raw = F.col(f"`{field.name}`")
        value = _coerced(field)
        null = _is_null(df, field.name, raw)
        as_is = dict(df.dtypes)[field.name] == field.type
        out.append(("coerce", field.name, F.lit(False) if as_is else ~null & value.isNull()))
        if not field.nullable:
            out.append(("not_null", field.name, null))
        if field.rule is not None:
            ok = F.coalesce(field.rule.holds(value), F.lit(True))
            out.append((field.rule.name, field.name, ~null & ~ok))
    return out


def check(df: DataFrame, contract: Contract) -> DataFrame:
    """(rule, column, failures, sample) for every rule, found in one aggregation.

    ``sample`` is one offending value as text.
    """
    rules = _row_rules(df, contract)
    schema_rows = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(column).alias("column"),
            F.lit(1).cast("long").alias("failures"),
            F.lit(None).cast("string").alias("sample"),
        )
        for rule, column in _schema_failures(df, contract)
    ]
    aggregates, rows = [], []
    for i, (rule, column, failed) in enumerate(rules):
        aggregates.append(F.count_if(failed).alias(f"n{i}"))
        aggregates.append(
            F.max(F.when(failed, F.col(f"`{column}`").cast("string"))).alias(f"s{i}")
        )
        rows.append(
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(column).alias("column"),
                F.col(f"n{i}").alias("failures"),
                F.col(f"s{i}").alias("sample"),
            )
        )
    aggregates.append(F.count(F.lit(1)).alias("_rows"))
    return (
        df.agg(*aggregates)
        .select(F.explode(F.array(*schema_rows, *rows)).alias("r"))
        .select("r.*")
    )


def failures(report: DataFrame) -> list[str]:
    """Failed rules as text; the report has one row per rule."""
    return [
        f"{r['column']}: {r['rule']} failed for {r['failures']} rows"
        + (f" (e.g. {r['sample']})" if r["sample"] is not None else "")
        for r in report.where(F.col("failures") > 0).orderBy("column", "rule").collect()
    ]


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared columns in declared order and type (extra ones kept if allowed)."""
    extra = [] if contract.strict else [c for c in df.columns if c not in contract.columns]
    return df.select(
        *[_coerced(f).alias(f.name) for f in contract.fields], *[F.col(f"`{c}`") for c in extra]
    )


def _broken(df: DataFrame, contract: Contract) -> Column:
    """Does a row break any rule?"""
    return reduce(or_, [failed for _, _, failed in _row_rules(df, contract)])


def _refuse(df: DataFrame, contract: Contract) -> None:
    found = failures(check(df, contract))
    raise ContractViolation(f"{contract.name}: " + "; ".join(found))


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """The conformed table, or :class:`ContractViolation` naming every failed rule.

    A good table costs one count; the report is only made for a bad one.
    """
    if _schema_failures(df, contract) or df.agg(F.count_if(_broken(df, contract))).head()[0]:
        _refuse(df, contract)
    return conform(df, contract)


def _seen(watch: Observation) -> dict | None:
    """What an observation counted; None if adaptive execution, finding some input empty,
    left out the part of the plan that counts."""
    try:
        return watch.get
    except Py4JJavaError:
        return None


def observed(df: DataFrame, contract: Contract, extra: tuple[str, ...] = ()):
    """The conformed table, its rows counted and judged during its next action.

    Returns (table, verdict): run an action on the table, then ``verdict()`` gives the
    row count or raises with the report. ``extra`` names layout columns that are not
    part of the contract.
    """
    visible = df.drop(*extra)
    if _schema_failures(visible, contract):
        _refuse(visible, contract)
    watch = Observation()
    marked = df.withColumn("_broken", _broken(visible, contract))
    table = (
        marked.observe(
            watch,
            F.count(F.lit(1)).alias("rows"),
            F.count_if("_broken").alias("broken"),
            *_statistics(visible, contract),
        )
        .select(*[_coerced(f).alias(f.name) for f in contract.fields], *[F.col(c) for c in extra])
    )

    def verdict() -> int:
        seen = _seen(watch)
        if seen is None:
            enforce(visible, contract)
            return visible.count()
        if seen["broken"]:
            _refuse(visible, contract)
        verdict.statistics = {k: None if v is None else str(v) for k, v in seen.items() if k != "broken"}
        return seen["rows"]

    verdict.statistics = None
    return table, verdict


def _statistics(df: DataFrame, contract: Contract) -> list[Column]:
    """What the rules can be judged by later: nulls, least and greatest value per column."""
    out = []
    for field in contract.fields:
        value = _coerced(field)
        known = F.when(~F.isnan(value), value) if field.type in ("double", "float") else value
        if not field.nullable:
            out.append(F.count_if(known.isNull()).alias(f"nulls {field.name}"))
        if field.rule is not None and field.rule.span:
            out += [F.min(known).alias(f"min {field.name}"), F.max(known).alias(f"max {field.name}")]
    return out


def undecided(spark: SparkSession, contract: Contract, statistics: list[dict]) -> list[str] | None:
    """Columns whose rules the statistics of a table's versions leave open; None if they break one.

    Nulls are counted; a rule that holds for a span of values holds if it does for the least and
    the greatest. Others, such as lists of values, need the rows.
    """
    checks, left = [], []
    for field in contract.fields:
        for found in statistics:
            if not field.nullable and found.get(f"nulls {field.name}") != "0":
                return None
            if field.rule is not None and field.rule.span:
                if f"min {field.name}" not in found:
                    return None
                ends = [found[f"{end} {field.name}"] for end in ("min", "max")]
                checks += [field.rule.holds(F.lit(x).cast(field.type)) for x in ends if x is not None]
        if field.rule is not None and not field.rule.span:
            left.append(field.name)
    if checks and not spark.range(1).select(reduce(and_, checks).alias("ok")).first()[0]:
        return None
    return left


def part_of(contract: Contract, columns: Sequence[str]) -> Contract:
    """The contract of some of its columns."""
    return Contract(contract.name, tuple(f for f in contract.fields if f.name in columns), contract.strict)


def judged_types(df: DataFrame, contract: Contract):
    """``df`` and a verdict on its schema and on values of the wrong type.

    Missing columns raise at once; values are counted while the next action reads them,
    and ``verdict()`` raises with the report if some do not fit. Nulls and ranges are not
    judged.
    """
    if _schema_failures(df, contract):
        _refuse(df, contract)
    watch = Observation()
    wrong = reduce(or_, [bad for rule, _, bad in _row_rules(df, contract) if rule == "coerce"])
    table = df.observe(watch, F.count_if(wrong).alias("wrong"))

    def verdict() -> int:
        seen = _seen(watch)
        if df.agg(F.count_if(wrong)).head()[0] if seen is None else seen["wrong"]:
            found = check(df, contract).where("rule = 'coerce'")
            raise ContractViolation(f"{contract.name}: " + "; ".join(failures(found)))
        return 0

    return table, verdict


_ZONE = in_range(ZONE_MIN, ZONE_MAX)
_DISTANCE = in_range(0.0, MAX_TRIP_MILES, include_low=False)
_DURATION = in_range(0.0, MAX_DURATION_MIN, include_low=False)
_COUNT = at_least(0)

RAW_TRIPS = Contract(
    "raw_trips",
    (
        Field("tpep_pickup_datetime", "timestamp_ntz"),
        Field("tpep_dropoff_datetime", "timestamp_ntz"),
        Field("passenger_count", "double", nullable=True),
        Field("trip_distance", "double"),
        Field("PULocationID", "bigint"),
        Field("DOLocationID", "bigint"),
    ),
    strict=False,
)
CLEANED_TRIPS = Contract(
    "cleaned_trips",
    (
        Field("pickup_ts", "timestamp_ntz"),
        Field("dropoff_ts", "timestamp_ntz"),
        Field("pu_location_id", "bigint", rule=_ZONE),
        Field("do_location_id", "bigint", rule=_ZONE),
        Field("trip_distance", "double", rule=_DISTANCE),
        Field("passenger_count", "bigint", nullable=True, rule=_COUNT),
        Field("duration_min", "double", rule=_DURATION),
    ),
)
DEMAND_FEATURES = Contract(
    "demand_features",
    (
        Field("zone_id", "bigint", rule=_ZONE),
        Field("ts", "timestamp_ntz"),
        Field("pickups", "bigint", rule=_COUNT),
        Field("hour", "bigint", rule=in_range(0, 23)),
        Field("dow", "bigint", rule=in_range(0, 6)),
        Field("is_holiday", "boolean"),
        Field("lag_1h", "double", nullable=True),
        Field("lag_24h", "double", nullable=True),
        Field("lag_168h", "double", nullable=True),
        Field("roll_mean_24h", "double", nullable=True),
        Field("roll_mean_168h", "double", nullable=True),
    ),
)
DEMAND_CARRY = Contract("demand_carry", DEMAND_FEATURES.fields[:3])
ETA_FEATURES = Contract(
    "eta_features",
    (
        Field("pickup_ts", "timestamp_ntz"),
        Field("pu_location_id", "bigint", rule=_ZONE),
        Field("do_location_id", "bigint", rule=_ZONE),
        Field("hour", "bigint", rule=in_range(0, 23)),
        Field("dow", "bigint", rule=in_range(0, 6)),
        Field("trip_distance", "double", rule=_DISTANCE),
        Field("passenger_count", "bigint", nullable=True, rule=_COUNT),
        Field("duration_min", "double", rule=_DURATION),
        Field("split", "string", rule=one_of("train", "holdout")),
    ),
)
DEMAND_PROFILE = Contract(
    "demand_profile",
    (
        Field("zone_id", "bigint", rule=_ZONE),
        Field("how", "bigint", rule=in_range(0, HOURS_PER_WEEK - 1)),
        Field("rate_per_hour", "double", rule=_COUNT),
    ),
)
EVENT_LOG = Contract(
    "event_log",
    (
        Field("seq", "bigint"),
        Field(
            "kind",
            "string",
            rule=one_of(REQUESTED, MATCHED, CANCELLED, PICKED_UP, COMPLETED, REPOSITIONED),
        ),
        Field("ts", "timestamp_ntz"),
        Field("rider_id", "bigint", nullable=True),
        Field("driver_id", "bigint", nullable=True),
        Field("zone_id", "bigint", nullable=True),
        Field("to_zone_id", "bigint", nullable=True),
        Field("wait_min", "double", nullable=True),
    ),
)
MANIFEST = Contract(
    "manifest",
    (
        Field("name", "string", rule=Rule("non_empty", lambda c: F.length(c) > 0)),
        Field("url", "string", rule=Rule("non_empty", lambda c: F.length(c) > 0)),
        Field("sha256", "string", nullable=True),
        Field("kind", "string", rule=one_of("parquet", "csv", "zip")),
    ),
)
CONTRACTS = {
    c.name: c
    for c in (CLEANED_TRIPS, DEMAND_FEATURES, DEMAND_CARRY, ETA_FEATURES, DEMAND_PROFILE, EVENT_LOG)
}
