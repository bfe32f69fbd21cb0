"""Logical table names over parquet storage, and publishing after validation."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.contracts import (
    CONTRACTS,
    ContractViolation,
    conform,
    enforce,
    observed,
    part_of,
    undecided,
)
from . import files

TABLES = {
    "cleaned_trips": "processed/cleaned_trips",
    "demand_features": "processed/demand_features",
    "eta_features": "processed/eta_features",
    "demand_carry": "processed/demand_carry",
    "demand_profile": "processed/demand_profile",
    "event_log": "processed/event_log",
}
# Columns the rows are laid out by on storage (enough of them to split a crowded
# timestamp into ranges), and tables split into month folders.
SORT_KEYS = {
    "cleaned_trips": ["pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id"],
    "demand_features": ["zone_id", "ts"],
    "demand_carry": ["zone_id", "ts"],
    "eta_features": ["pickup_ts"],
    "demand_profile": ["zone_id", "how"],
    "event_log": ["ts", "seq"],
}
MONTHLY = {"cleaned_trips": "month", "demand_features": "month"}
POINTER = "_current.json"
STATISTICS = "_statistics"


class Catalog:
    """Tables by name. A table is a folder of versions and a small file that names the
    current one, month by month where the table has months.

    A version is written and judged first; replacing the small file then makes it the
    table in one step, so readers see the old rows or the new ones and never none. The
    version before stays for readers under way.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = str(root).rstrip("/")

    @staticmethod
    def datasets() -> list[str]:
        return sorted(TABLES)

    def path(self, name: str) -> str:
        folder = TABLES.get(name)
        if folder is None:
            raise KeyError(f"unknown dataset {name!r}: the catalog has {self.datasets()}")
        return f"{self.root}/{folder}"

    def _current(self, name: str) -> dict[str, str]:
        """Month (or "") -> folder; a table without a pointer is read as it lies."""
        text = files.read_text(self.spark, f"{self.path(name)}/{POINTER}")
        if text is not None:
            return json.loads(text)
        plain = [c for c in files.children(self.spark, self.path(name)) if not c.startswith("v-")]
        return {"": ""} if plain else {}

    def exists(self, name: str) -> bool:
        return bool(self._current(name))

    def read(self, name: str, months: list[str] | None = None) -> DataFrame:
        """The table without layout columns; ``months`` leaves the other folders unread."""
        parts = self._current(name)
        if not parts:
            raise FileNotFoundError(f"{name!r} is not built: nothing at {self.path(name)}")
        wanted = [p for m, p in sorted(parts.items()) if months is None or not m or m in months]
        folders = [f"{self.path(name)}/{p}" for p in wanted or parts.values()]
        df = self.spark.read.parquet(*folders).drop(MONTHLY.get(name, ""))
        return df if wanted else df.limit(0)

    def publish(
        self,
        name: str,
        df: DataFrame,
        allow_empty: bool = False,
        keep_months: bool = False,
        verdicts: Sequence[Callable[[], int]] = (),
    ) -> str:
        """Write a version, check the contract on the way, then make it current.

        A violation raises, leaves the table as it was and removes the version. With
        ``keep_months`` only the months in ``df`` are replaced. ``verdicts`` are judgements
        of inputs that are known once ``df`` has been written.
        """
        target, version = self.path(name), f"v-{uuid.uuid4().hex}"
        staged, layout = f"{target}/{version}", MONTHLY.get(name)
        extra = (layout,) if layout and layout in df.columns else ()
        try:
            table, verdict = observed(df, CONTRACTS[name], extra)
            write_sorted(table, staged, SORT_KEYS[name], extra)
            for judged in verdicts:
                judged()
            if verdict() == 0:
                if not allow_empty:
                    raise ContractViolation(f"{name}: no rows")
                table.drop(*extra).limit(0).write.mode("overwrite").parquet(staged)
        except BaseException:
            files.delete(self.spark, staged)
            raise
        if verdict.statistics:
            told = {"columns": verdict.statistics, "files": files.content(self.spark, staged)}
            files.write_text(self.spark, self._told_path(name, version), json.dumps(told))
        old, label = self._current(name), f"{layout}="
        months = [c for c in files.children(self.spark, staged) if c.startswith(label)]
        new = {c.removeprefix(label): f"{version}/{c}" for c in months} or {"": version}
        if keep_months:
            new = {m: p for m, p in old.items() if m} | new
        files.write_text(self.spark, f"{target}/{POINTER}", json.dumps(new))
        used = {p.split("/")[0] for p in [*old.values(), *new.values()]}
        for child in files.children(self.spark, target):
            if child.startswith("v-") and child not in used:
                files.delete(self.spark, f"{target}/{child}")
                files.delete(self.spark, self._told_path(name, child))
        return target

    def _told_path(self, name: str, version: str) -> str:
        return f"{self.path(name)}/{STATISTICS}/{version}.json"

    def _open_columns(self, name: str, df: DataFrame) -> list[str] | None:
        """Columns that the statistics of the versions do not vouch for; None: all of them.

        Statistics count only if the files are those they were taken from, by number and
        bytes, and the columns have the declared types.
        """
        contract, told = CONTRACTS[name], []
        if dict(df.dtypes) != {f.name: f.type for f in contract.fields}:
            return None
        for version in {part.split("/")[0] for part in self._current(name).values()}:
            text = files.read_text(self.spark, self._told_path(name, version)) if version else None
            found = json.loads(text) if text else None
            if not found or found["files"] != files.content(self.spark, f"{self.path(name)}/{version}"):
                return None
            told.append(found["columns"])
        return undecided(self.spark, contract, told)

    def validate(self, *names: str) -> None:
        """Re-check published tables against their contracts.

        Nulls and spans of values are known from the statistics each version was published
        with; only columns they cannot decide are read, and the whole table if a statistic is
        missing, speaks of other files or breaks a rule.
        """
        for name in names or tuple(n for n in CONTRACTS if self.exists(n)):
            df = self.read(name)
            columns = self._open_columns(name, df)
            if columns is None:
                enforce(df, CONTRACTS[name])
            elif columns:
                enforce(df.select(*columns), part_of(CONTRACTS[name], columns))

    def checked(self, name: str) -> DataFrame:
        """Read a table for a build step and refuse it if it breaks its contract."""
        self.validate(name)
        return conform(self.read(name), CONTRACTS[name])


def write_sorted(df: DataFrame, path: str, keys: list[str], partition_by=()) -> None:
    """Files sorted inside, so row groups prune by time: order as layout only.

    One folder needs no shuffle for that. Several month folders get ranges of
    (month, keys), lest every task writes a file into every folder; ranges come from a
    sample, so a crowded month or hour spreads over several files.
    """
    if partition_by:
        df = df.repartitionByRange(*partition_by, *keys)
    writer = df.sortWithinPartitions(*partition_by, *keys).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def parse_months(spec: str) -> list[str]:
    """``2023-11..2024-01`` -> the months from first to last; one month stands alone."""
    first, _, last = (part.strip() for part in spec.partition(".."))
    if not last and ".." in spec:
        raise ValueError(f"empty month range: {spec}")
    lo = date.fromisoformat(f"{first}-01")
    hi = date.fromisoformat(f"{last}-01") if last else lo
    span = (hi.year - lo.year) * 12 + hi.month - lo.month
    if span < 0:
        raise ValueError(f"empty month range: {spec}")
    numbers = (lo.year * 12 + lo.month - 1 + k for k in range(span + 1))
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in numbers]


def raw_month_path(raw_dir: str, month: str) -> str:
    return f"{str(raw_dir).rstrip('/')}/yellow_tripdata_{month}.parquet"


def read_raw_months(spark: SparkSession, raw_dir: str, months: list[str]) -> DataFrame:
    """Raw trips of several months with the ``month`` of the file they came in.

    A month may be one file or a folder of files. Every month is read with its own types;
    where they differ, the wider one holds for all. Columns that some month lacks are left
    out, so the gate misses the required ones among them.
    """
    parts = [spark.read.parquet(raw_month_path(raw_dir, m)) for m in months]
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    named = [p.select(*common, F.lit(m).alias("month")) for p, m in zip(parts, months)]
    return reduce(DataFrame.unionByName, named)


def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup CSV -> zone_id, zone, borough for the real zones."""
    schema = "LocationID INT, Borough STRING, Zone STRING, service_zone STRING"
    return (
        spark.read.option("header", True)
        .schema(schema)
        .csv(path)
        .where(F.col("LocationID").between(1, 263))
        .select(
            F.col("LocationID").cast("long").alias("zone_id"),
            F.col("Zone").alias("zone"),
            F.col("Borough").alias("borough"),
        )
        .orderBy("zone_id")
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One-row metrics as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
