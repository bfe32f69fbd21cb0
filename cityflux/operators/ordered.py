"""Neighbours and running totals along an order, safe for hot keys.

A plain window over a key puts that key's whole history into one task. Here each
key is cut into time buckets: the window runs inside (key, bucket), and only one
summary row per bucket is windowed over the key, to carry values across buckets.
Results equal the plain window; the largest task is one key's largest bucket.

The explicit ``repartition`` by (key, bucket) costs nothing (the window needs that
exchange anyway) and keeps Spark from settling for an input that is already
partitioned by the key alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import floor_micros

_B, _RN, _IN, _EDGE, _CARRY = "_bucket", "_rn", "_inner", "_edge", "_carry"


def _bucketed(df: DataFrame, order: Sequence[str], unit: str) -> DataFrame:
    return df.withColumn(_B, floor_micros(unit, F.col(order[0])))


def _neighbour(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    unit: str,
    ahead: bool,
) -> DataFrame:
    rows = _bucketed(df.withColumn(_IN, value), order, unit)
    direction = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    inner = Window.partitionBy(*key, _B).orderBy(*direction)
    pick = F.min_by if ahead else F.max_by
    across = Window.partitionBy(*key).orderBy(F.col(_B).desc() if ahead else F.col(_B).asc())
    carry = (
        rows.groupBy(*key, _B)
        .agg(pick(F.struct(F.col(_IN)), F.struct(*order)).alias(_EDGE))
        .withColumn(_CARRY, F.lag(f"{_EDGE}.{_IN}").over(across))
        .drop(_EDGE)
    )
    return (
        rows.repartition(*key, _B)
        .withColumn(_RN, F.row_number().over(inner))
        .withColumn(out, F.lag(_IN).over(inner))
        .join(carry, [*key, _B], "left")
        .withColumn(out, F.when(F.col(_RN) == 1, F.col(_CARRY)).otherwise(F.col(out)))
        .drop(_B, _RN, _IN, _CARRY)
    )


def previous_value(df, key, order, value, out, unit="hour") -> DataFrame:
    """``lag(value)`` per key; ``order[0]`` is a timestamp, key columns are not null.

    ``unit`` is the bucket: second, minute, hour or day.
    """
    return _neighbour(df, key, order, value, out, unit, ahead=False)


def next_value(df, key, order, value, out, unit="hour") -> DataFrame:
    """``lead(value)`` per key; ``order[0]`` is a timestamp, key columns are not null."""
    return _neighbour(df, key, order, value, out, unit, ahead=True)


def running_total(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    unit: str = "hour",
) -> DataFrame:
    """``sum(value)`` up to and with each row; with ``lit(1)`` this is ``row_number``."""
    rows = _bucketed(df.withColumn(_IN, value), order, unit)
    inner = (
        Window.partitionBy(*key, _B)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*key).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        rows.groupBy(*key, _B)
        .agg(F.sum(_IN).alias(_EDGE))
        .withColumn(_CARRY, F.coalesce(F.sum(_EDGE).over(before), F.lit(0)))
        .drop(_EDGE)
    )
    return (
        rows.repartition(*key, _B)
        .withColumn(out, F.sum(_IN).over(inner))
        .join(carry, [*key, _B], "left")
        .withColumn(out, F.col(out) + F.col(_CARRY))
        .drop(_B, _IN, _CARRY)
    )
