"""Bucketed windows equal plain ones, also when one key holds most rows."""

from datetime import timedelta

import numpy as np
import pytest
from frames import at
from pyspark.sql import Window, functions as F

from cityflux.operators.ordered import next_value, previous_value, running_total

START = at("2024-01-01 00:00")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(900):
        key = 1 if i % 3 else int(rng.integers(2, 40))
        ts = START + timedelta(minutes=int(rng.integers(0, 2000)) * (key % 7 + 1))
        out.append((key, ts, i, None if i % 11 == 0 else int(rng.integers(0, 9))))
    return spark.createDataFrame(out, "k bigint, ts timestamp_ntz, seq bigint, v bigint").cache()


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("unit", ["second", "minute", "hour", "day"])
def test_equal_to_plain_windows(rows, unit):
    w = Window.partitionBy("k").orderBy("ts", "seq")
    columns = ["k", "ts", "seq", "v", "out"]
    args = (["k"], ["ts", "seq"])
    same(
        previous_value(rows, *args, F.col("v"), "out", unit).select(columns),
        rows.withColumn("out", F.lag("v").over(w)).select(columns),
    )
    same(
        next_value(rows, *args, F.col("v"), "out", unit).select(columns),
        rows.withColumn("out", F.lead("v").over(w)).select(columns),
    )
    value = F.coalesce("v", F.lit(0)) - 4
    same(
        running_total(rows, *args, value, "out", unit).select(columns),
        rows.withColumn(
            "out", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        ).select(columns),
    )


def test_hot_key_is_cut_up(rows):
    """The wide window partitions by key and bucket, not by key alone."""
    plan = (
        previous_value(rows, ["k"], ["ts", "seq"], F.col("v"), "out")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "hashpartitioning(k" in plan and "_bucket" in plan
