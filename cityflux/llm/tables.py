"""Helpers the operators share: cut lineage, column choice, row hashes."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

# Tasks get functions and classes by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage: what was nondeterministic (row numbers) is fixed, nothing is
    computed twice, and a lost executor costs a file read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value):
    """A broadcast of ``value``, pickled so that its class travels along; ``pickle.loads``
    of the broadcast's value gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions_for(amount: float, per_task: float) -> int:
    """Tasks so that each gets about ``per_task``; grows with the input."""
    return max(1, int(-(-amount // per_task)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def keep_rows(docs: DataFrame, marks: DataFrame, id_col: str, text_hash: Column) -> DataFrame:
    """Rows of ``docs`` chosen by ``marks`` (id, hash, copies kept), all columns as they were.

    ``marks`` has one row per kept (id, hash). Rows that repeat such a pair are the same
    row again; one of them stays. Texts stream past a hash table of the small side, so
    they are shuffled but not sorted.
    """
    names = docs.columns
    keyed = docs.withColumn("__id", F.col(id_col)).withColumn("__hash", text_hash)
    marks = marks.select(
        F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("rows").alias("__rows")
    )
    joined = keyed.alias("d").join(
        marks.hint("shuffle_hash").alias("m"),
        F.col("d.__id").eqNullSafe(F.col("m.__id")) & (F.col("d.__hash") == F.col("m.__hash")),
    )
    single = joined.where("__rows = 1").select("d.*").select(names)
    again = joined.where("__rows > 1").select("d.*")
    one = again.groupBy("__id", "__hash").agg(F.min(F.struct(*names)).alias("__row"))
    return single.unionByName(one.select("__row.*"))
