"""Equi join of a big table, some keys of which may be hot, with a small one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# A key is hot when it holds more than one part in SHARE of the big table, so there
# are fewer than SHARE hot keys and their list is safe to broadcast.
SHARE = 1000


def hot_keys(big: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hot keys and the number of pieces each is cut into (``_pieces``)."""
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("total")).scalar()
    return (
        counts.withColumn("_total", total)
        .where(F.col("_n") * SHARE > F.col("_total"))
        .select(*on, F.ceil(F.col("_n") * SHARE / F.col("_total")).cast("int").alias("_pieces"))
    )


def join_spread(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: str, how: str = "inner"
) -> DataFrame:
    """``big.join(small, on, how)`` (inner or left) without a hot task.

    Rows of a hot key are spread over pieces by a hash of ``spread_by``; the rows of the
    small side are repeated for the pieces of hot keys only. Adaptive execution cannot
    split such a join by itself when one side comes straight out of an aggregation. The
    list of hot keys (fewer than ``SHARE`` rows) is looked up first; ``big`` should be a
    stored table. Without hot keys this is the plain join.
    """
    on = list(on)
    found = hot_keys(big, on)
    rows = found.collect()
    if not rows:
        return big.join(small, on, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(rows, found.schema))
    pieces = F.coalesce("_pieces", F.lit(1))
    left = big.join(hot, on, "left").withColumn("_piece", F.pmod(F.xxhash64(spread_by), pieces))
    right = small.join(hot, on, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), (pieces - 1).cast("long")))
    )
    return left.drop("_pieces").join(right.drop("_pieces"), [*on, "_piece"], how).drop("_piece")
