"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours point at its least neighbour, or at itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point at the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    lower = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def stars(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) that is not the least of its component.

    The table never grows and every round at least halves long paths in practice; each
    round is written to shared storage, and only a count and a checksum reach the driver.
    """
    links = links.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    links = stored(links.distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links = stored(_small_star(_large_star(links)), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
