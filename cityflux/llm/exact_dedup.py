"""Exact duplicates with a heavy-hitter split.

1. Each row becomes (id, digest); that thin table is stored.
2. A frequent-items summary of the Misra-Gries family (``approx_top_k``) runs per input
   partition, so no task ever holds more than ``counters`` digests. Its estimates are
   added up by digest. A digest held by ``support`` of all rows cannot be missing: what
   it loses to the summary's error and the local cut is less than what must remain.
3. The candidates are counted exactly with map-side partial aggregates. Those that do
   reach ``support`` are the winners, at most ``1 / support`` of them, so they may be
   broadcast: their rows are decided on the map side and never shuffled.
4. Every other digest has less than ``support`` of the rows and takes an ordinary shuffle.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import keep_rows, stored, text_of

# Runs of these characters count as one space.
BLANKS = r"[\x20\x09-\x0D]+"
# The summary's estimates are off by at most ERROR / counters of the rows summarised.
ERROR = 3.5


def digest(text_col: str) -> Column:
    """SHA-256 (hex) of the text with runs of blanks as one space; null is empty."""
    return F.sha2(F.regexp_replace(text_of(text_col), BLANKS, " "), 256)


def _candidates(rows: DataFrame, support: float, counters: int) -> DataFrame:
    """Digests that may reach ``support``; every one that does is among them."""
    total = rows.count()
    local = (
        rows.groupBy(F.spark_partition_id().alias("part"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.expr(f"approx_top_k(text_sha256, {counters // 2}, {counters})").alias("top"),
        )
        .select("n", F.explode("top").alias("t"))
        .select(F.col("t.item").alias("text_sha256"), F.col("t.count").alias("estimate"), "n")
        .where(F.col("estimate") >= support / 2 * F.col("n"))
    )
    least = (support / 2 - ERROR / counters) * total
    return (
        local.groupBy("text_sha256")
        .agg(F.sum("estimate").alias("estimate"))
        .where(F.col("estimate") >= max(2.0, least))
        .select("text_sha256")
    )


def frequent_digests(rows: DataFrame, support: float, counters: int) -> DataFrame:
    """Verified winners: (text_sha256, first, group_size), at most ``1 / support`` rows."""
    total = rows.count()
    found = F.broadcast(_candidates(rows, support, counters))
    counted = rows.join(found, "text_sha256").groupBy("text_sha256").agg(*_group())
    return counted.where(F.col("group_size") >= max(2.0, support * total))


def _group() -> list[Column]:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return [first.alias("first"), F.count(F.lit(1)).alias("group_size")]


def _decisions(docs: DataFrame, id_col: str, text_col: str, support: float, counters: int):
    """One row per input row with its group's first row and size."""
    rows = stored(
        docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("text_sha256")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "digests",
    )
    winners = stored(frequent_digests(rows, support, counters), "frequent")
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    heavy = marked.where("group_size is not null")
    rest = marked.where("group_size is null").drop("first", "group_size")
    groups = rest.groupBy("text_sha256").agg(*_group())
    return heavy.unionByName(rest.join(groups, "text_sha256"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: float = 1e-3,
    counters: int = 16384,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Null texts count as empty. The smallest id of a group stays; missing ids come last;
    of rows that repeat an id one stays. A group without any id keeps one row and has a
    null ``keep_id``. Empty tables give empty results; further columns are not read.
    """
    return _decisions(docs, id_col, text_col, support, counters).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: float = 1e-3,
    counters: int = 16384,
) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged."""
    decided = _decisions(docs, id_col, text_col, support, counters)
    marks = (
        decided.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
        .groupBy("doc_id", F.col("text_sha256").alias("hash"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return keep_rows(docs, marks, id_col, digest(text_col))
