"""Exact order statistics without a global sort or a one-task window.

Times and whole columns: a wanted rank is narrowed through counts of ever smaller cells,
combined before the shuffle; the number of cells is fixed by the calendar, by the range
of doubles or by ``CELLS``. Per key: the counted values are range-partitioned by key and
value, so a hot key is spread over many tasks, and only sums per task meet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import MICROS, floor_micros, from_micros
from ..session import scratch_path

CELLS = 4096
# Passes until a rank is one value: the first leaves one power of two, and five cuts of a
# 52-bit mantissa by 12 bits leave one value.
PASSES = 7
METHODS = ("linear", "nearest", "conformal")


def _with_offset(cells: DataFrame, order: str, partition: Sequence[str] = ()) -> DataFrame:
    """Add ``_before``: rows in earlier cells. The cells are few by construction."""
    window = Window.partitionBy(*partition).orderBy(order)
    return cells.withColumn(
        "_before",
        F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
    )


def _holding(cells: DataFrame):
    """(at, rank): the one cell that holds ``_rank``, and the rank counted inside it."""
    rank = F.col("_rank")
    inside = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    found = _with_offset(cells, "_at").where(inside)
    return found.select("_at", (rank - F.col("_before")).alias("_rank")).head()


def _counts_per(unit: str, rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(floor_micros(unit, F.col(ts)).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n")
    )


def time_cutoff(df: DataFrame, ts: str, train_fraction: float) -> Column | None:
    """The timestamp at rank ``clamp(int(n * fraction), 1, n - 1)`` as a literal.

    Counts per hour (one row per hour of the calendar) find the hour, counts per
    second (at most 3,600 rows) the second in it, counts per microsecond (at most
    10**6 rows) the value. Three small jobs, one row to the driver each: the bounds
    found are literals, so the later scans skip all other row groups and only the
    first one reads the whole column. ``df`` should be a stored table. None if empty.
    """
    hours = _counts_per("hour", df, ts)
    total = F.sum("_n").over(
        Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    rank = F.least(
        F.greatest(F.floor(total * F.lit(train_fraction)).cast("long"), F.lit(1)), total - 1
    )
    cell = _holding(hours.withColumn("_rank", rank))
    if cell is None:
        return None
    for outer, inner in (("hour", "second"), ("second", "microsecond")):
        start, end = (from_micros(F.lit(us)) for us in (cell[0], cell[0] + MICROS[outer]))
        rows = df.where((F.col(ts) >= start) & (F.col(ts) < end))
        cell = _holding(_counts_per(inner, rows, ts).withColumn("_rank", F.lit(cell[1])))
    return from_micros(F.lit(cell[0]))


def _ranks(method: str, p: float, n: int) -> tuple[int, int, float] | None:
    """0-based ranks of both neighbours and the way from the first to the second.

    None where ``conformal`` asks for a rank beyond the last: no finite value has it.
    """
    if method == "linear":
        at = (n - 1) * p
        return math.floor(at), math.ceil(at), at - math.floor(at)
    rank = max(math.ceil((n + 1 if method == "conformal" else n) * p), 1)
    if rank > n and method == "conformal":
        return None
    return min(rank, n) - 1, min(rank, n) - 1, 0.0


def _binade(v: Column) -> Column:
    """Cells in the order of the values, one per sign and power of two."""
    size = F.abs(v)
    power = F.when(size == math.inf, F.lit(3000.0)).otherwise(F.floor(F.log2(size)) + 1500)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * power)


def _linear(v: Column, low: float, high: float) -> Column:
    """Cells of equal width; halves keep the widest span from overflowing."""
    return F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * CELLS).cast("double")


def values_at_ranks(rows: DataFrame, value: str, low: float, high: float, n: int, ranks) -> dict:
    """The values at some 0-based ranks of ``n`` doubles between ``low`` and ``high``.

    Each pass cuts the spans that hold an open rank into cells, counts them, and keeps
    the cells with the ranks: first by powers of two, then by each cell's own range.
    Infinities are cells of their own, so at most ``PASSES`` passes are needed whatever
    the values. Only counts are shuffled and only the kept cells (one per rank at most)
    reach the driver; the span bounds are literals, which the scans can use.
    """
    v = F.col(value)
    span_of = {rank: (low, high, 0, n) for rank in ranks}
    for at_pass in range(PASSES):
        spans = sorted({s for s in span_of.values() if s[0] < s[1]})
        if not spans:
            break
        cell, number = F.lit(None).cast("double"), F.lit(None).cast("int")
        for i, (lo, hi, _, _) in enumerate(spans):
            inside = v.between(lo, hi)
            cell = F.when(inside, _linear(v, lo, hi) if at_pass else _binade(v)).otherwise(cell)
            number = F.when(inside, F.lit(i)).otherwise(number)
        cells = (
            rows.where(reduce(or_, [v.between(s[0], s[1]) for s in spans]))
            .groupBy(number.alias("_span"), cell.alias("_cell"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        )
        first, count = F.col("_before"), F.col("_n")
        holds = [
            (F.col("_span") == spans.index(span))
            & (first <= rank - span[2])
            & (rank - span[2] < first + count)
            for rank, span in span_of.items()
            if span in spans
        ]
        kept = _with_offset(cells, "_cell", ["_span"]).where(reduce(or_, holds)).collect()
        for rank, span in span_of.items():
            for c in kept:
                if span in spans and spans.index(span) == c["_span"]:
                    start = span[2] + c["_before"]
                    if start <= rank < start + c["_n"]:
                        span_of[rank] = (c["_lo"], c["_hi"], start, c["_n"])
    return {rank: span[0] for rank, span in span_of.items()}


def _between(low: float, high: float, way: float) -> float:
    """The point ``way`` from low to high; equal neighbours stay, infinities included."""
    return low if way == 0 or low == high else low * (1 - way) + high * way


def global_quantiles(
    df: DataFrame, value: str, wanted: dict[str, tuple[str, float]]
) -> dict[str, float | None]:
    """Exact quantiles of a whole column, ``name -> (method, p)``; None if it is empty."""
    rows = df.select(F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    low, high, n = rows.agg(F.min("_v"), F.max("_v"), F.count("_v")).head()
    if not n:
        return dict.fromkeys(wanted)
    ranks = {name: _ranks(method, p, n) for name, (method, p) in wanted.items()}
    open_ranks = sorted({r for found in ranks.values() if found for r in found[:2]})
    found = values_at_ranks(rows, "_v", low, high, n, open_ranks)
    return {
        name: _between(found[at[0]], found[at[1]], at[2]) if at else None
        for name, at in ranks.items()
    }


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """One row per key (or one row) with an exact quantile per name in ``probs``.

    ``linear`` interpolates between the two neighbouring values, ``nearest`` takes
    the value at rank ``ceil(p * n)``, ``conformal`` the one at rank
    ``ceil(p * (n + 1))`` and null where that is beyond ``n``. Nulls and NaN are left out.
    Runs jobs when called; ``df`` should be a stored table.
    """
    if method not in METHODS:
        raise ValueError(f"unknown quantile method {method!r}")
    if keys:
        return _quantiles_per_key(df, value, probs, list(keys), method)
    found = global_quantiles(df, value, {name: (method, p) for name, p in probs.items()})
    schema = ", ".join(f"`{name}` double" for name in probs)
    return df.sparkSession.createDataFrame([tuple(found[name] for name in probs)], schema)


def _quantiles_per_key(
    df: DataFrame, value: str, probs: dict[str, float], keys: list[str], method: str
) -> DataFrame:
    """Keyed form: any number of keys, nothing on the driver.

    Rows are counted per (key, value), and the counts range-partitioned by key and value
    and stored with the number of their task. A task's sum per key gives the rank at
    which the next task starts, so no window holds more than one task's values.
    """
    v, n = F.col("_v"), F.col("_n")
    values = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .repartitionByRange(*keys, "_v")
        .withColumn("_part", F.spark_partition_id())
    )
    path = scratch_path(df.sparkSession, "quantiles")
    values.write.parquet(path)
    values = df.sparkSession.read.schema(values.schema).parquet(path)

    # a row per key and task that holds some of it
    sums = values.groupBy(*keys, "_part").agg(F.sum(n).alias("_n"))
    starts = (
        _with_offset(sums, "_part", keys)
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .drop("_n")
    )
    same = reduce(
        lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"v.{k}")) for k in [*keys, "_part"]]
    )
    placed = values.alias("v").join(starts.alias("s"), same).select("v.*", "s._before", "s._total")
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("_before") + F.sum(n).over(inside) - n
    ranked = placed.withColumn("_first", first)

    total = F.col("_total")
    picks, out = [F.max(total).alias("_total")], []
    for i, (name, p) in enumerate(probs.items()):
        if method == "linear":
            at = (total - 1).cast("double") * F.lit(float(p))
            low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        else:
            at = F.ceil((total + (1 if method == "conformal" else 0)) * F.lit(float(p))).cast("long")
            at = at if method == "conformal" else F.least(at, total)
            low = high = F.greatest(at, F.lit(1).cast("long")) - 1
        for label, rank in (("_low", low), ("_high", high)):
            here = (rank >= F.col("_first")) & (rank < F.col("_first") + n)
            picks.append(F.max(F.when(here, v)).alias(f"{label}{i}"))
        a, b = F.col(f"_low{i}"), F.col(f"_high{i}")
        way = (total - 1).cast("double") * F.lit(float(p))
        way = way - F.floor(way)
        between = F.when((way == 0) | (a == b), a).otherwise(a * (1 - way) + b * way)
        out.append((between if method == "linear" else a).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *out)


# ---- a summary that streams can keep -------------------------------------------

#: cells per power of two of a summary
FINE = 4096


def rank_cell(v: Column) -> Column:
    """Cells in the order of the doubles: sign, power of two and the first 12 bits after it.

    However many values there are, their number is bounded by that of these bits. Null and
    NaN have no cell; infinities and zero have one each.
    """
    size = F.abs(v)
    power = F.greatest(F.least(F.floor(F.log2(size)).cast("double"), F.lit(1023.0)), F.lit(-1074.0))
    inner = F.floor((size / F.pow(F.lit(2.0), power) - 1) * FINE).cast("double")
    cell = F.when(size == math.inf, F.lit(3000.0 * FINE)).otherwise((power + 1075) * FINE + inner + 1)
    cell = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * cell)
    return F.when(v.isNotNull() & ~F.isnan(v), cell).cast("long")


def octave(cell: Column) -> Column:
    """The power of two of a cell: few, so that tables can be laid out by it."""
    return F.floor(cell / FINE).cast("int")


def summary_quantiles(
    cells: DataFrame, rows: DataFrame, value: str, wanted: dict[str, tuple[str, float]]
) -> dict[str, float | None]:
    """Exact quantiles from a summary (cell, n) and the rows of the cells that hold them.

    ``rows`` (cell, octave, ``value``) is asked for at most two cells per quantile; laid out by
    ``octave`` and sorted by cell, the rest of it is not read.
    """
    n = cells.agg(F.sum("n")).first()[0]
    if not n:
        return dict.fromkeys(wanted)
    ranks = {name: _ranks(method, p, n) for name, (method, p) in wanted.items()}
    open_ranks = sorted({r for found in ranks.values() if found for r in found[:2]})
    counted = _with_offset(cells.select("cell", F.col("n").alias("_n")), "cell")
    holds = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_n")) for r in open_ranks]
    found = {}
    for held in counted.where(reduce(or_, holds)).collect():
        inside = [r for r in open_ranks if held["_before"] <= r < held["_before"] + held["_n"]]
        part = rows.where((F.col("octave") == held["cell"] // FINE) & (F.col("cell") == held["cell"]))
        low, high = part.agg(F.min(value), F.max(value)).first()
        own = [r - held["_before"] for r in inside]
        values = values_at_ranks(part, value, low, high, held["_n"], own)
        found |= {r: values[k] for r, k in zip(inside, own)}
    return {
        name: _between(found[at[0]], found[at[1]], at[2]) if at else None for name, at in ranks.items()
    }
