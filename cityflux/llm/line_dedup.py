"""Line dedup by pairwise alignment.

Equal texts are one entry; all but its first document lose everything. Of the other
documents, those that share a rare line overlap. A pair is aligned by patience diff over line
hashes, and the aligned common blocks are deleted from the later document. Every rare line
pairs its earliest holder with each later one; rare lines that this leaves go on to their next
earlier holders, 2, 4, 8 and so on at a time, until they are deleted or have met every earlier
holder. So the rare lines deleted are those that comparing all pairs deletes, while near copies
mostly meet one another's first only.

A line is rare if at most ``rare_share`` of all distinct texts hold it. The share is large
enough for groups of near copies of a third of all documents; lines beyond it are
boilerplate. Boilerplate and blank lines decide nothing: a stretch of them goes if the rare lines
around it go. What is deleted therefore follows from the documents alone, not from the pairs
that happened to be compared.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: hash of lines that are blank
BLANK = 0


def line_hashes(text: bytes) -> np.ndarray:
    """One hash per line; ``BLANK`` for lines without a visible character."""
    lines = text.split(b"\n")
    found = [xxhash.xxh64_intdigest(x, 1) or 1 if x.strip() else BLANK for x in lines]
    return np.array(found, np.uint64).view(np.int64)


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [0] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        before[i] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Lines of ``b`` that patience diff aligns with equal lines of ``a``.

    Equal lines at both ends match; lines that are unique in both parts anchor, the longest
    chain of them that keeps the order stays, and the parts between are aligned in turn.
    """
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(b0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append(b1)
        if a0 == a1 or b0 == b1:
            continue
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if left[x] == 1 and right.get(x) == 1}
        common = [i for i in range(b0, b1) if b[i] in place]
        chain = [common[k] for k in _increasing([place[b[i]] for i in common])]
        if not chain:
            continue
        at_a, at_b = a0, b0
        for i in chain:
            todo.append((at_a, place[b[i]], at_b, i))
            out.append(i)
            at_a, at_b = place[b[i]] + 1, i + 1
        todo.append((at_a, a1, at_b, b1))
    return sorted(out)


def _ranges(lines: list[int]) -> list[tuple[int, int]]:
    """Runs of lines."""
    out: list[list[int]] = []
    for i in lines:
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [(a, b) for a, b in out]


def with_fillers(gone: set[int], filler: list[bool]) -> set[int]:
    """``gone`` and the stretches of filler lines (blank or boilerplate) inside it.

    A stretch goes if the lines on both sides of it go; an edge of the text does not hold
    back a stretch whose other side goes.
    """
    out, n, i = set(gone), len(filler), 0
    while i < n:
        if not filler[i]:
            i += 1
            continue
        j = i
        while j < n and filler[j]:
            j += 1
        before, after = i == 0 or i - 1 in gone, j == n or j in gone
        if before and after and (i > 0 or j < n):
            out.update(range(i, j))
        i = j
    return out


def _hash_lines(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            lists = [line_hashes(t or b"") for t in part.column(part.num_columns - 1).to_pylist()]
            rest = [part.column(i) for i in range(part.num_columns - 1)]
            lines = pa.array(lists, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest, lines], [*batch.schema.names[:-1], "lines"])


def _align(batches):
    kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
    for batch in batches:
        early, late = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        blocks = [_ranges(aligned(a, b)) for a, b in zip(early, late)]
        lists = [[{"first": x, "after": y} for x, y in found] for found in blocks]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], ["row", "blocks"])


def _held(entries: DataFrame, rare_share: float) -> DataFrame:
    """line, early (row of its first holder), held, rare: lines of several entries; rows are in
    the order of documents."""
    lines = entries.select("row", F.explode(F.array_distinct("lines")).alias("line"))
    holders = lines.where(F.col("line") != BLANK).groupBy("line").agg(
        F.min("row").alias("early"), F.count(F.lit(1)).alias("held")
    )
    limit = max(2.0, rare_share * entries.count())
    return holders.where(F.col("held") > 1).withColumn("rare", F.col("held") <= limit)


def _ranked(holdings: DataFrame) -> DataFrame:
    """line, row, rank: the place from 1 of every holder of a line; hot lines go by stretches of rows."""
    stretch = F.shiftright("row", 12)
    held = holdings.withColumn("stretch", stretch).withColumn(
        "inner", F.row_number().over(Window.partitionBy("line", "stretch").orderBy("row"))
    )
    sizes = holdings.groupBy("line", stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("line").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("line", "stretch", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    rank = (F.col("before") + F.col("inner")).alias("rank")
    return held.join(sizes, ["line", "stretch"]).select("line", "row", rank)


def _blocks(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, blocks: what each pair (early, late) deletes from its later document."""
    lines = entries.select("row", "lines")
    both = (
        pairs.join(lines.withColumnRenamed("row", "early").withColumnRenamed("lines", "a"), "early")
        .join(lines.withColumnRenamed("row", "late").withColumnRenamed("lines", "b"), "late")
        .select(F.col("late").alias("row"), "a", "b")
    )
    kind = "row long, blocks array<struct<first:bigint,after:bigint>>"
    return both.mapInArrow(_align, kind).where(F.size("blocks") > 0)


def _inside(found: DataFrame) -> DataFrame:
    """row, place of the lines in the blocks ``found``."""
    block = found.select("row", F.explode("blocks").alias("block"))
    lines = F.sequence(F.col("block.first").cast("int"), F.col("block.after").cast("int") - 1)
    return block.select("row", F.explode(lines).alias("place"))


def _remaining(places: DataFrame, found: DataFrame) -> DataFrame:
    """``places`` (row, place, ...) outside the blocks ``found``."""
    return places.join(_inside(found), ["row", "place"], "left_anti")


def deleted_lines(entries: DataFrame, rare_share: float) -> DataFrame:
    """row, gone (places of rare lines that an earlier holder aligns), boilerplate (places)."""
    held = stored(_held(entries, rare_share), "held-lines")
    places = entries.select("row", F.posexplode("lines").alias("place", "line"))
    shared = places.join(held, "line")
    late = shared.where("rare AND row != early")
    found = _found_blocks(entries, places, late)
    gone = late.select("row", "place").join(_inside(found).distinct(), ["row", "place"], "left_semi")
    common = shared.where("NOT rare").select("row", "place")
    marked = gone.withColumn("rare", F.lit(True)).unionByName(common.withColumn("rare", F.lit(False)))
    return marked.groupBy("row").agg(
        F.collect_list(F.when(F.col("rare"), F.col("place"))).alias("gone"),
        F.collect_list(F.when(~F.col("rare"), F.col("place"))).alias("boilerplate"),
    )


def _found_blocks(entries: DataFrame, places: DataFrame, late: DataFrame) -> DataFrame:
    """row, blocks: enough aligned blocks to hold every rare line that some earlier holder aligns."""
    met = stored(late.select("early", F.col("row").alias("late")).distinct(), "overlaps")
    found = stored(_blocks(entries, met), "blocks")
    left = late.where("held > 2").select("row", "place", "line")
    left = stored(_remaining(left, found), "left")
    if left.isEmpty():
        return found
    holdings = places.join(left.select("line").distinct(), "line", "left_semi").select("line", "row").distinct()
    ranked = stored(_ranked(holdings), "ranks")
    holders = ranked.withColumnRenamed("row", "early")
    left, at = left.join(ranked, ["line", "row"]), 2
    while not (left := stored(left.where(F.col("rank") > at), "left")).isEmpty():
        tried = F.sequence(F.lit(at), F.least(F.lit(2 * at - 1), F.col("rank").cast("int") - 1))
        asked = left.select("line", "row", "rank").distinct()
        asked = asked.select("line", F.col("row").alias("late"), F.explode(tried).alias("rank"))
        pairs = asked.join(holders, ["line", "rank"]).select("early", "late").distinct()
        pairs = stored(pairs.join(met, ["early", "late"], "left_anti"), "overlaps")
        more = stored(_blocks(entries, pairs), "blocks")
        met, found = met.unionByName(pairs), found.unionByName(more)
        left, at = _remaining(left, more), 2 * at
    return found


_KEYS = ("hash", "hash2")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("hash"),
        F.xxhash64(F.lit(1), text).alias("hash2"),
        text.cast("binary").alias("bytes"),
    )


def decisions(docs: DataFrame, id_col: str, text_col: str, rare_share: float) -> DataFrame:
    """hash, hash2, first (id of the document that stays), rows (of that id), gone, boilerplate."""
    keyed = _keyed(docs, id_col, text_col)
    schema = T.StructType(
        [*keyed.schema.fields[:3], T.StructField("lines", T.ArrayType(T.LongType()))]
    )
    per_row = stored(keyed.mapInArrow(_hash_lines, schema), "lines")
    ids = per_row.groupBy(*_KEYS, F.col("doc_id").isNull().alias("no_id"), "doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.first("lines").alias("lines")
    )
    first = F.min_by(F.struct("rows", "lines"), F.struct("no_id", "doc_id"))
    entries = ids.groupBy(*_KEYS).agg(
        F.min(F.struct("no_id", "doc_id")).alias("id"), first.alias("rest")
    )
    ordered = entries.select(*_KEYS, "id.*", "rest.*").orderBy("no_id", "doc_id", *_KEYS)
    entries = stored(ordered.withColumn("row", F.monotonically_increasing_id()), "entries")
    marks = deleted_lines(entries, rare_share)
    return entries.join(marks, "row", "left").select(
        *_KEYS, F.col("doc_id").alias("first"), "rows", "gone", "boilerplate"
    )


def _delete(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            total, removed, kept = [], [], []
            for text, whole, rare, common in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                lines = text.split(b"\n")
                common = set(common or ())
                filler = [i in common or not x.strip() for i, x in enumerate(lines)]
                gone = with_fillers(set(rare or ()), filler)
                if whole:
                    gone = set(range(len(lines))) if any(x.strip() for x in lines) else set()
                total.append(len(lines))
                removed.append(len(gone))
                kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_lines", "n_removed", "kept"],
            )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare_share: float = 0.4
) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (binary): one row per input row.

    Lines end at ``\\n``; null texts are empty. Documents come in the order of their ids,
    missing ids last, texts of one id by hash; of rows that repeat an id and a text one
    counts as the earlier. A rare line is deleted if patience diff of its document with any
    earlier one that holds it aligns it; stretches of blank lines and of lines that are not rare go
    if the lines around them go. Blank lines are all alike; texts without visible characters are
    left alone. Empty tables give empty results.
    """
    keyed = _keyed(docs, id_col, text_col).alias("t")
    marks = decisions(docs, id_col, text_col, rare_share).hint("shuffle_hash").alias("m")
    same = [F.col(f"t.{k}") == F.col(f"m.{k}") for k in _KEYS]
    joined = keyed.join(marks, same).withColumn("is_first", F.col("t.doc_id").eqNullSafe(F.col("m.first")))
    again = F.col("is_first") & (F.col("m.rows") > 1)
    plain = joined.where(~again).select("t.doc_id", "t.bytes", ~F.col("is_first"), "m.gone", "m.boilerplate")
    # equal rows: one is the first, the others are copies
    one = joined.where(again).groupBy("t.hash", "t.hash2", "t.doc_id").agg(
        F.first("t.bytes").alias("bytes"),
        F.first("m.gone").alias("gone"),
        F.first("m.boilerplate").alias("boilerplate"),
        F.count(F.lit(1)).alias("n"),
    )
    copies = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    rows = plain.toDF("doc_id", "bytes", "whole", "gone", "boilerplate").unionByName(
        copies.select("doc_id", "bytes", (F.col("copy") > 1).alias("whole"), "gone", "boilerplate")
    )
    schema = T.StructType(
        [rows.schema["doc_id"], *T.StructType.fromDDL("n_lines long, n_removed long, kept binary").fields]
    )
    return rows.mapInArrow(_delete, schema)
