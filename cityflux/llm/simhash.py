"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are grouped into blocks that agree on some bands of bits, chosen so that any
two fingerprints within the radius share a block. Inside a block the bit planes are stored
vertically: word ``w`` of plane ``b`` holds bit ``b`` of 64 fingerprints. A fingerprint is
compared with 64 others at a time: its difference planes go into bit counters by carry-save
adders, and what is left of a block is abandoned when all its lanes exceed the radius.

Large blocks are cut into tiles, and each pair of tiles is a group of its own, so no task
holds a hot block. A group emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .components import stars
from .tables import keep_rows, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: fingerprints of a block that one group takes
TILE = 1024
#: rows a task compares at once
CHUNK = 32768


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in over half of the XXH64 values of the word shingles; 0 without words."""
    found = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    span = min(words, len(found))
    starts = (ends - size)[: len(found) - span + 1].tolist()
    stops = ends[span - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), CHUNK):
        cut = zip(starts[k : k + CHUNK], stops[k : k + CHUNK])
        raw = b"".join([digest(joined[s:e], SEED) for s, e in cut])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.empty(batch.num_rows, np.uint64)
            for k in range(0, batch.num_rows, 256):
                for i, text in enumerate(texts.slice(k, 256).to_pylist()):
                    found[k + i] = fingerprint(text or b"", words)
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "fp"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found.view(np.int64))], names)

    return run


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4
) -> DataFrame:
    """doc_id, hash (of the text), fp, row."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("hash"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    schema = T.StructType([*slim.schema.fields[:2], T.StructField("fp", T.LongType())])
    found = slim.mapInArrow(_fingerprints(words), schema)
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "simhash")


def band_masks(count: int, radius: int) -> list[int]:
    """Masks such that two fingerprints within ``radius`` bits agree under one of them.

    With ``radius + m`` bands at least ``m`` stay equal; ``m`` grows with the number of
    fingerprints so that a block of unrelated ones stays at a few dozen.
    """
    for m in range(1, 6):
        bands = radius + m
        edges = [BITS * i // bands for i in range(bands + 1)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
        if count >> (BITS // bands * m) <= 64:
            break
    return [sum(chosen) for chosen in itertools.combinations(masks, m)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of each a[k] and b[k]; ``label`` holds the least member of each set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _lanes(count: np.ndarray) -> np.ndarray:
    """Masks of the lowest 0 to 64 lanes."""
    count = count.astype(np.uint64)
    return np.where(
        count >= 64, ALL, (np.uint64(1) << np.minimum(count, np.uint64(63))) - np.uint64(1)
    )


def bit_sliced_forest(fp: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int):
    """Least linked row of each row, over pairs (i, j) with first[i] <= j < last[i].

    Counters start at ``2**m - 1 - radius``, so a lane's carry out of the top plane says
    that its distance exceeds the radius.
    """
    n = len(fp)
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-n // 64) * 64, BITS), np.uint8)
    padded[:n] = bits
    planes = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)
    label = np.arange(n)
    m = int(radius + 1).bit_length()
    preset = (1 << m) - 1 - radius
    rows = np.flatnonzero(first < last)
    word = first[rows] // 64
    while len(rows):
        live = _lanes(np.clip(last[rows] - word * 64, 0, 64))
        live &= ~_lanes(np.clip(first[rows] - word * 64, 0, 64))
        q, w, beyond = rows, word, ~live
        counters = [np.full(len(q), ALL if preset >> i & 1 else 0, np.uint64) for i in range(m)]
        for b in range(0, BITS, 2):
            x = planes[b, w] ^ (np.uint64(0) - bits[q, b].astype(np.uint64))
            y = planes[b + 1, w] ^ (np.uint64(0) - bits[q, b + 1].astype(np.uint64))
            carry = x & y
            x ^= y
            carry |= counters[0] & x
            counters[0] ^= x
            for i in range(1, m):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            beyond |= carry
            if b % 8 == 6:
                keep = beyond != ALL
                if not keep.any():
                    q = q[:0]
                    break
                if keep.sum() < 0.75 * len(keep):
                    q, w, beyond = q[keep], w[keep], beyond[keep]
                    counters = [c[keep] for c in counters]
        if len(q):
            hit = np.flatnonzero(~beyond)
            near = np.unpackbits((~beyond[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(near)
            label = unite(label, q[hit][r], w[hit][r] * 64 + lane)
        more = last[rows] > (word + 1) * 64
        rows, word = rows[more], word[more] + 1
    return label


def _runs(table: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each row the partners it is compared with: later rows of its own tile, or the
    other tile's rows."""
    n = len(table["fp"])
    names = ("table", "key", "low", "high")
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([table[c][1:] != table[c][:-1] for c in names])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    last = np.repeat(start + size, size)
    first = np.arange(n) + 1
    lower = (table["own"] == table["low"]).astype(np.int64)
    second = np.repeat(start + np.add.reduceat(lower, start), size)
    across = table["low"] != table["high"]
    first = np.where(across, np.where(lower == 1, second, last), first)
    return first, last


def _linked(radius: int):
    names = ("table", "key", "low", "high", "own", "fp")

    def found(table: dict):
        first, last = _runs(table)
        fp = table["fp"].view(np.uint64)
        label = bit_sliced_forest(fp, first, last, radius)
        child = np.flatnonzero(label != np.arange(len(fp)))
        u, v = table["fp"][child], table["fp"][label[child]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([np.asarray(c) for c in batch.columns])
            size += batch.num_rows
            if size < CHUNK:
                continue
            table = dict(zip(names, map(np.concatenate, zip(*held))))
            same = np.logical_and.reduce([table[c] == table[c][-1] for c in names[:4]])
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                yield found({c: x[:cut] for c, x in table.items()})
            held = [[x[cut:] for x in table.values()]]
            size -= cut
        if size:
            yield found(dict(zip(names, map(np.concatenate, zip(*held)))))

    return run


def links(values: DataFrame, radius: int) -> DataFrame:
    """(u, v) links that connect the distinct ``fp`` of ``values`` as all close pairs would."""
    masks = band_masks(values.count(), radius)
    tables = F.array(
        *[
            F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("key"))
            for i, x in enumerate(masks)
        ]
    )
    blocks = values.select("fp", F.explode(tables).alias("b")).select("b.table", "b.key", "fp")
    crowded = stored(
        blocks.groupBy("table", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > TILE)
        .withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
        .drop("n"),
        "crowded",
    )
    own = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    placed = blocks.join(crowded, ["table", "key"], "left").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
    groups = (
        placed.withColumn("other", other)
        .select(
            "table",
            "key",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "fp",
        )
        .repartition("table", "key", "low", "high")
        .sortWithinPartitions("table", "key", "low", "high", "own", "fp")
    )
    return groups.mapInArrow(_linked(radius), "u long, v long")


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """fp -> root of its component, for every distinct fp, with the least id on it."""
    values = stored(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints"
    )
    roots = stars(links(values, radius))
    rooted = values.join(roots, values["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(rooted.join(named, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per input row.

    Null and blank texts have fingerprint zero and link like any other. ``component_id``
    is the smallest id reachable over links of at most ``radius`` differing bits, null
    only where no row of the component has an id. Repeated rows each come out. Empty
    tables give empty results; further columns are not read.
    """
    rows = fingerprints(docs, id_col, text_col, words)
    return rows.join(_classes(rows, radius), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
) -> DataFrame:
    """``docs`` with one row per component: that of the smallest id; columns unchanged."""
    rows = fingerprints(docs, id_col, text_col, words)
    classes = _classes(rows, radius)
    seat = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = (
        rows.join(classes, "fp")
        .groupBy("root")
        .agg(F.min(F.struct(*[seat.getField(c).alias(c) for c in ("no_id", "doc_id", "row")], "hash")).alias("f"))
        .select("f.doc_id", "f.hash")
    )
    pairs = rows.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("rows"))
    marks = first.alias("f").join(
        pairs.alias("p"),
        F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.hash") == F.col("p.hash")),
    )
    return keep_rows(docs, marks.select("f.doc_id", "f.hash", "p.rows"), id_col, F.xxhash64(text_col))
