"""Removing long passages that occur elsewhere, with logarithmic families of suffix indexes.

A byte goes if some string of ``window`` bytes that covers it also starts anywhere else. Two
occurrences of such a string have the same minimiser: the leftmost gram (a shorter string of
fixed length) of least hash inside it. So suffixes meet where their minimisers agree, and the
work splits:

1. Every text is cut into runs: consecutive window starts with one minimiser. A run is a
   thin row: hash of the gram, hash of all bytes its windows cover, place.
2. Runs whose gram occurs once are done. Of the others, runs that are equal as a whole are
   repeated as a whole; counting them combines on the map side, so a passage that many
   documents share costs one row per task.
3. One representative per remaining kind of run goes, with its bytes, to the task of its
   gram. There the window starts of each arriving batch form a suffix array, are
   merge-scanned against the arrays of the existing levels, and join them as a new level;
   levels of equal size merge, so there are logarithmically many. Suffixes are ordered by
   the fingerprint of their first ``window`` bytes: that is all a scan for long matches
   needs, and comparing is one machine word.
4. Spans return to their documents.

Grams with very many kinds of runs, the rims of passages that a large share of all
documents hold, take the same steps as counts of smaller and smaller pieces.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .tables import mix, partitions_for, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: bytes of a match by default
WINDOW = 400
#: bytes hashed at once
BUFFER = 1 << 20
#: representatives per task, and per batch of a task
REPRESENTATIVES, ARRIVING = 16_384, 2_048
#: kinds of runs from which a gram counts as crowded; window starts per piece of its runs
CROWDED, PIECE = 256, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Sizes(NamedTuple):
    """Bytes of a match and of the grams that are its minimisers."""

    window: int
    gram: int

    @classmethod
    def of(cls, window: int) -> Sizes:
        if window < 4 * PIECE:
            raise ValueError(f"matches of fewer than {4 * PIECE} bytes are not looked for")
        return cls(window, min(64, window // 4))


class Hasher:
    """Polynomial hashes of substrings of a buffer."""

    def __init__(self):
        codes = mix(np.arange(1, 257, dtype=np.uint64))
        self.codes = codes
        self.power = np.ones(0, np.uint64)
        self.inverse = np.ones(0, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self.power) <= n:
            size = max(2 * n, 1 << 16)
            steps = np.full(size, _BASE)
            steps[0] = 1
            self.power = np.multiply.accumulate(steps)
            steps = np.full(size, _INVERSE)
            steps[0] = 1
            self.inverse = np.multiply.accumulate(steps)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.power[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def sliding(self, size: int) -> np.ndarray:
        """Hash of every substring of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.inverse[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(hasher: Hasher, parts: list[bytes], sizes: Sizes):
    """Runs of the parts (at least a window each): part, first start, starts, place
    of the minimiser behind the first start, hash of the gram, hash of the run."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    hasher.load(data)
    place = np.uint64((1 << 22) - 1)
    window, width = sizes
    grams = (hasher.sliding(width) & ~place) | np.arange(len(data) - width + 1, dtype=np.uint64)
    least = sliding_least(grams, window - width + 1) & place
    count = size - window + 1
    owner = np.repeat(np.arange(len(parts)), count)
    starts = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    anchor = least[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(starts)))
    low, anchor, owner = starts[first], anchor[first], owner[first]
    gram = hasher.at(anchor, anchor + width)
    shape = ((anchor - low).astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)
    whole = mix(hasher.at(low, low + number + window - 1) + mix(shape))
    return owner, low - begin[owner], number, anchor - low, gram, whole


def _segments(texts: list, window: int):
    """Buffers of (text number, offset, bytes): long texts in overlapping parts."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - window + 1), BUFFER - window):
            part = text[at : at + BUFFER - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _cut(sizes: Sizes):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                piece = batch.slice(k, 1024)
                texts = [t or b"" for t in piece.column(2).to_pylist()]
                for held in _segments(texts, sizes.window):
                    owner, low, number, shift, gram, whole = runs_of(hasher, [p for _, _, p in held], sizes)
                    row = pa.array(np.array([i for i, _, _ in held])[owner])
                    offset = np.array([at for _, at, _ in held])[owner]
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column(0).take(row),
                            piece.column(1).take(row),
                            pa.array(gram.view(np.int64)),
                            pa.array(whole.view(np.int64)),
                            pa.array(low + offset),
                            pa.array(number.astype(np.int32)),
                            pa.array(shift.astype(np.int32)),
                        ],
                        ["doc_id", "hash", "gram", "whole", "low", "number", "shift"],
                    )

    return run


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("bytes")
    )


def _schema(id_type: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(fields).fields])


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.hash") == F.col(f"{right}.hash")
    )


class Level:
    """A suffix array: fingerprints in order, with the number of the suffix each is of."""

    def __init__(self, keys: np.ndarray, suffix: np.ndarray):
        self.keys, self.suffix = keys, suffix


class IndexFamily:
    """Levels of geometrically growing size over all suffixes that have arrived."""

    def __init__(self):
        self.levels: list[Level] = []
        self.repeated = np.zeros(0, bool)

    def arrive(self, keys: np.ndarray) -> None:
        base = len(self.repeated)
        self.repeated = np.concatenate([self.repeated, np.zeros(len(keys), bool)])
        order = np.argsort(keys, kind="stable")
        new = self._joined(keys[order], order + base)
        for level in self.levels:
            self._scan(new, level)
        while self.levels and len(self.levels[-1].keys) < 2 * len(new.keys):
            old = self.levels.pop()
            merged = np.concatenate([old.keys, new.keys])
            order = np.argsort(merged, kind="stable")
            new = self._joined(merged[order], np.concatenate([old.suffix, new.suffix])[order])
        self.levels.append(new)

    def _joined(self, keys: np.ndarray, suffix: np.ndarray) -> Level:
        """Neighbours with one key are long matches; the first stands for them."""
        equal = keys[1:] == keys[:-1]
        self.repeated[suffix[1:][equal]] = True
        self.repeated[suffix[:-1][equal]] = True
        first = np.append(True, ~equal)[: len(keys)]
        return Level(keys[first], suffix[first])

    def _scan(self, new: Level, level: Level) -> None:
        at = np.searchsorted(level.keys, new.keys)
        inside = np.flatnonzero(at < len(level.keys))
        hit = inside[level.keys[at[inside]] == new.keys[inside]]
        self.repeated[new.suffix[hit]] = True
        self.repeated[level.suffix[at[hit]]] = True


def window_keys(hasher: Hasher, bodies: list[bytes], shift: np.ndarray, gram: np.ndarray, window: int):
    """Fingerprints of all window starts of the bodies, and the body of each."""
    size = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(size) - size
    count = size - window + 1
    owner = np.repeat(np.arange(len(bodies)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    hasher.load(np.frombuffer(b"".join(bodies), np.uint8))
    start = begin[owner] + inner
    keys = hasher.at(start, start + window)
    place = (shift[owner] - inner).astype(np.int64).view(np.uint64)
    return mix(keys + mix(place) + gram[owner]), owner, inner


def spans_of(flags: np.ndarray, owner: np.ndarray, inner: np.ndarray):
    """Runs of flagged starts: (body, first start, last start)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    apart = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first = at[np.append(True, apart)]
    last = at[np.append(apart, True)]
    return owner[first], inner[first], inner[last]


def _span_batch(ids, hashes, low, body, first, last, window):
    row = pa.array(body)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(row),
            hashes.take(row),
            pa.array(low[body] + first),
            pa.array(low[body] + last + window),
        ],
        ["doc_id", "hash", "begin", "stop"],
    )


def _scan_bucket(window: int):
    """Spans of the representatives of one task's grams."""

    def run(batches):
        hasher, family, kept = Hasher(), IndexFamily(), []
        for batch in batches:
            for k in range(0, batch.num_rows, ARRIVING):
                part = batch.slice(k, ARRIVING)
                gram = np.asarray(part.column(2)).view(np.uint64)
                shift = np.asarray(part.column(4)).astype(np.int64)
                keys, owner, inner = window_keys(hasher, part.column(5).to_pylist(), shift, gram, window)
                family.arrive(keys)
                low = np.asarray(part.column(3))
                kept.append((part.select([0, 1]), low, owner.astype(np.int32), inner.astype(np.int32)))
        at = 0
        for part, low, owner, inner in kept:
            flags = family.repeated[at : at + len(owner)]
            at += len(owner)
            body, first, last = spans_of(flags, owner, inner)
            yield _span_batch(part.column(0), part.column(1), low, body, first, last, window)

    return run


def _bodies(window: int):
    """The bytes of each wanted run."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text, wanted = batch.column(2)[i].as_py(), batch.column(3).slice(i, 1).flatten()
                gram, low, number, shift = (np.asarray(wanted.field(j)) for j in range(4))
                body = [text[a : a + n + window - 1] for a, n in zip(low.tolist(), number.tolist())]
                row = pa.array(np.full(len(low), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(gram),
                        pa.array(low),
                        pa.array(shift),
                        pa.array(body, pa.binary()),
                    ],
                    ["doc_id", "hash", "gram", "low", "shift", "body"],
                )

    return run


def _pieces(window: int):
    """Crowded runs in pieces of ``PIECE`` starts, aligned to the minimiser: hash of all
    bytes of the piece, hash of the bytes all its windows share, hash of each window."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for k in range(0, batch.num_rows, ARRIVING):
                part = batch.slice(k, ARRIVING)
                gram = np.asarray(part.column(2)).view(np.uint64)
                shift = np.asarray(part.column(4)).astype(np.int64)
                bodies = part.column(5).to_pylist()
                keys, owner, inner = window_keys(hasher, bodies, shift, gram, window)
                size = np.array([len(b) for b in bodies], np.int64)
                begin = np.cumsum(size) - size
                block = (shift[owner] - inner) // PIECE
                new = np.append(True, (block[1:] != block[:-1]) | (owner[1:] != owner[:-1]))
                first = np.flatnonzero(new)
                number = np.diff(np.append(first, len(keys)))
                body, low = owner[first], inner[first]
                where = begin[body] + low
                place = (shift[body] - low).astype(np.uint64) << np.uint64(16) | number.astype(np.uint64)
                whole = hasher.at(where, where + number + window - 1)
                # what every window of the aligned piece covers, however the run cuts the piece
                shared = (shift[body] - low) // PIECE * PIECE
                a = begin[body] + shift[body] - shared
                core = hasher.at(a, a - PIECE + 1 + window)
                row = pa.array(body)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(keys)).astype(np.int32)), pa.array(keys.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row),
                        part.column(1).take(row),
                        part.column(2).take(row),
                        pa.array((np.asarray(part.column(3))[body] + low)),
                        pa.array(number),
                        pa.array(mix(whole + mix(place)).view(np.int64)),
                        pa.array((core + mix(shared.astype(np.uint64))).view(np.int64)),
                        lists,
                    ],
                    ["doc_id", "hash", "gram", "low", "number", "whole", "core", "keys"],
                )

    return run


def _repeated_counts(rows: DataFrame, label: str, *keys: str) -> DataFrame:
    """Keys that occur more than once; counted with map-side partial sums."""
    return stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), label)


def _crowded_spans(bodies: DataFrame, id_type: T.DataType, window: int) -> DataFrame:
    """The spans ``_scan_bucket`` would find, by counting pieces and then single windows."""
    schema = _schema(id_type, "hash long, gram long, low long, number long, whole long, core long, keys array<long>")
    pieces = stored(bodies.mapInArrow(_pieces(window), schema), "pieces")
    whole = _repeated_counts(pieces, "whole", "gram", "whole")
    stop = F.col("low") + F.col("number") - 1 + window
    full = pieces.join(whole, ["gram", "whole"]).select("doc_id", "hash", F.col("low").alias("begin"), stop.alias("stop"))
    core = _repeated_counts(pieces, "core", "gram", "core")
    rims = pieces.join(whole, ["gram", "whole"], "left_anti").join(core, ["gram", "core"], "left_semi")
    # a whole piece that occurs twice is decided, but its windows still are partners of rims
    partners = pieces.join(core, ["gram", "core"], "left_semi").dropDuplicates(["gram", "whole"])
    windows = partners.select(F.explode("keys").alias("key"))
    repeated = _repeated_counts(windows, "windows", "key")
    single = rims.select("doc_id", "hash", "low", F.posexplode("keys").alias("at", "key"))
    begin = F.col("low") + F.col("at")
    found = single.join(repeated, "key").select(
        "doc_id", "hash", begin.alias("begin"), (begin + window).alias("stop")
    )
    return full.unionByName(found)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """doc_id, hash (of the text), spans: byte ranges that occur elsewhere, not yet merged.

    One row per distinct (id, text) that has any.
    """
    sizes = Sizes.of(window)
    slim = _slim(docs, id_col, text_col)
    id_type = slim.schema["doc_id"].dataType
    fields = "hash long, gram long, whole long, low long, number int, shift int"
    runs = stored(slim.mapInArrow(_cut(sizes), _schema(id_type, fields)), "runs")
    shared = runs.join(_repeated_counts(runs, "grams", "gram"), "gram", "left_semi")
    shared = stored(shared, "shared-runs")
    kinds = stored(
        shared.groupBy("gram", "whole").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.first(c).alias(c) for c in ("doc_id", "hash", "low", "number", "shift")],
        ),
        "kinds",
    )
    equal = stored(kinds.where("n > 1").select("gram", "whole"), "equal-runs")
    stop = F.col("low") + F.col("number") - 1 + window
    full = shared.join(equal, ["gram", "whole"], "left_semi").select(
        "doc_id", "hash", F.col("low").alias("begin"), stop.alias("stop")
    )
    variety = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    variety = stored(variety, "varied-grams")  # so that a hot gram's side of the join can be split
    wanted = (
        kinds.join(variety, "gram")
        .groupBy("doc_id", "hash")
        .agg(F.collect_list(F.struct("gram", "low", "number", "shift")).alias("wanted"))
    )
    found = (
        slim.alias("t")
        .join(wanted.hint("shuffle_hash").alias("w"), _same("t", "w"))
        .select("t.doc_id", "t.hash", "t.bytes", "w.wanted")
        .mapInArrow(_bodies(window), _schema(id_type, "hash long, gram long, low long, shift int, body binary"))
    )
    bodies = stored(found, "bodies")
    crowded = stored(variety.where(F.col("kinds") > CROWDED).select("gram"), "crowded-grams")
    ordinary = bodies.join(crowded, "gram", "left_anti").select(bodies.columns)
    tasks = partitions_for(bodies.count(), REPRESENTATIVES)
    scanned = ordinary.repartition(tasks, "gram").mapInArrow(
        _scan_bucket(window), _schema(id_type, "hash long, begin long, stop long")
    )
    spans = full.unionByName(scanned)
    if not crowded.isEmpty():
        rims = bodies.join(crowded, "gram").select(bodies.columns)
        spans = spans.unionByName(_crowded_spans(rims, id_type, window))
    return spans.groupBy("doc_id", "hash").agg(
        F.collect_set(F.struct("begin", "stop")).alias("spans")
    )


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["begin"], x["stop"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


_SPANS = "array<struct<begin:bigint,stop:bigint>>"


def _apply(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            spans = [merged(x) for x in part.column(2).to_pylist()]
            texts = [t or b"" for t in part.column(1).to_pylist()]
            lists = [[{"begin": a, "stop": b} for a, b in x] for x in spans]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(lists, kind),
                    pa.array([without(t, x) for t, x in zip(texts, spans)], pa.binary()),
                ],
                ["doc_id", "n_bytes", "removed", "kept"],
            )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """doc_id, n_bytes, removed (byte spans in order), kept (binary): one row per input row.

    Bytes go that a string of ``window`` bytes covers which also starts anywhere else.

    Null texts are empty. Rows that repeat an id and a text are copies of each other, so
    all they share goes from each of them. Texts shorter than a window are left alone.
    """
    slim = _slim(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col, window)
    joined = (
        slim.alias("t")
        .join(spans.hint("shuffle_hash").alias("s"), _same("t", "s"), "left")
        .select("t.doc_id", "t.bytes", "s.spans")
    )
    schema = _schema(slim.schema["doc_id"].dataType, f"n_bytes long, removed {_SPANS}, kept binary")
    return joined.mapInArrow(_apply, schema)


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` with repeated passages of ``window`` bytes or more cut from the texts; columns unchanged.

    A character that a cut leaves incomplete is dropped. Null texts stay null, and
    ``n_chars``, if there, follows the text.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    spans = repeated_spans(docs, id_col, text_col, window)
    keyed = docs.withColumn("__hash", F.xxhash64(F.col(text_col).cast("string")))
    same = F.col(f"t.{id_col}").eqNullSafe(F.col("s.doc_id")) & (F.col("t.__hash") == F.col("s.hash"))
    joined = keyed.alias("t").join(spans.hint("shuffle_hash").alias("s"), same, "left")
    joined = joined.select(*[F.col(f"t.`{c}`") for c in names], F.col("s.spans").alias("__spans"))

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = batch.column(len(names)).to_pylist()
            cut = [
                without(t.encode(), merged(x)).decode("utf-8", "ignore") if x and t else t
                for t, x in zip(texts, spans)
            ]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(cut, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.LongType):
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast("long"), "n_chars"))
    return out
