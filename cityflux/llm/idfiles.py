"""Token ids in files, coded by a static range asymmetric numeral system (rANS).

One pass tokenises; a second counts how often each id occurs and fixes the one frequency
table that all blocks share. Ids of documents in ascending order are cut into blocks that are
coded alone: ``LANES`` interleaved states take turns, so a step is one vector operation over
the lanes of all blocks at hand. Every ``STEPS`` steps a checkpoint keeps the states and the
place in the coded words; decoding starts at any of them, so the parts of a block are decoded
side by side. A block carries checksums of its own bytes, of the table and of its ids.

Layout of a block, little-endian: ``MAGIC``, then unsigned 32-bit numbers: ids, lanes, steps
between checkpoints, bits of a table's sum, words, checksum of the table, checksum of the ids
(as unsigned 32-bit numbers); for each checkpoint the place of its next word (32 bits) and the
lanes' states (64 bits each); the words (32 bits); the checksum of all these bytes. Blocks lie
in the rows of Parquet files beside the list of their documents: Spark's writers commit them
whole, and files, rows and checkpoints are where readers can split.
"""

from __future__ import annotations

import json
import os
import pickle
import struct
import sys
import zlib
from array import array
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from tokenizers import Tokenizer

from .tables import partitions_for, shared, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"RNS1"
#: ids of a block, states that take turns, steps between checkpoints
BLOCK, LANES, STEPS = 1 << 16, 64, 256
#: blocks coded side by side, and ids of a file
TOGETHER, FILE = 16, 1 << 23
#: frequencies sum to a power of two: of at least this many bits
BITS = 20
#: words of texts that are tokenised at once, and different words that a task remembers
WORDS, REMEMBERED = 1 << 20, 1 << 19
LOW = np.uint64(1 << 31)
HEAD = "<4s7I"


class DamagedBlock(ValueError):
    """A block's checksum does not hold."""


class Table:
    """Ids that occur, with frequencies that sum to ``1 << bits``."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids = np.asarray(ids, np.uint32)
        self.freq = np.asarray(freq, np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        # places of ids, where a list of all ids is short
        self.place = None
        if len(self.ids) and self.ids.max() < 1 << 20:
            self.place = np.zeros(int(self.ids.max()) + 1, np.int32)
            self.place[self.ids] = np.arange(len(self.ids))
        total = int(self.freq.sum())
        self.bits = max(0, total.bit_length() - 1)
        if total != 1 << self.bits and total:
            raise ValueError("frequencies must sum to a power of two")
        self.slot = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        self.sum = zlib.crc32(self.ids.tobytes() + self.freq.tobytes())

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids) if self.place is None else self.place[ids]

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        """Frequencies in proportion to counts, at least one each."""
        order = np.argsort(ids)
        ids, counts = np.asarray(ids)[order], np.asarray(counts, float)[order]
        if not len(ids):
            return cls(ids, counts)
        bits = max(BITS, len(ids).bit_length() + 2)
        if bits > 30:
            raise ValueError("too many different ids")
        freq = np.maximum(1, np.floor(counts * ((1 << bits) / counts.sum()))).astype(np.int64)
        missing = (1 << bits) - int(freq.sum())
        while missing:  # what rounding left goes to the largest, which it changes least
            at = int(freq.argmax())
            change = missing if missing > 0 else -min(-missing, int(freq[at]) // 2)
            freq[at] += change
            missing -= change
        return cls(ids, freq)


def encode_blocks(symbols: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of equal size, one per row of ``symbols`` (places in the table)."""
    many, n = symbols.shape
    steps = -(-n // LANES)
    padded = np.full((many, steps * LANES), int(table.freq.argmax()), np.int32)
    padded[:, :n] = symbols
    turn = np.ascontiguousarray(padded.reshape(many, steps, LANES).transpose(1, 0, 2))
    bits, half = np.uint64(table.bits), np.uint64(32)
    room = np.uint64((1 << 31 >> table.bits) << 32)
    state = np.full((many, LANES), LOW)
    words = np.empty((steps, many, LANES), np.uint32)
    sent = np.empty((steps, many, LANES), bool)
    marks = np.empty((-(-steps // STEPS), many, LANES), np.uint64)
    for t in range(steps - 1, -1, -1):
        f = table.freq[turn[t]]
        words[t] = state  # the low half
        sent[t] = full = state >= f * room
        state = np.where(full, state >> half, state)
        quotient = state // f
        state = (quotient << bits) + (state - quotient * f) + table.cum[turn[t]]
        if t % STEPS == 0:
            marks[t // STEPS] = state
    out = []
    before = np.cumsum(sent.sum(axis=2), axis=0)
    for b in range(many):
        coded = words[:, b][sent[:, b]]
        ids = table.ids[symbols[b]]
        ids_sum = zlib.crc32(ids.tobytes())
        parts = [struct.pack(HEAD, MAGIC, n, LANES, STEPS, table.bits, len(coded), table.sum, ids_sum)]
        for c in range(len(marks)):
            place = int(before[c * STEPS - 1, b]) if c else 0
            parts += [struct.pack("<I", place), marks[c, b].tobytes()]
        body = b"".join([*parts, coded.tobytes()])
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


class _Parts:
    """The stretches between checkpoints of some blocks, longest first."""

    def __init__(self, bodies: list[bytes], table: Table):
        states, places, steps, words, self.heads = [], [], [], [], []
        offset = 0
        for body in bodies:
            if len(body) < struct.calcsize(HEAD) + 4 or zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
                raise DamagedBlock("the block's bytes are damaged")
            magic, n, lanes, between, bits, count, table_sum, ids_sum = struct.unpack_from(HEAD, body)
            if magic != MAGIC or table_sum != table.sum or lanes != LANES:
                raise DamagedBlock("the block belongs to another table or format")
            turns = -(-n // lanes)
            marks = -(-turns // between)
            at = struct.calcsize(HEAD)
            for c in range(marks):
                places.append(offset + struct.unpack_from("<I", body, at)[0])
                states.append(np.frombuffer(body, "<u8", lanes, at + 4))
                steps.append(min(between, turns - c * between))
                at += 4 + 8 * lanes
            words.append(np.frombuffer(body, "<u4", count, at))
            offset += count
            self.heads.append((n, marks, ids_sum))
        self.steps = np.array(steps, np.int64)
        self.order = np.argsort(-self.steps, kind="stable")
        self.state = np.array(states, np.uint64).reshape(-1, LANES)[self.order]
        self.place = np.array(places, np.int64)[self.order]
        self.words = np.concatenate([*words, np.zeros(1, np.uint32)])


def decode_blocks(bodies: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of each block; every stretch between checkpoints is decoded at the same time."""
    if not bodies:
        return []
    parts = _Parts(bodies, table)
    state, place, steps = parts.state, parts.place, parts.steps[parts.order]
    bits, half, mask = np.uint64(table.bits), np.uint64(32), np.uint64((1 << table.bits) - 1)
    longest = int(steps.max(initial=0))
    symbols = np.zeros((len(state), longest, LANES), np.uint32)
    for t in range(longest):
        live = int(np.searchsorted(-steps, -t, "left"))  # parts with more than t steps
        x = state[:live]
        low = x & mask
        found = table.slot[low.astype(np.int64)]
        symbols[:live, t] = found
        x = table.freq[found] * (x >> bits) + low - table.cum[found]
        need = x < LOW
        count = np.cumsum(need, axis=1)
        word = parts.words[np.where(need, place[:live, None] + count - 1, len(parts.words) - 1)]
        state[:live] = np.where(need, (x << half) | word, x)
        place[:live] += count[:, -1]
    back = np.empty(len(parts.order), np.int64)
    back[parts.order] = np.arange(len(back))
    out, at = [], 0
    for n, marks, ids_sum in parts.heads:
        rows = [symbols[back[c], : parts.steps[c]].ravel() for c in range(at, at + marks)]
        ids = table.ids[np.concatenate([*rows, np.zeros(0, np.uint32)])[:n].astype(np.int64)]
        if zlib.crc32(ids.tobytes()) != ids_sum:
            raise DamagedBlock("the block's ids do not have their checksum")
        out.append(ids)
        at += marks
    return out


#: the splitting rule whose words can be told apart here, where they are plain (see ``WordIds``)
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
_UNIT = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"


def _gathered_ids(flat: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``wanted`` of ``flat``, which holds stretches of ``size``; and where each ends."""
    begin = np.cumsum(size) - size
    length = size[wanted]
    total = np.cumsum(length)
    at = np.repeat(begin[wanted] - (total - length), length)
    at += np.arange(len(at))
    return flat[at], total


def _shown_bytes() -> dict[int, str]:
    """The letters that a byte-level vocabulary shows bytes as."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Ids of texts by a tokenizer that never joins words apart by white space.

    White space between words is dropped by the tokenizer's splitting rule and no rule looks
    beyond it, so a text's ids are those of its words. With ``RULE``, plain words (ASCII and
    Latin-1 letters, which lower-casing and composition take one by one) are split here, and the
    library's model encodes each different unit once; all other words go through the whole
    tokenizer.
    """

    def __init__(self, path: str, end_id: int, kind: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind, self.end = kind, np.array([end_id], kind)
        self.code = np.dtype(kind).char
        self.units: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.letters = _shown_bytes()
        told = json.loads(self.whole.to_str())
        self.added = tuple(x["content"] for x in told["added_tokens"])
        names = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", ())]
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers", ())
        rules = [x.get("pattern", {}).get("Regex") for x in splits]
        self.ruled = names == ["NFC", "Replace", "Lowercase"] and rules == [RULE, None]
        if self.whole.encode("a \t\r\n b", add_special_tokens=False).ids != [
            i for w in "ab" for i in self.whole.encode(w, add_special_tokens=False).ids
        ]:
            raise ValueError(f"{path} keeps white space")

    def _shown(self, unit: str) -> str:
        return unit.encode().decode("latin-1").translate(self.letters)

    def _of_units(self, units: list[str]) -> list[bytes]:
        known, tokenize, code = self.units, self.model.tokenize, self.code
        if len(known) + len(units) > REMEMBERED:
            known.clear()
        for u in units:
            if u not in known:
                # printable ASCII is shown as it is
                found = tokenize(u if u.isascii() else self._shown(u))
                known[u] = array(code, [t.id for t in found]).tobytes()
        return [known[u] for u in units]

    def _of_odd(self, words: list[str]) -> list[bytes]:
        known = self.odd
        if len(known) + len(words) > REMEMBERED:
            known.clear()
        new = [w for w in words if w not in known]
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            for w, e in zip(part, self.whole.encode_batch(part, add_special_tokens=False)):
                known[w] = np.array(e.ids, self.kind).tobytes()
        return [known[w] for w in words]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after another, and how many each has."""
        plain = pc.match_substring_regex(words, _PLAIN) if self.ruled else pa.array(np.zeros(len(words), bool))
        for text in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, text))
        split = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), _UNIT, r"\1 ")
        lists = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(split))
        coded = lists.flatten().dictionary_encode()
        each = self._of_units(coded.dictionary.to_pylist())
        odd = self._of_odd(words.filter(pc.invert(plain)).to_pylist())
        flat = np.frombuffer(b"".join([*each, *odd]), self.kind)
        size = np.fromiter(map(len, chain(each, odd)), np.int64, len(each) + len(odd))
        size //= np.dtype(self.kind).itemsize
        # a plain word is its units, an odd one a stretch of its own
        plain = np.asarray(plain)
        number = np.ones(len(words), np.int64)
        number[plain] = np.diff(np.asarray(lists.offsets))
        owner = np.repeat(plain, number)
        stretch = np.empty(len(owner), np.int64)
        stretch[owner] = np.asarray(coded.indices)
        stretch[~owner] = len(each) + np.arange(len(odd))
        ids, end = _gathered_ids(flat, size, stretch)
        last = np.cumsum(number)
        return ids, np.diff(np.concatenate([[0], np.concatenate([[0], end])[last]]))

    def __call__(self, texts: pa.Array):
        """The ids of all texts, one after another, each with the end id, and their numbers."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        ids, size = self._of_words(coded.dictionary)
        count = np.diff(np.asarray(lists.offsets))
        last = np.cumsum(count + 1) - 1
        word = np.full(int(count.sum()) + len(count), len(size), np.int64)
        inside = np.ones(len(word), bool)
        inside[last] = False
        word[inside] = np.asarray(coded.indices)
        flat, total = _gathered_ids(np.append(ids, self.end), np.append(size, 1), word)
        return flat, np.diff(np.concatenate([[0], total[last]]))


def portions(texts: pa.Array):
    """Borders of neighbouring texts of about ``WORDS`` words, taken as six bytes each."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(total, total[low] + 6 * WORDS, "right")) - 1)
        yield low, high
        low = high


def _id_kind(path: str, end_id: int) -> str:
    """Two bytes hold an id of a small vocabulary."""
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    return "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"


def _tokenise(path: str, end_id: int, kind: str):
    def run(batches):
        encode, width = WordIds(path, end_id, kind), np.dtype(kind).itemsize
        for batch in batches:
            for low, high in portions(batch.column(1)):
                ids, n = encode(batch.column(1).slice(low, high - low))
                border = np.concatenate([[0], np.cumsum(n)]) * width
                raw = ids.tobytes()
                body = [raw[a:b] for a, b in zip(border[:-1].tolist(), border[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n), pa.array(body, pa.binary())],
                    ["doc_id", "n", "ids"],
                )

    return run


def _count(kind: str):
    def run(batches):
        if np.dtype(kind).itemsize == 2:
            total = np.zeros(1 << 16, np.int64)
            for batch in batches:
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=1 << 16)
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])
            return
        ids, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), return_counts=True)
            ids, place = np.unique(np.concatenate([ids, new.astype(np.int64)]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(ids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["id", "n"])

    return run


def frequency_table(tokens: DataFrame, kind: str = "<u4") -> Table:
    """The table of the ids in ``tokens``; as many rows as different ids reach the driver."""
    counted = tokens.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    return Table.of_counts(np.asarray(rows.column(0)), np.asarray(rows.column(1)))


_DOCS = "array<struct<doc_id:{},start:bigint,at:bigint,n:bigint>>"


class _Writer:
    """Cuts a task's stream of documents into blocks."""

    def __init__(self, table: Table, part: int, id_type: pa.DataType):
        self.table, self.part, self.id_type = table, part, id_type
        self.held, self.count, self.first, self.block = [], 0, 0, 0
        self.docs: list[tuple] = []  # (id, start, length) of documents that are not all written

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, self.first + self.count, len(ids)))
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= BLOCK * TOGETHER:
            yield self.write(self.count // BLOCK * BLOCK)

    def end(self):
        for n in (self.count // BLOCK * BLOCK, self.count % BLOCK):
            if n:
                yield self.write(n)

    def write(self, n: int) -> pa.RecordBatch:
        ids = np.concatenate(self.held)
        symbols = self.table.places(ids[:n])
        size = min(n, BLOCK)
        bodies = []
        for at in range(0, n, BLOCK * TOGETHER):
            bodies += encode_blocks(symbols[at : at + BLOCK * TOGETHER].reshape(-1, size), self.table)
        first = self.first + size * np.arange(len(bodies))
        lists, docs, k = [], self.docs, 0
        for a in first.tolist():
            while docs[k][1] + docs[k][2] <= a:
                k += 1
            inside, j = [], k
            while j < len(docs) and docs[j][1] < a + size:
                doc_id, start, length = docs[j]
                low, high = max(start, a), min(start + length, a + size)
                inside.append({"doc_id": doc_id, "start": start, "at": low - start, "n": high - low})
                j += 1
            lists.append(inside)
            k = j - 1
        self.held, self.count, self.first = [ids[n:]], self.count - n, self.first + n
        self.docs = [d for d in docs[k:] if d[1] + d[2] > self.first]
        number = np.arange(self.block, self.block + len(bodies))
        self.block += len(bodies)
        kind = pa.list_(
            pa.struct([("doc_id", self.id_type), ("start", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(bodies), self.part, np.int32)),
                pa.array(number.astype(np.int32)),
                pa.array(first),
                pa.array(np.full(len(bodies), size)),
                pa.array(lists, kind),
                pa.array(bodies, pa.binary()),
            ],
            ["part", "block", "first", "n", "docs", "body"],
        )


def _blocks(table, id_kind: str):
    def run(batches):
        writer = None
        for batch in batches:
            if writer is None:
                kind = batch.schema.field(0).type
                writer = _Writer(pickle.loads(table.value), TaskContext.get().partitionId(), kind)
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from writer.add(doc_id, np.frombuffer(raw, id_kind))
        if writer is not None:
            yield from writer.end()

    return run


def write_ids(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 2,
) -> None:
    """Tokenise ``docs`` and write their ids in ascending order of ``id_col`` to ``path``.

    Null texts are empty; every document ends with ``end_id``. Null ids come first; rows that
    repeat an id follow each other, by text. Other columns are ignored. ``path`` gets a folder
    ``blocks`` and a folder ``table``; both are written by Spark, so a lost executor's part is
    written again and half a file is never seen. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL("n long, ids binary").fields])
    model = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    id_kind = _id_kind(model, end_id)
    tokens = stored(slim.mapInArrow(_tokenise(model, end_id, id_kind), schema), "tokens")
    table = frequency_table(tokens, id_kind)
    pairs = list(zip(table.ids.tolist(), table.freq.astype(np.int64).tolist()))
    spark.createDataFrame(pairs, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    # equal rows are alike, so a row number may deal them out: many rows of one id are no hot key
    numbered = tokens.select(
        "doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row")
    )
    keys = ["doc_id", "hash", "row"]
    dealt = numbered.repartitionByRange(partitions_for(total, FILE), *keys).sortWithinPartitions(*keys)
    kind = slim.schema["doc_id"].dataType.simpleString()
    fields = f"part int, block int, first long, n long, docs {_DOCS.format(kind)}, body binary"
    blocks = dealt.select("doc_id", "ids").mapInArrow(_blocks(shared(spark, table), id_kind), fields)
    # the bodies do not compress any further
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").orderBy("id").toArrow()
    return Table(np.asarray(rows.column(0)), np.asarray(rows.column(1)))


def _read(table):
    def run(batches):
        known = pickle.loads(table.value)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                blocks = decode_blocks(part.column(3).to_pylist(), known)
                docs = part.column(2)
                flat = docs.flatten()
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(docs.offsets)))
                n = np.asarray(flat.field(3))
                end = np.cumsum(n)
                raw = np.concatenate([np.zeros(0, np.uint32), *blocks]).astype("<u4").tobytes()
                body = [raw[4 * (b - m) : 4 * b] for b, m in zip(end.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)),
                        flat.field(0),
                        flat.field(1),
                        flat.field(2),
                        flat.field(3),
                        pa.array(body, pa.binary()),
                    ],
                    ["part", "doc_id", "start", "at", "n", "ids"],
                )

    return run


def read_pieces(spark: SparkSession, path: str, wanted=None) -> DataFrame:
    """part, doc_id, start (in the part), at (in the document), n, ids: a row per block and document.

    ``wanted`` may hold a condition on ``part``, ``block`` and ``first``: other blocks are skipped.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks = blocks if wanted is None else blocks.where(wanted)
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    fields = f"part int, doc_id {kind}, start long, at long, n long, ids binary"
    slim = blocks.select("part", "first", "docs", "body")
    return slim.mapInArrow(_read(shared(spark, read_table(spark, path))), fields)


def _joined(batches):
    for batch in batches:
        lists = batch.column(3).to_pylist()
        body = [b"".join(x["ids"] for x in sorted(p, key=lambda x: x["at"])) for p in lists]
        columns = [batch.column(i) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(body, pa.binary())], ["part", "start", "doc_id", "ids"])


def _schema_of(pieces: DataFrame, rest: str) -> T.StructType:
    fields = T.StructType.fromDDL("part int, start long").fields
    return T.StructType([*fields, pieces.schema["doc_id"], *T.StructType.fromDDL(rest).fields])


def _gathered(pieces: DataFrame, *columns: str) -> DataFrame:
    """The pieces of each document; every document has an id at least, so no two share a place."""
    of = F.collect_list(F.struct("at", *columns)).alias("pieces")
    return pieces.groupBy("part", "start").agg(F.first("doc_id").alias("doc_id"), of).select(
        "part", "start", "doc_id", "pieces"
    )


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``start`` counted from the first file on; one row per file is ordered in one task."""
    blocks = spark.read.parquet(f"{path}/blocks")
    size = blocks.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    based = rows.join(size.select("part", before.alias("before")), "part")
    return based.withColumn("start", F.col("before") + F.col("start")).drop("before", "part")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32-bit each).

    One row per document, put together from the blocks that hold a part of it.
    """
    pieces = read_pieces(spark, path)
    whole = _gathered(pieces, "ids").mapInArrow(_joined, _schema_of(pieces, "ids binary"))
    n = (F.octet_length("ids") / 4).cast("long")
    return _with_start(spark, path, whole).select("doc_id", "start", n.alias("n_tokens"), "ids")


def _times(matrix: list[int], value: int) -> int:
    """A 32 x 32 matrix of bits, given by its columns, times a vector."""
    out, k = 0, 0
    while value:
        if value & 1:
            out ^= matrix[k]
        value >>= 1
        k += 1
    return out


def _zero_bytes() -> list[list[int]]:
    """What 1, 2, 4, ... zero bytes do to a CRC-32, as matrices of bits."""
    one = [0xEDB88320, *(1 << k for k in range(31))]  # a zero bit shifts, the lowest bit feeds back
    out = [one]
    while len(out) < 64:
        out.append([_times(out[-1], c) for c in out[-1]])
    return out[3:]


ZERO_BYTES = _zero_bytes()


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two strings after each other, the second of ``length`` bytes."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            first = _times(ZERO_BYTES[k], first)
    return first ^ second


def _sums(batches):
    for batch in batches:
        n, crc = [], []
        for p in batch.column(3).to_pylist():
            total = value = 0
            for x in sorted(p, key=lambda x: x["at"]):
                total, value = total + x["n"], crc_joined(value, x["crc"], 4 * x["n"])
            n.append(total)
            crc.append(value)
        columns = [batch.column(i) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(crc)], ["part", "start", "doc_id", "n", "crc"])


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents that ``read_documents`` gives.

    The ids are decoded and summed up where they are read; only sums travel.
    """
    pieces = read_pieces(spark, path).withColumn("crc", F.crc32("ids"))
    sums = _gathered(pieces, "n", "crc").mapInArrow(_sums, _schema_of(pieces, "n long, crc long"))
    return _with_start(spark, path, sums).select(
        "doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )
