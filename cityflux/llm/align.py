"""How the tokens of two tokenizers lie over each other, counted over all documents.

Documents are shuffled by their full text, so each distinct text is tokenised and aligned
once, whatever the number of its copies; its pairs of ids count as often as it occurs.

Texts are aligned in blocks. A block keeps one list of the different pairs of its texts with
the number of documents that hold each; the texts keep places in that list. So the corpus-wide
counts come from the lists alone, and every block gets back one number per pair of its list,
not one per link. What a task holds is bounded by the size of a block or of its longest text.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: bytes of the texts of a block, about
BLOCK = 4 << 20
SPACE = "▁"


class ByteLevel:
    """The byte-level side: a vocabulary of ranks, over a space and the text."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # no special tokens: their strings in a text are plain text
        self.model = tiktoken.Encoding(
            "align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.surface = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.surface[i] = token

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + t) for t in texts]


class SentencePieces:
    """The side of pieces, which adds the space itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            raw = bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode()
            self.surface.append(raw)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """Ids and byte lengths of the tokens of texts, one after another."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.surface = np.array([None, *tokenizer.surface], object)[1:]
        self.size = np.array([len(x) for x in tokenizer.surface], np.int64)
        numbers = [str(i) for i in range(len(self.size))]
        self.between, self.last = (np.array([x + c for x in numbers], object) for c in (",", self.closing))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; none where their bytes do not spell a space and the text."""
        out = []
        for text, ids in zip(texts, self.tokenizer.ids(texts)):
            ids = np.array(ids, np.int64)
            same = b"".join(self.surface[ids].tolist()) == b" " + text.encode()
            out.append(ids if text and same else None)
        return out


class Left(Side):
    closing = "|"


class Right(Side):
    closing = ";"


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray):
    """Places in both of all pairs of stretches that overlap; both end at the same byte."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


class Block:
    """The alignment of some texts, all of which both sides spell out."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], left: Side, right: Side):
        self.n_a, self.n_b = (np.array([len(x) for x in s], np.int64) for s in (a, b))
        ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *s]) for s in (a, b))
        ends_a, ends_b = np.cumsum(left.size[ids_a]), np.cumsum(right.size[ids_b])
        text_end = ends_a[np.cumsum(self.n_a) - 1] if len(a) else np.zeros(0, np.int64)
        at_a, at_b, ends = overlaps(ends_a, ends_b)
        border = np.concatenate([[0], np.searchsorted(ends, text_end, "right")])
        self.n_links = np.diff(border)
        common = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        self.n_groups = np.diff(np.concatenate([[0], np.searchsorted(common, text_end, "right")]))
        self._pairs(ids_a[at_a] << 32 | ids_b[at_b], border)
        self._digests(ids_a, ids_b, ends_a, ends_b, common, left, right)

    def _pairs(self, pair: np.ndarray, border: np.ndarray) -> None:
        """The different pairs; for each text the places of its pairs and how often each occurs."""
        self.pairs, place = np.unique(pair, return_inverse=True)
        width = max(1, len(self.pairs))
        owner = np.repeat(np.arange(len(border) - 1), np.diff(border))
        key, self.times = np.unique(owner * width + place, return_counts=True)
        self.owner, self.place = key // width, key % width
        self.border = np.searchsorted(self.owner, np.arange(len(border)))

    def documents(self, copies: np.ndarray) -> np.ndarray:
        """How many documents hold each pair."""
        return np.bincount(self.place, copies[self.owner], len(self.pairs)).astype(np.int64)

    def _digests(self, ids_a, ids_b, ends_a, ends_b, common, left: Side, right: Side) -> None:
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        # a group's left tokens, then its right ones
        at_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        shown = np.empty(len(ids_a) + len(ids_b), object)
        for side, ids, group, at in ((left, ids_a, group_a, at_a), (right, ids_b, group_b, at_b)):
            closes = np.append(group[1:] != group[:-1], True)[: len(ids)]
            shown[at] = np.where(closes, side.last[ids], side.between[ids])
        stop = np.cumsum(self.n_a + self.n_b).tolist()
        self.digests = [
            hashlib.sha256("".join(shown[i:j].tolist())[:-1].encode()).hexdigest()
            for i, j in zip([0, *stop], stop)
        ]


_TEXTS = "text string, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_FIELDS = f"kind int, {_TEXTS}, pairs array<long>, documents array<long>"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def _flush(number: int, keys: list, texts: list[str], copies: list[int], left: Side, right: Side):
    """Rows of the texts that both sides spell out, and a row for their block."""
    both = [(k, n, a, b) for k, n, a, b in zip(keys, copies, left.of(texts), right.of(texts)) if a is not None and b is not None]
    if not both:
        return None
    keys, copies, a, b = zip(*both)
    block = Block(a, b, left, right)
    place, times = block.place.astype("<u4"), block.times.astype("<u4")
    cut = block.border.tolist()
    links = [place[i:j].tobytes() + times[i:j].tobytes() for i, j in zip(cut, cut[1:])]
    m, none = len(keys), [None]
    columns = [
        pa.array([0] * m + [1], pa.int32()),
        pa.array([*keys, None], pa.string()),
        pa.array([number] * (m + 1), pa.int64()),
        *(pa.array([*x.tolist(), None], pa.int64()) for x in (block.n_a, block.n_b, block.n_groups, block.n_links)),
        pa.array(block.digests + none, pa.string()),
        pa.array(links + none, pa.binary()),
        pa.array(none * m + [block.pairs], pa.list_(pa.int64())),
        pa.array(none * m + [block.documents(np.array(copies))], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _align(left_path: str, right_path: str):
    def run(batches):
        left, right = Left(ByteLevel(left_path)), Right(SentencePieces(right_path))
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in chain(batches, [None]):
            rows = [] if batch is None else zip(*(c.to_pylist() for c in batch.columns))
            for row in chain(rows, [None] if batch is None else []):
                if row is not None:
                    held.append(row)
                    size += len(row[1])
                if held and (row is None or size >= BLOCK):
                    out = _flush(number, *map(list, zip(*held)), left, right)
                    number, held, size = number + 1, [], 0
                    if out is not None:
                        yield out

    return run


def _scores(key: tuple, texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links of one block's texts, weighed with the corpus-wide counts of its pairs."""
    place = np.asarray(pairs["place"])
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = np.asarray(pairs["count"]), np.asarray(pairs["best"])
    raw = texts["links"].to_pylist()
    at = [np.frombuffer(x, "<u4").astype(np.int64).reshape(2, -1) for x in raw]
    both = np.concatenate([np.zeros((2, 0), np.int64), *at], axis=1)
    border = np.cumsum([0, *(x.shape[1] for x in at)])
    sums = [np.concatenate([[0], np.cumsum(x[both[0]] * both[1])]) for x in (best, count)]
    told = [texts[c] for c in ("text", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    found = [pa.chunked_array([pa.array(np.diff(s[border]))]) for s in sums]
    return pa.Table.from_arrays(
        [*told, *found], ["text", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    )


def align_texts(
    docs: DataFrame, text_col: str = "text", left_path: str | None = None, right_path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Measures of each distinct text and the corpus-wide counts of id pairs.

    The first has text (SHA-256 of the text), n_a, n_b, n_groups, n_links, groups_sha256,
    n_best, count_sum; texts that are null, empty or not spelt out by both sides have no row.
    The second has a, b, documents, best (no pair of the same ``a`` is in more documents).
    """
    left = left_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    right = right_path or public_tokenizers.path("piece_bpe_32k.model")
    text = F.col(text_col).cast("string").alias("text")
    distinct = docs.select(text).where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = distinct.select(text_key("text").alias("key"), "text", "copies")
    rows = stored(keyed.mapInArrow(_align(left, right), _FIELDS), "aligned")
    lists = rows.where("kind = 1").select("block", F.arrays_zip("pairs", "documents").alias("of"))
    entries = lists.select("block", F.posexplode("of").alias("place", "of")).select(
        "block", "place", F.col("of.pairs").alias("pair"), F.col("of.documents").alias("documents")
    )
    totals = stored(entries.groupBy("pair").agg(F.sum("documents").alias("count")), "pair-counts")
    a = F.shiftright("pair", 32)
    # one row per id of the left vocabulary at most
    top = totals.groupBy(a.alias("a")).agg(F.max("count").alias("top"))
    best = totals.withColumn("a", a).join(F.broadcast(top), "a")
    best = best.select("pair", "a", "count", (F.col("count") == F.col("top")).alias("best"))
    counted = entries.select("block", "place", "pair").join(best.select("pair", "count", "best"), "pair")
    counted = counted.select(
        F.col("block").alias("of_block"), F.col("place").cast("long"), "count", F.col("best").cast("long").alias("best")
    )
    texts = rows.where("kind = 0").drop("kind", "pairs", "documents")
    fields = "text string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    measures = texts.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(_scores, fields)
    pairs = best.select(
        "a", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), F.col("count").alias("documents"), "best"
    )
    return measures, pairs


def text_key(column: str) -> Column:
    return F.sha2(F.col(column).cast("string"), 256)


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    left_path: str | None = None,
    right_path: str | None = None,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per input row.

    A is the byte-level vocabulary over a space and the text, B the model of pieces over the text;
    strings of special tokens are plain text. Groups end where tokens of both end; links are pairs of
    overlapping tokens; ``count_sum`` adds over the links in how many documents their ids are
    linked, ``n_best`` counts links whose ids are A's most frequent pair, ties included. Rows whose
    text is null, empty or not spelt out by both sides have zeros and an empty digest. Repeated rows
    count and are returned each; other columns are ignored; an empty table gives an empty one.
    """
    measures, _ = align_texts(docs, text_col, left_path, right_path)
    slim = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text"))
    joined = slim.join(measures, "text", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    digest = F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], digest)
