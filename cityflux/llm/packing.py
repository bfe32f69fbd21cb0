"""Packing documents into training sequences: bounded-space online best-fit.

Documents become pieces of at most ``limit`` tokens. Pieces are dealt to tasks by hash and
arrive there in a fixed order, longest first. A task keeps at most ``open_bins`` bins open,
in a bitset whose bit ``f`` says that some open bin has ``f`` tokens left: the best fit is
the lowest set bit at or above the piece's length, and when a further bin must be opened
the fullest one closes first.

The number of tasks follows from the number of tokens, so a task's state and the share of
bins left partly filled at its end do not depend on the size of the input.
"""

from __future__ import annotations

import base64
import json
import sys
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import partitions_for, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: the tokenizer whose added tokens the registered queries take
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: sequences a task fills, about
SEQUENCES = 4096


def added_tokens(json_path: str) -> dict[str, int]:
    """Tokens that a tokenizer's JSON file adds to its vocabulary, with their ids.

    Only plain ones: a token that takes in spaces or depends on its neighbours or on a
    normaliser is not split off as ``encoder`` does it.
    """
    with open(json_path, encoding="utf-8") as f:
        told = json.load(f)
    for x in told["added_tokens"]:
        if x["single_word"] or x["lstrip"] or x["rstrip"] or (x["normalized"] and told["normalizer"]):
            raise ValueError(f"added token {x['content']!r} of {json_path} is not plain")
    return {x["content"]: x["id"] for x in told["added_tokens"]}


def encoder(ranks_path: str, added: dict[str, int] | None = None):
    """A function text -> ids as little-endian unsigned 32-bit bytes.

    The vocabulary file of ranks holds the same byte-level BPE as the JSON file. Texts are
    split at the tokens ``added``, which get their own ids, as ``tokenizers`` does by default;
    without them such strings are ordinary text.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bpe = tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added or {}
    )

    def encode(text: str) -> bytes:
        if added and any(x in text for x in added):
            return array("I", bpe.encode(text, allowed_special="all")).tobytes()
        return array("I", bpe.encode_ordinary(text)).tobytes()

    return encode


def cuts(n: int, limit: int) -> list[int]:
    """Borders of the pieces of ``n`` tokens; the first piece takes the remainder."""
    return [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]


def _pieces(ranks_path: str, limit: int, end_id: int, added: dict[str, int] | None):
    def run(batches):
        encode = encoder(ranks_path, added)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(k, 256)
                row, piece, start, length, body = [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(k, 256).to_pylist()):
                    tokens = encode(text or "") + end
                    border = cuts(len(tokens) // 4, limit)
                    for p, (a, b) in enumerate(zip(border, border[1:])):
                        row.append(i)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        body.append(tokens[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(body, pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return run


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    limit: int = 2048,
    end_id: int = 0,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    Null texts are empty; each document ends with ``end_id``. Documents of more than
    ``limit`` tokens are cut from their end, so only the first piece may be shorter.
    Repeated rows give repeated pieces; empty tables give empty results. Strings of the tokens
    ``added`` (see ``added_tokens``) become their ids; without it they are ordinary text.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            slim.schema["doc_id"],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return slim.mapInArrow(_pieces(path, limit, end_id, added), schema)


class OpenBins:
    """At most ``most`` open bins of ``limit`` tokens, found by their free space."""

    def __init__(self, limit: int, most: int):
        self.limit, self.most = limit, most
        self.bits, self.count, self.made = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(limit + 1)]

    def _take(self, space: int) -> int:
        at = self.by_space[space]
        found = at.pop()
        if not at:
            self.bits &= ~(1 << space)
        self.count -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            space, chosen = self.limit, self.made
            self.made += 1
        left = space - length
        if left:
            if self.count == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_space[left].append(chosen)
            self.bits |= 1 << left
            self.count += 1
        return chosen, self.limit - space


def _packed(limit: int, open_bins: int, at: int):
    def run(batches):
        bins = OpenBins(limit, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(x) for x in batch.column(at).to_pylist()]
            where = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where[:, 0] + base), pa.array(where[:, 1].copy())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def best_fit(
    pieces: DataFrame, limit: int = 2048, open_bins: int = 4096, sequences: int = SEQUENCES
) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ...) with sequence_id and offset.

    ``pieces`` must be stored: the number of tokens is counted first. Places in a
    sequence are gapless from 0; sequence ids are unique but not dense.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = partitions_for(total, limit * sequences)
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "start"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", *_rest(pieces))
    schema = T.StructType(
        [
            *pieces.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    return ordered.mapInArrow(_packed(limit, open_bins, pieces.columns.index("length")), schema)


def _rest(pieces: DataFrame) -> list[str]:
    return [c for c in pieces.columns if c not in ("doc_id", "piece", "length")]


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    limit: int = 2048,
    end_id: int = 0,
    open_bins: int = 4096,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces with their ids and places: what a trainer reads."""
    pieces = token_pieces(docs, id_col, text_col, ranks_path, limit, end_id, added)
    return best_fit(stored(pieces, "pieces"), limit, open_bins)
