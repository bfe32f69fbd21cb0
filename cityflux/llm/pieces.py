"""SentencePiece encoding and decoding, with giant documents as a max-plus parallel scan.

A segmentation is a path of pieces over a text. In a unigram model a step scores the log
probability of its piece; in a BPE model a step scores 0 if the merges of the two pieces'
text end in just these two pieces, else minus infinity, and the one path all of whose
steps are finite is what merging gives. Scores are integers, so sums do not depend on how
they are grouped.

Documents up to ``CHUNK`` characters are encoded where they are: no piece goes on over a
word's start, so words are encoded alone and remembered. Longer documents are split into
chunks. The state at a border is the piece that reaches or crosses it; every chunk yields
the matrix of best scores from each state at its start to each state at its end. Matrices
combine by max-plus products, in blocks and then over blocks; the states on the best path
return to the chunks, and each chunk traces its part of the path back on its own.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: characters of a chunk, chunks of a block
CHUNK, BLOCK = 32_768, 64
#: words a task remembers, and the longest such word
REMEMBERED, WORD = 300_000, 48
SPACE = "▁"
#: minus infinity, such that sums of two stay in range
NEVER = -(1 << 61)
#: units of a unigram model's log probabilities
SCALE = 1 << 20
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")


class Pieces:
    """The pieces of a model file and the scores of steps between them."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = self.model
        size = kinds.get_piece_size()
        special = [kinds.is_control(i) or kinds.is_unknown(i) or kinds.is_unused(i) for i in range(size)]
        self.byte = {int(kinds.id_to_piece(i)[1:-1], 16): i for i in range(size) if kinds.is_byte(i)}
        self.id = {
            kinds.id_to_piece(i): i for i in range(size) if not special[i] and not kinds.is_byte(i)
        }
        self.score = {p: kinds.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces go on over a word's start")
        # BPE models number their merges; log probabilities are no whole numbers
        self.bpe = all(s == int(s) for s in self.score.values())
        least = min(self.score.values())
        self.missing = round((least - 10) * SCALE)
        self.surface = [b""] * size
        for p, i in self.id.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.surface[i] = bytes([value])
        self.step = cache(self._step)

    def known(self, part: str) -> bool:
        """Whether a path may use it: a piece, or a character in bytes."""
        return part in self.id or len(part) == 1

    def ids(self, part: str) -> list[int]:
        found = self.id.get(part)
        return [self.byte[b] for b in part.encode()] if found is None else [found]

    def merged(self, text: str) -> list[str]:
        """Adjacent symbols merge into the piece of the highest score, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _step(self, before: str | None, part: str) -> int:
        if self.bpe:
            whole = self.merged(part) == [part] if before is None else self.merged(before + part) == [before, part]
            return 0 if whole else NEVER
        return round(self.score[part] * SCALE) if part in self.score else self.missing


def marked(text: str) -> str:
    """The text as pieces see it: a space before it, and spaces as visible marks."""
    return SPACE + text.replace(" ", SPACE)


def is_cut(text: str, p: int) -> bool:
    """A word starts at ``p``: every path has a border there, and steps over it are free."""
    return p == 0 or p == len(text) or (text[p] == SPACE and text[p - 1] != SPACE)


class Words(dict):
    """Ids (little-endian bytes) of words, encoded by the library once."""

    def __init__(self, pieces: Pieces):
        # the library puts the first mark itself, but not before an empty text
        super().__init__({SPACE: array("i", pieces.ids(SPACE)).tobytes()})
        self.encode = pieces.model.encode

    def __missing__(self, unit: str) -> bytes:
        ids = array("i", self.encode(unit[1:].replace(SPACE, " "))).tobytes()
        if len(unit) <= WORD:
            if len(self) >= REMEMBERED:
                mark = self[SPACE]
                self.clear()
                self[SPACE] = mark
            self[unit] = ids
        return ids


def paths(pieces: Pieces, text: str, start: int, before: int | None, stop: int) -> dict:
    """Best paths on from border ``start``, reached by the piece from ``before``.

    Gives {(q, r): (score, previous)} for every piece ``text[q:r]`` with ``q < stop``; a
    border that is a cut has the one state ``(r, r)``.
    """
    first = (start, start) if before is None or is_cut(text, start) else (before, start)
    best = {first: (0, None)}
    at: dict[int, list] = {start: [first]}
    for p in range(start, stop):
        for state in at.pop(p, ()):
            score = best[state][0]
            left = None if state[0] == state[1] else text[state[0] : p]
            for r in range(p + 1, min(len(text), p + pieces.longest) + 1):
                part = text[p:r]
                if not pieces.known(part):
                    continue
                step = pieces.step(left, part)
                if step == NEVER:
                    continue
                to = (r, r) if is_cut(text, r) else (p, r)
                old = best.get(to)
                if old is None:
                    at.setdefault(r, []).append(to)
                if old is None or score + step > old[0]:
                    best[to] = (score + step, (state, p, r))
    return best


def border_states(pieces: Pieces, text: str, x: int) -> list[tuple[int, int]]:
    """All pieces that reach or cross border ``x``; the one state of a cut."""
    if is_cut(text, x):
        return [(x, x)]
    found = []
    for q in range(max(0, x - pieces.longest), x):
        for r in range(x, min(len(text), q + pieces.longest) + 1):
            part = text[q:r]
            if pieces.known(part) and SPACE not in part.lstrip(SPACE):
                if not any(is_cut(text, p) for p in range(q + 1, r)):
                    found.append((r, r) if is_cut(text, r) else (q, r))
    return sorted(set(found))


def _cuts_inside(text: str, a: int, b: int) -> list[int]:
    """The first and the last cut in ``[a, b]``, if there are two."""
    first = next((p for p in range(a, b + 1) if is_cut(text, p)), None)
    if first is None:
        return []
    last = next(p for p in range(b, a - 1, -1) if is_cut(text, p))
    return [first, last] if last > first else []


class Chunk:
    """Part ``[a, b)`` of a document with enough of its surroundings."""

    def __init__(self, pieces: Pieces, text: str, a: int, b: int):
        self.pieces, self.text, self.a, self.b = pieces, text, a, b
        self.entry = border_states(pieces, text, a) if a else [(0, 0)]
        self.exit = border_states(pieces, text, b)

    def _begin(self, state):
        q, r = state
        return r, None if q == r else q

    def _middle(self, c1: int, c2: int) -> int:
        """Score between two cuts."""
        if self.pieces.bpe:
            return 0
        return paths(self.pieces, self.text, c1, None, c2)[c2, c2][0]

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.entry), len(self.exit)), NEVER, np.int64)
        reach = max(r for _, r in self.entry)
        cuts = _cuts_inside(self.text, reach, self.b)
        if cuts:  # all paths meet in the cuts
            middle = self._middle(*cuts)
            tail = paths(self.pieces, self.text, cuts[1], None, self.b)
        for i, state in enumerate(self.entry):
            start, before = self._begin(state)
            if cuts:
                head = paths(self.pieces, self.text, start, before, cuts[0]).get((cuts[0], cuts[0]))
                base, found = (head[0] + middle, tail) if head else (NEVER, {})
            else:
                base, found = 0, paths(self.pieces, self.text, start, before, self.b)
            for j, state in enumerate(self.exit):
                if state in found and base != NEVER:
                    out[i, j] = base + found[state][0]
        return out

    def _trace(self, start: int, before: int | None, to: tuple[int, int], stop: int) -> list[int]:
        found = paths(self.pieces, self.text, start, before, stop)
        parts = []
        while found[to][1] is not None:
            to, p, r = found[to][1]
            parts.append(self.pieces.ids(self.text[p:r]))
        return [i for part in reversed(parts) for i in part]

    def ids(self, words: Words, i: int, j: int) -> bytes:
        """Ids of the pieces that start in the chunk, from entry state i to exit state j."""
        start, before = self._begin(self.entry[i])
        cuts = _cuts_inside(self.text, max(r for _, r in self.entry), self.b)
        if not cuts:
            return array("i", self._trace(start, before, self.exit[j], self.b)).tobytes()
        c1, c2 = cuts
        head = self._trace(start, before, (c1, c1), c1)
        middle = b"".join([words[u] for u in _UNIT.findall(self.text[c1:c2])])
        tail = self._trace(c2, None, self.exit[j], self.b)
        return array("i", head).tobytes() + middle + array("i", tail).tobytes()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), NEVER)


def route(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """States at all borders of the best path from ``first`` to ``last``."""
    ahead = [np.full(matrices[0].shape[0], NEVER, np.int64)]
    ahead[0][first] = 0
    for m in matrices:
        ahead.append(product(ahead[-1][None], m)[0])
    states = [last]
    for v, m in zip(reversed(ahead[:-1]), reversed(matrices)):
        states.append(int(np.argmax(np.maximum(v + m[:, states[-1]], NEVER))))
    return states[::-1]


def _encode_small(path: str):
    def run(batches):
        words = Words(Pieces(path))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                ids = [b"".join([words[u] for u in _UNIT.findall(marked(t))]) if t else b"" for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _split(path: str, size: int):
    """Chunks of giant documents; ``body`` starts ``a`` characters before the chunk."""

    def run(batches):
        reach = 2 * Pieces(path).longest + 1
        for batch in batches:
            for i in range(batch.num_rows):
                text = marked(batch.column(1)[i].as_py())
                # the last chunk takes what is too short for one
                borders = [*range(0, max(1, len(text) - reach), size), len(text)]
                for k, (x, y) in enumerate(zip(borders, borders[1:])):
                    low = max(0, x - reach)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, 1),
                            pa.array([k]),
                            pa.array([text[low : y + reach]]),
                            pa.array([x - low]),
                            pa.array([y - low]),
                            pa.array([y == len(text)]),
                        ],
                        ["row", "chunk", "body", "a", "b", "ends"],
                    )

    return run


def _chunk_at(pieces: Pieces, batch, i: int) -> Chunk:
    body, a, b, ends = (batch.column(c)[i].as_py() for c in ("body", "a", "b", "ends"))
    # beyond a chunk that does not end the text, a mark that no border looks at
    return Chunk(pieces, body if ends else body + "\0", a, b)


def _matrices(path: str):
    def run(batches):
        pieces = Pieces(path)
        for batch in batches:
            for i in range(batch.num_rows):
                m = _chunk_at(pieces, batch, i).matrix()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(i, 1),
                        batch.column("chunk").slice(i, 1),
                        pa.array([m.shape[0]]),
                        pa.array([m.ravel().tolist()], pa.list_(pa.int64())),
                    ],
                    ["row", "chunk", "entries", "scores"],
                )

    return run


def _as_matrices(rows: pd.DataFrame, by: str) -> list[np.ndarray]:
    rows = rows.sort_values(by)
    return [np.array(s, np.int64).reshape(n, -1) for n, s in zip(rows["entries"], rows["scores"])]


def _block_product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    matrices = _as_matrices(rows, "chunk")
    total = matrices[0]
    for m in matrices[1:]:
        total = product(total, m)
    return pd.DataFrame([(*key, total.shape[0], total.ravel().tolist())], columns=["row", "block", "entries", "scores"])


def _block_states(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    states = route(_as_matrices(rows, "block"), 0, 0)
    blocks = sorted(rows["block"])
    return pd.DataFrame({"row": key[0], "block": blocks, "first": states[:-1], "last": states[1:]})


def _chunk_states(key: tuple, chunks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    states = route(_as_matrices(chunks, "chunk"), int(block["first"].iloc[0]), int(block["last"].iloc[0]))
    return pd.DataFrame({"row": key[0], "chunk": sorted(chunks["chunk"]), "first": states[:-1], "last": states[1:]})


def _trace_back(path: str):
    def run(batches):
        pieces = Pieces(path)
        words = Words(pieces)
        for batch in batches:
            for i in range(batch.num_rows):
                first, last = (batch.column(c)[i].as_py() for c in ("first", "last"))
                ids = _chunk_at(pieces, batch, i).ids(words, first, last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, 1), batch.column("chunk").slice(i, 1), pa.array([ids], pa.binary())],
                    ["row", "chunk", "ids"],
                )

    return run


def _encode_giants(giants: DataFrame, path: str, size: int) -> DataFrame:
    """row, ids of documents (row, text) of any length."""
    kind = "row long, chunk long, body string, a long, b long, ends boolean"
    chunks = stored(giants.repartition("row").mapInArrow(_split(path, size), kind), "chunks")
    dealt = chunks.repartition("row", "chunk")
    found = dealt.mapInArrow(_matrices(path), "row long, chunk long, entries long, scores array<long>")
    matrices = stored(found.withColumn("block", F.floor(F.col("chunk") / BLOCK)), "matrices")
    blocks = matrices.groupBy("row", "block").applyInPandas(
        _block_product, "row long, block long, entries long, scores array<long>"
    )
    of_blocks = blocks.groupBy("row").applyInPandas(
        _block_states, "row long, block long, first long, last long"
    )
    states = (
        matrices.groupBy("row", "block")
        .cogroup(of_blocks.groupBy("row", "block"))
        .applyInPandas(_chunk_states, "row long, chunk long, first long, last long")
    )
    traced = chunks.join(states, ["row", "chunk"]).mapInArrow(
        _trace_back(path), "row long, chunk long, ids binary"
    )
    parts = F.sort_array(F.collect_list(F.struct("chunk", F.hex("ids").alias("ids"))))
    whole = traced.groupBy("row").agg(parts.alias("parts"))
    return whole.select("row", F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids"))


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit): one row per input row.

    The ids are those of the library. Null and empty texts have none. Characters without a
    piece become bytes. Repeated rows each come out; empty tables give empty results.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    schema = T.StructType([slim.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    small = slim.where(F.length("text") <= chunk).mapInArrow(_encode_small(path), schema)
    giants = slim.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    giants = stored(giants, "giants")
    found = _encode_giants(giants.select("row", "text"), path, chunk)
    return small.unionByName(giants.select("row", "doc_id").join(found, "row").select("doc_id", "ids"))


def _decode(path: str):
    def run(batches):
        surface = Pieces(path).surface
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = []
                for raw in part.column("ids").to_pylist():
                    whole = b"".join([surface[i] for i in np.frombuffer(raw or b"", "<i4").tolist()])
                    texts.append(whole.removeprefix(b" ").decode("utf-8", "replace"))
                names = [*batch.schema.names, "text"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return run


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``encoded`` (with ids) and the text: the one encoded, with U+2581 read as a space."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])
    return encoded.mapInArrow(_decode(path), schema)
