"""Periodic runs of words, found on harmonic grids with a difference cover.

A run with period q and at least 2q words holds two neighbouring points of the grid
0, q, 2q, ... of its text. For every q up to half the words, neighbouring grid points are
compared: the words they share forwards and backwards give the run around them. There are
n/1 + n/2 + n/3 + ... such pairs.

How far two positions agree (their longest common extension) comes from a suffix array of
only the positions whose remainder modulo ``MODULUS`` lies in ``COVER``. Every difference
modulo ``MODULUS`` occurs in the cover, so any two positions meet sampled ones after the same
few words: those are compared one by one, the rest is a range minimum over the sampled
suffixes' common prefixes, answered from a sparse table.

Every text is decided on its own, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: a perfect difference set: every difference modulo 21 occurs
MODULUS, COVER = 21, (0, 1, 4, 14, 16)
#: words of the texts that are indexed at once, about; a longer text is one batch
WORDS = 1 << 18
#: pairs of grid points that are made at once, about
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _meetings() -> np.ndarray:
    """For two remainders, the least number of steps after which both are in the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    steps = np.arange(MODULUS)
    a = inside[(steps[:, None] + steps) % MODULUS]
    both = a[:, None, :] & a[None, :, :]
    if not both.any(axis=2).all():
        raise ValueError("not a difference cover")
    return both.argmax(axis=2)


MEETING = _meetings()


class Extensions:
    """Longest common extensions in a sequence of integers.

    ``group`` numbers the texts. Each text must be followed by a value that occurs nowhere else,
    so that no two positions agree beyond their text; only positions of one text may be asked.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray):
        n = len(values)
        # values that occur nowhere else let every comparison end before the padding does
        pad = values.min(initial=0) - 1 - np.arange(2 * MODULUS)
        self.values = np.concatenate([values, pad.astype(values.dtype)])
        length = -(-(n + 1) // MODULUS)
        # one row for each remainder: the block after a sampled position is its right neighbour
        self.length = length
        row = np.array(COVER)[:, None] + MODULUS * np.arange(length)
        self.row_of = np.full(MODULUS, -1)
        self.row_of[list(COVER)] = np.arange(len(COVER))
        group = np.append(group, np.full(2 * MODULUS, -1))
        self._order(self._names(row.ravel(), group))

    def _names(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Numbers of the blocks of ``MODULUS`` values at ``at``, equal for equal blocks of one text."""
        seed = np.uint64(1)
        while True:
            codes = mix(self.values.astype(np.int64).view(np.uint64) + seed)
            hashes = mix(group[at].astype(np.int64).view(np.uint64))
            for k in range(MODULUS):
                hashes = hashes * _BASE + codes[at + k]
            hashes = mix(hashes)
            order = np.argsort(hashes, kind="stable")
            found = hashes[order]
            same = np.flatnonzero(found[1:] == found[:-1])
            a, b = at[order[same]], at[order[same + 1]]
            equal = group[a] == group[b]
            for k in range(MODULUS):
                equal &= self.values[a + k] == self.values[b + k]
            if equal.all():
                break
            seed += np.uint64(1)
        first = np.append(True, found[1:] != found[:-1])
        start = np.flatnonzero(first)
        names = np.empty(len(at), np.int64)
        names[order] = np.repeat(start, np.diff(np.append(start, len(at))))
        return names

    def _order(self, names: np.ndarray) -> None:
        """Sort the sampled suffixes by doubling; only those not yet told apart take part.

        The last block of a row holds padding, so equal blocks always have right neighbours.
        """
        m = len(names)
        levels, step, rank = [names], 1, names
        open_ = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
        while len(open_):
            follow = rank[open_ + step]
            order = np.lexsort((follow, rank[open_]))
            at, head, follow = open_[order], rank[open_[order]], follow[order]
            new_head = np.append(True, head[1:] != head[:-1])
            new = new_head | np.append(True, follow[1:] != follow[:-1])
            where = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(new_head, where, 0))
            part = np.maximum.accumulate(np.where(new, where, 0))
            rank = rank.copy()
            rank[at] = head + part - begin
            levels.append(rank)
            step *= 2
            size = np.diff(np.append(np.flatnonzero(new), len(at)))
            open_ = np.sort(at[np.repeat(size > 1, size)])
        self.rank = rank
        suffix = np.empty(m, np.int64)
        suffix[rank] = np.arange(m)
        self._table(self._common(levels, suffix[:-1], suffix[1:]))

    def _common(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Blocks that neighbours in the order share."""
        common = np.zeros(len(a), np.int32)
        left = np.flatnonzero(levels[0][a] == levels[0][b])
        a, b = a[left], b[left]
        for k in range(len(levels) - 1, -1, -1):
            jump = np.where(levels[k][a] == levels[k][b], 1 << k, 0)
            common[left] += jump.astype(np.int32)
            a, b = a + jump, b + jump
        return common

    def _table(self, common: np.ndarray) -> None:
        """Minimum of every 2**k neighbours; nothing is kept above a level that is zero."""
        self.least = [common]
        width = 1
        while 2 * width <= len(common) and self.least[-1].any():
            low = self.least[-1]
            self.least.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def _sampled(self, p: np.ndarray) -> np.ndarray:
        return self.row_of[p % MODULUS] * self.length + p // MODULUS

    def _shared_blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[self._sampled(i)], self.rank[self._sampled(j)]
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        for level in range(min(int(k.max(initial=-1)) + 1, len(self.least))):
            t = np.flatnonzero(k == level)
            row = self.least[level]
            out[t] = np.minimum(row[low[t]], row[high[t] - (1 << level)])
        return out

    def _step(self, i, j, out, steps) -> np.ndarray:
        """Compare up to ``steps`` values one by one; the pairs that agree in all of them."""
        left = np.arange(len(i))
        for k in range(int(steps.max(initial=0))):
            at = left[steps[left] > k]
            equal = self.values[i[at] + out[at]] == self.values[j[at] + out[at]]
            out[at[equal]] += 1
            left = np.concatenate([left[steps[left] <= k], at[equal]])
        return left

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values agree from ``i`` and from ``j`` on (i != j, one text)."""
        out = np.zeros(len(i), np.int64)
        left = self._step(i, j, out, MEETING[i % MODULUS, j % MODULUS])
        if len(left):
            a, b, more = i[left], j[left], out[left]
            more += MODULUS * self._shared_blocks(a + more, b + more)
            self._step(a, b, more, np.full(len(a), MODULUS))
            out[left] = more
        return out


def grid_pairs(size: np.ndarray, first: np.ndarray, values: np.ndarray):
    """(text, position, period) of neighbouring grid points with equal values, in portions."""
    text, period, number, held = [], [], [], 0
    for d, n in enumerate(size.tolist()):
        q = np.arange(1, n // 2 + 1)
        count = (n - 1) // q
        total = np.cumsum(count)
        low = 0
        while low < len(q):
            before = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + PAIRS, "right")))
            text.append(np.full(high - low, d))
            period.append(q[low:high])
            number.append(count[low:high])
            held += int(total[high - 1] - before)
            low = high
            if held >= PAIRS:
                yield _pairs(text, period, number, first, values)
                text, period, number, held = [], [], [], 0
    if held:
        yield _pairs(text, period, number, first, values)


def _pairs(text, period, number, first, values):
    text, period, number = np.concatenate(text), np.concatenate(period), np.concatenate(number)
    row = np.repeat(np.arange(len(text)), number)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    q = period[row]
    i = first[text[row]] + inner * q
    hit = np.flatnonzero(values[i] == values[i + q])
    return text[row[hit]], i[hit], q[hit]


def find_runs(words: np.ndarray, size: np.ndarray, least: int = 12):
    """(text, start, length, period) of all runs, ordered; ``words`` holds the texts one after another.

    A run is a longest stretch with smallest period q and at least ``max(least, 2q)`` words.
    """
    size = np.asarray(size, np.int64)
    m = len(size)
    first = np.cumsum(size) - size + np.arange(1, m + 1)  # with a value of its own before each text
    values = np.empty(len(words) + m + 1, np.int64)
    border = np.append(first - 1, len(values) - 1)
    values[border] = -1 - np.arange(m + 1)
    inside = np.ones(len(values), bool)
    inside[border] = False
    values[inside] = words
    group = np.repeat(np.arange(m + 1), np.append(size + 1, 1))
    wanted = np.where(size >= least, size, 0)
    ahead = behind = None
    found = []
    for text, i, q in grid_pairs(wanted, first, values):
        if ahead is None:
            ahead = Extensions(values, group)
            behind = Extensions(values[::-1], group[::-1])
        f = ahead(i, i + q)
        last = len(values) - 1
        b = behind(last - (i - 1), last - (i + q - 1))
        run = np.flatnonzero((f + b >= q) & (f + b + q >= least))
        found.append(np.stack([text[run], i[run] - b[run] - first[text[run]], (f + b + q)[run], q[run]]))
    if not found:
        return np.zeros((4, 0), np.int64)
    text, start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    # the same stretch is also found with multiples of its period
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, q = text[new], start[new], length[new], q[new]
    order = np.lexsort((q, start, text))
    return np.stack([text[order], start[order], length[order], q[order]])


def _split(texts: pa.Array):
    """The words of all texts and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    filled = np.asarray(pc.not_equal(pc.binary_length(words), 0))
    border = np.concatenate([[0], np.cumsum(filled)])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return words.filter(pa.array(filled)), np.diff(border)


def _portions(texts: pa.Array):
    """Neighbouring texts of about ``WORDS`` words, taken as six bytes each."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    low = 0
    total = np.concatenate([[0], np.cumsum(size)])
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(total, total[low] + 6 * WORDS, "right")) - 1)
        yield low, high
        low = high


def _runs(least: int):
    def run(batches):
        for batch in batches:
            for low, high in _portions(batch.column(1)):
                words, size = _split(batch.column(1).slice(low, high - low))
                ids = np.asarray(words.dictionary_encode().indices)
                text, start, length, period = find_runs(ids, size, least)
                begin = np.cumsum(size) - size
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, begin[text] + start + period, 1)
                np.add.at(change, begin[text] + start + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[np.append(begin, len(ids))]
                border = np.searchsorted(text, np.arange(len(size) + 1))
                structs = pa.StructArray.from_arrays(
                    [pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"]
                )
                lists = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.filter(pa.array(keep)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(size),
                        pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), structs),
                        pc.binary_join(lists, " "),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed: one row per input row.

    Words are the stretches between ASCII white space. ``runs`` holds all longest stretches of
    at least ``max(least, 2 * period)`` words that repeat with their smallest period, by start and
    then period. ``collapsed`` is the text without the words that any run holds after its first
    period, joined by single spaces. Null texts are empty; repeated rows give repeated results;
    an empty table gives an empty one. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    schema = T.StructType([slim.schema["doc_id"], *T.StructType.fromDDL(fields).fields])
    return slim.mapInArrow(_runs(least), schema)
