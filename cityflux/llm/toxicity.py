"""Toxicity scores of a small bidirectional gated recurrent network, trained in numpy.

A word is read through words and characters: log-odds of the word and of its character
n-grams between the labels, a learned vector of the word and learned vectors of its
characters. Attention pools windows of words over the states of a bidirectional GRU, and a
document scores as its most toxic window. Windows start at every word. They share the
recurrent steps: the network runs over stripes, each as long as all windows that start in its
first ``STARTS`` words, and pooling a window takes two differences of running sums. Labels hold for documents, so training learns from each document's highest window
(multiple-instance learning), on a bounded sample of labelled rows.
"""

from __future__ import annotations

import pickle
import re
import sys
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from .tables import mix, shared

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: labelled documents per class in training, and the longest such document in characters
PER_CLASS, LONGEST = 1500, 20_000
#: words per window, windows per stripe (one starts at each word), words per stripe
WINDOW, STARTS = 32, 32
STRIPE = WINDOW + STARTS - 1
#: documents of a scoring batch, stripes of a pass through the network
DOCS, PASS = 128, 2048
HIDDEN, ATTENTION = 8, 8
CHARS, CHAR_SIZE = 256, 6
WORDS, WORD_SIZE = 4096, 4
#: buckets of the log-odds tables; an entry needs so many documents and a difference of so
#: many standard deviations; largest value
BUCKETS, LEAST, SURE, CLIP = 1 << 18, 5, 4.0, 6.0
GRAMS = (3, 4, 5)
#: rounds over the sample and least number of steps, windows per step, step size
EPOCHS, STEPS, BATCH, RATE = 5, 160, 96, 0.01
#: windows of each clean document besides its highest, drawn anew in every round
ANY = 1
#: neighbouring windows whose mean logit is a place's
TOGETHER = 8
_WORD = re.compile(r"\w+")


class Lexicon:
    """Distinct words of some texts: hashes, characters and where each word's are."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        self.docs = [
            np.array([index.setdefault(w, len(index)) for w in _WORD.findall(t.lower())], np.int64)
            for t in texts
        ]
        words = list(index)
        joined = "".join(f"\x02{w}\x03" for w in words)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = codes.astype(np.uint64)
        self.size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(words)), self.size)
        inner = (np.arange(len(codes)) - self.start[self.owner]).astype(np.uint64)
        spread = mix(self.codes + (inner << np.uint64(32)))
        self.hash = np.add.reduceat(spread, self.start) if words else np.zeros(0, np.uint64)

    def word_slots(self) -> np.ndarray:
        return (mix(self.hash) % np.uint64(BUCKETS)).astype(np.int64)

    def gram_slots(self):
        """(slots, owning word) of the character n-grams of each size."""
        key = self.codes.copy()
        for size in range(2, max(GRAMS) + 1):
            key = key[:-1] * np.uint64(0x100000001B3) + self.codes[size - 1 :]
            owner = self.owner[size - 1 :]
            inside = owner == self.owner[: len(owner)]
            if size in GRAMS:
                hashed = mix(key[inside] + np.uint64(size)) % np.uint64(BUCKETS)
                yield hashed.astype(np.int64), owner[inside]


def log_odds(seen: Iterable[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Per bucket: how much more often toxic documents have it than clean ones."""
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for slots, label in zip(seen, labels):
        (toxic if label else clean)[slots] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    share = (toxic + clean) / len(labels)
    spread = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    odds[(toxic + clean < LEAST) | (np.abs(toxic / n1 - clean / n0) < SURE * spread)] = 0
    return np.clip(odds, -CLIP, CLIP).astype(np.float32) / 2


def stripes_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of every stripe (-1 where there is none), its document, its windows."""
    windows = np.array([max(1, len(d) - WINDOW + 1) for d in docs], np.int64)
    number = -(-windows // STARTS)
    out = np.full((int(number.sum()), STRIPE), -1, np.int64)
    at = 0
    for d, n in zip(docs, number.tolist()):
        padded = np.full((n - 1) * STARTS + STRIPE, -1, np.int64)
        padded[: len(d)] = d
        out[at : at + n] = np.lib.stride_tricks.sliding_window_view(padded, STRIPE)[::STARTS]
        at += n
    owner = np.repeat(np.arange(len(docs)), number)
    before = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * STARTS
    return out, owner, np.minimum(STARTS, windows[owner] - before)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.word_odds, self.gram_odds = word_odds, gram_odds
        width = 3 + CHAR_SIZE + WORD_SIZE
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "chars": draw(CHARS, CHAR_SIZE, scale=0.1),
            "words": draw(WORDS, WORD_SIZE, scale=0.05),
            "A": draw(2 * HIDDEN, ATTENTION, scale=0.3),
            "a": np.zeros(ATTENTION, np.float32),
            "v": draw(ATTENTION, scale=0.5),
            "w": draw(2 * HIDDEN, scale=0.3),
            "c": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p["W" + d] = draw(width, 3 * HIDDEN, scale=0.3)
            self.p["U" + d] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p["b" + d] = np.zeros(3 * HIDDEN, np.float32)
            self.p["n" + d] = np.zeros(HIDDEN, np.float32)

    def word_inputs(self, lex: Lexicon) -> np.ndarray:
        n = len(lex.size)
        out = np.zeros((n, 3 + CHAR_SIZE + WORD_SIZE), np.float32)
        if not n:
            return out
        out[:, 0] = self.word_odds[lex.word_slots()]
        total, most, kinds = np.zeros(n), np.zeros(n, np.float32), np.zeros(n)
        for slots, owner in lex.gram_slots():
            if not len(slots):
                continue
            odds = self.gram_odds[slots]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            words = owner[first]
            most[words] = np.maximum(most[words], np.maximum.reduceat(odds, first))
            total[words] += np.add.reduceat(odds, first)
            kinds[words] += np.diff(np.append(first, len(owner)))
        out[:, 1], out[:, 2] = most, total / np.maximum(kinds, 1)
        chars = self.p["chars"][(lex.codes % np.uint64(CHARS)).astype(np.int64)]
        sums = np.add.reduceat(chars, lex.start, axis=0)
        out[:, 3 : 3 + CHAR_SIZE] = sums / lex.size[:, None]
        out[:, 3 + CHAR_SIZE :] = self.p["words"][(lex.hash % np.uint64(WORDS)).astype(np.int64)]
        return out

    def _states(self, inputs: np.ndarray, stripes: np.ndarray, keep: bool):
        """States of both directions at every word; ``keep`` also fills the tape of all steps."""
        p, (n, steps) = self.p, stripes.shape
        table = np.vstack([inputs, np.zeros((1, inputs.shape[1]), np.float32)])  # the last: no word
        mask = stripes >= 0
        full = mask.all(axis=0)
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        tape = []
        for side, d in enumerate("fb"):
            gates = table @ p["W" + d] + p["b" + d]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                gx, hu = gates[stripes[:, t]], h @ p["U" + d]
                zr = _sigmoid(gx[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                hn = hu[:, 2 * HIDDEN :] + p["n" + d]
                cand = np.tanh(gx[:, 2 * HIDDEN :] + r * hn)
                new = cand + z * (h - cand)
                if not full[t]:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    tape.append((d, t, h, z, r, hn, cand))
                h = new
                states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        return table, mask, states, tape

    def forward(self, inputs: np.ndarray, stripes: np.ndarray, at: np.ndarray):
        """Logit of one window of each stripe, from word ``at`` on, and what ``gradients`` needs."""
        p = self.p
        table, mask, states, tape = self._states(inputs, stripes, True)
        hidden = np.tanh(states @ p["A"] + p["a"])
        word = np.arange(stripes.shape[1])[:, None]
        inside = mask.T & (word >= at) & (word < at + WINDOW)
        score = np.where(inside, hidden @ p["v"], np.float32(-np.inf))
        top = np.where(inside.any(axis=0), score.max(axis=0), 0)
        weight = np.exp(score - top)
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-30))
        pooled = np.einsum("tn,tnh->nh", weight, states)
        return pooled @ p["w"] + p["c"], (table, mask, states, tape, hidden, weight, pooled)

    def _all_windows(self, inputs: np.ndarray, stripes: np.ndarray) -> np.ndarray:
        """Logits of all windows of each stripe; a logit is linear in what attention pools."""
        p = self.p
        _, mask, states, _ = self._states(inputs, stripes, False)
        score = np.where(mask.T, np.tanh(states @ p["A"] + p["a"]) @ p["v"], -np.inf).astype(float)
        top = np.where(mask.any(axis=1), score.max(axis=0), 0)
        weight = np.exp(score - top)
        sums = []
        for x in (weight, weight * (states @ p["w"])):
            total = np.zeros((len(x) + 1, x.shape[1]))
            np.cumsum(x, axis=0, out=total[1:])
            sums.append(total[WINDOW:] - total[:-WINDOW])
        return (sums[1] / np.maximum(sums[0], 1e-30) + p["c"]).T

    def gradients(self, lex: Lexicon, stripes: np.ndarray, kept, slope: np.ndarray) -> dict:
        """Gradients of the sum of ``slope * logit``."""
        p, (table, mask, states, tape, hidden, weight, pooled) = self.p, kept
        g = {"c": slope.sum(keepdims=True), "w": pooled.T @ slope}
        back = slope[:, None] * p["w"]
        push = np.einsum("nh,tnh->tn", back, states)
        d_states = weight[:, :, None] * back
        d_score = weight * (push - (weight * push).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", d_score, hidden)
        d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden**2)
        g["A"] = np.einsum("tnh,tnk->hk", states, d_hidden)
        g["a"] = d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ p["A"].T
        d_table = np.zeros_like(table)
        for side, d in enumerate("fb"):
            for name in ("U", "n"):
                g[name + d] = np.zeros_like(p[name + d])
            d_gates = np.zeros((len(table), 3 * HIDDEN), np.float32)
            dh = np.zeros((len(stripes), HIDDEN), np.float32)
            for _, t, h, z, r, hn, cand in [x for x in reversed(tape) if x[0] == d]:
                dh = dh + d_states[t, :, side * HIDDEN : (side + 1) * HIDDEN]
                on = mask[:, t, None]
                new = np.where(on, dh, 0)
                dh = np.where(on, 0, dh) + new * z
                dn = new * (1 - z) * (1 - cand**2)
                dz = new * (h - cand) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dhu = np.hstack([dz, dr, dn * r])
                g["U" + d] += h.T @ dhu
                g["n" + d] += (dn * r).sum(axis=0)
                dh = dh + dhu @ p["U" + d].T
                np.add.at(d_gates, stripes[:, t], np.hstack([dz, dr, dn]))
            g["W" + d] = table.T @ d_gates
            g["b" + d] = d_gates.sum(axis=0)
            d_table += d_gates @ p["W" + d].T
        d_words = d_table[:-1]
        g["chars"], g["words"] = np.zeros_like(p["chars"]), np.zeros_like(p["words"])
        used = np.flatnonzero(np.any(d_words, axis=1))
        np.add.at(
            g["words"],
            (lex.hash[used] % np.uint64(WORDS)).astype(np.int64),
            d_words[used, 3 + CHAR_SIZE :],
        )
        share = d_words[:, 3 : 3 + CHAR_SIZE] / lex.size[:, None]
        at = np.flatnonzero(np.isin(lex.owner, used))
        np.add.at(
            g["chars"], (lex.codes[at] % np.uint64(CHARS)).astype(np.int64), share[lex.owner[at]]
        )
        return g

    def window_logits(self, inputs: np.ndarray, stripes: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Logits of all windows by stripe and start; minus infinity where no window starts."""
        parts = [self._all_windows(inputs, stripes[k : k + PASS]) for k in range(0, len(stripes), PASS)]
        logits = np.concatenate([np.zeros((0, STARTS)), *parts])
        return np.where(np.arange(STARTS) < windows[:, None], logits, -np.inf)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Toxicity of whole texts: that of the highest ``TOGETHER`` neighbours of all windows.

        A toxic passage lies in many overlapping windows, a chance pattern in few.
        """
        lex = Lexicon(texts)
        stripes, owner, windows = stripes_of(lex.docs)
        logits = self.window_logits(self.word_inputs(lex), stripes, windows)
        flat = logits[np.arange(STARTS) < windows[:, None]]
        total = np.concatenate([[0.0], np.cumsum(flat)])
        stop = np.cumsum(np.bincount(owner, windows, len(texts)).astype(np.int64))
        out = np.empty(len(texts))
        for i, (a, b) in enumerate(zip([0, *stop.tolist()], stop.tolist())):
            k = min(TOGETHER, b - a)
            out[i] = (total[a + k : b + 1] - total[a : b + 1 - k]).max() / k
        return _sigmoid(out)


def without_copies(texts: list[str], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Texts of which most word 4-grams are new: a group of near copies counts once."""
    seen: set[int] = set()
    kept = []
    for i, words in enumerate(Lexicon(texts).docs):
        key = words.astype(np.uint64)
        for _ in range(3 if len(words) > 3 else 0):
            key = key[:-1] * np.uint64(0x100000001B3) + words[len(words) - len(key) + 1 :].astype(np.uint64)
        own = set(mix(key).tolist())
        if len(own & seen) <= 0.3 * len(own):
            kept.append(i)
        seen |= own
    return [texts[i] for i in kept], labels[kept]


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    distinct = without_copies(texts, labels)
    if 0 < distinct[1].sum() < len(distinct[1]):
        texts, labels = distinct
    lex = Lexicon(texts)
    slots = lex.word_slots()
    slot, owner = map(np.concatenate, zip(*lex.gram_slots()))
    slot = slot[np.argsort(owner, kind="stable")]
    size = np.bincount(owner, minlength=len(lex.size))
    start = np.cumsum(size) - size

    def grams(words: np.ndarray) -> np.ndarray:
        """Slots of the character n-grams of some words."""
        n = size[words]
        at = np.arange(n.sum()) + np.repeat(start[words] - (np.cumsum(n) - n), n)
        return np.unique(slot[at])

    distinct = [np.unique(d) for d in lex.docs]
    net = Network(
        log_odds((np.unique(slots[d]) for d in distinct), labels),
        log_odds((grams(d) for d in distinct), labels),
        seed,
    )
    stripes, owner, windows = stripes_of(lex.docs)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(x) for k, x in net.p.items()}
    square = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    parts = max(4, 2 * len(labels) // BATCH)
    for _ in range(max(EPOCHS, STEPS // parts)):
        logits = net.window_logits(net.word_inputs(lex), stripes, windows)
        order = np.lexsort((-logits.max(axis=1), owner))
        chosen = order[first]  # the stripe of each document's highest window
        # of a clean document any window is clean
        clean = np.repeat(np.flatnonzero(labels == 0), ANY)
        stripes_per = np.diff(np.append(first, len(owner)))
        any_ = first[clean] + (rng.random(len(clean)) * stripes_per[clean]).astype(int)
        rows = np.concatenate([chosen, any_])
        anywhere = (rng.random(len(clean)) * windows[any_]).astype(int)
        begin = np.concatenate([logits[chosen].argmax(axis=1), anywhere])
        truth = np.concatenate([labels, labels[clean]]).astype(np.float32)
        for part in np.array_split(rng.permutation(len(rows)), parts):
            small, back = np.unique(stripes[rows[part]], return_inverse=True)
            shift = int(small[0] < 0)
            local = back.reshape(-1, STRIPE) - shift
            sub = _part(lex, small[shift:])
            logit, kept = net.forward(net.word_inputs(sub), local, begin[part])
            slope = (_sigmoid(logit) - truth[part]) / np.float32(len(part))
            step += 1
            for k, grad in net.gradients(sub, local, kept, slope).items():
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad**2
                rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                net.p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return net


def _part(lex: Lexicon, words: np.ndarray) -> Lexicon:
    """The lexicon of some of its words, numbered from 0."""
    out = Lexicon.__new__(Lexicon)
    out.docs, out.size, out.hash = [], lex.size[words], lex.hash[words]
    out.start = np.cumsum(out.size) - out.size
    out.owner = np.repeat(np.arange(len(words)), out.size)
    out.codes = lex.codes[lex.start[words][out.owner] + np.arange(len(out.owner)) - out.start[out.owner]]
    return out


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str,
    text_col: str,
    folds: int,
    held_fold: int,
    per_class: int,
) -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` labelled texts of each class outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where((fold != held_fold) & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.length("text") <= LONGEST)
    found = []
    for label in (1, 0):
        ids = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        found += [(r.text, label) for r in rows.limit(per_class).collect()]
    return [t for t, _ in found], np.array([y for _, y in found], np.int64)


def _scored(net: Network | None, batch, text_at: int) -> np.ndarray:
    out = np.zeros(batch.num_rows)
    for k in range(0, batch.num_rows, DOCS):
        texts = [t or "" for t in batch.column(text_at).slice(k, DOCS).cast(pa.string()).to_pylist()]
        if net is not None:
            out[k : k + DOCS] = net.scores(texts)
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 3,
    held_fold: int = 1,
    per_class: int = PER_CLASS,
) -> Network | None:
    """A network from a bounded sample; None unless both labels occur in it."""
    texts, truth = labelled_sample(docs, labels, id_col, text_col, folds, held_fold, per_class)
    return train(texts, truth) if len(Counter(truth.tolist())) == 2 else None


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 3,
    held_fold: int = 1,
    threshold: float = 0.7,
    per_class: int = PER_CLASS,
) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Learned from rows whose ``crc32(id as text) % folds`` is not ``held_fold``; rows without
    an id are never learned from and not held out. Null texts score as empty ones. Without
    labels of both kinds every score is 0. Repeated rows each come out.
    """
    network = shared(
        docs.sparkSession, fit(docs, labels, id_col, text_col, folds, held_fold, per_class)
    )
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches):
        net = pickle.loads(network.value)
        for batch in batches:
            found = _scored(net, batch, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(found),
                    pa.array((found >= threshold).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    schema = T.StructType(
        [
            *slim.schema.fields[:2],
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    return slim.mapInArrow(run, schema)


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
    per_class: int = PER_CLASS,
) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns unchanged."""
    network = shared(docs.sparkSession, fit(docs, labels, id_col, text_col, per_class=per_class))
    at = docs.columns.index(text_col)

    def run(batches):
        net = pickle.loads(network.value)
        for batch in batches:
            yield batch.filter(pa.array(_scored(net, batch, at) < threshold))

    return docs.mapInArrow(run, docs.schema)
