"""Language identification by character language models.

Every language gets an interpolated Kneser-Ney model of character ``ORDER``-grams. Counts
come from all training texts: tasks count packed n-grams, Spark adds them up, and the
lower orders follow from the distinct n-grams (continuation counts). The model of all
languages together is a set of sorted hash arrays: hashes of the n-grams in order, found
through an index on their leading bits, beside one row of probabilities per n-gram with a
column per language. A text gets the language of the lowest cross-entropy per character.

No n-gram is left out. A model of more than ``MAX_GRAMS`` rows does not reach the driver: its
orders are Spark tables, and each block of texts is scored with the probabilities of its own
distinct n-grams, found by joins. How sharp scores are and what is rejected follows from all
training texts.
"""

from __future__ import annotations

import pickle
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.ranks import exact_quantiles
from .tables import mix, shared, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: characters per n-gram; a symbol takes 16 bits, so four fill a key
ORDER = 4
#: what characters beyond the basic plane count as
ASTRAL = 0xFFFF
#: positions judged at once
BLOCK = 1 << 19
#: (language, n-gram) rows up to which the model is one broadcast; beyond, it is joined
MAX_GRAMS = 1_000_000
#: characters that joined scoring judges with one set of n-grams, about
TEXT_BLOCK = 1 << 23
#: what the sharpness of scores is chosen from
SHARPNESS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
#: share of a language's own texts that calibration may reject
REJECTED = 0.001
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts with pads between them, the places to predict, the text of each.

    A text's characters and the pad after it are predicted; pads before it are context.
    """
    pad = "\0" * (ORDER - 1)
    joined = pad + "".join(t + pad for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.minimum(codes, ASTRAL).astype(np.uint64)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start = ORDER - 1 + np.concatenate([[0], np.cumsum(size + ORDER - 2)[:-1]])
    owner = np.repeat(np.arange(len(texts)), size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return codes, np.repeat(start, size) + inner, owner


def grams_at(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    packed = codes[places]
    for k in range(1, ORDER):
        packed |= codes[places - k] << np.uint64(16 * k)
    return packed


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.array([], int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _portions(texts: list[str]):
    """Index ranges of about ``BLOCK`` characters each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= BLOCK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _count(batches):
    held: dict[str, list] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            rows = np.flatnonzero(langs == lang)
            for k in range(0, len(rows), 256):
                texts = [t.lower() for t in batch.column(1).take(pa.array(rows[k : k + 256])).to_pylist()]
                for a, b in _portions(texts):
                    codes, places, _ = symbols(texts[a:b])
                    for c in range(0, len(places), BLOCK):
                        parts = held.setdefault(lang, [])
                        found = np.unique(grams_at(codes, places[c : c + BLOCK]), return_counts=True)
                        parts.append(found)
                        if len(parts) > 32:
                            held[lang] = [_merged(*map(np.concatenate, zip(*parts)))]
    for lang, parts in held.items():
        keys, counts = _merged(*map(np.concatenate, zip(*parts)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)],
            ["lang", "gram", "n"],
        )


def gram_counts(training: DataFrame) -> DataFrame:
    """lang, gram, n over every row of ``training`` (lang, text)."""
    local = training.mapInArrow(_count, "lang string, gram long, n long")
    return local.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class SortedHashes:
    """Sorted 64-bit hashes of keys; the hash is one to one, so equal hashes are equal keys."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys)
        self.order = np.argsort(hashes)  # place of the i-th hash among the keys
        self.hashes = hashes[self.order]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        heads = np.arange((1 << bits) + 1, dtype=np.uint64)
        self.begin = np.searchsorted(self.hashes >> self.shift, heads).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in hash order, -1 if it is not there."""
        h = mix(keys)
        head = (h >> self.shift).astype(np.int64)
        at, end = self.begin[head], self.begin[head + 1]
        found = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.hashes[at[open_]] == h[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return found


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def _cross_entropies(texts: list[str], langs: int, probabilities) -> np.ndarray:
    texts = [t.lower() for t in texts]
    out = np.zeros((len(texts), langs))
    for a, b in _portions(texts):
        codes, places, owner = symbols(texts[a:b])
        for c in range(0, len(places), BLOCK):
            bits = -np.log2(probabilities(grams_at(codes, places[c : c + BLOCK])))
            for j in range(langs):
                out[a:b, j] += np.bincount(owner[c : c + BLOCK], bits[:, j], b - a)
    return out / np.array([len(t) + 1 for t in texts])[:, None]


class Model:
    """Interpolated Kneser-Ney models of several languages in shared tables."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.grams: list[SortedHashes] = []
        self.prob: list[np.ndarray] = []
        self.contexts: list[SortedHashes] = []
        self.weight: list[np.ndarray] = []
        by_order = {lang: self._orders(*counts[lang]) for lang in self.langs}
        for order in range(1, ORDER + 1):
            self._add_order(order, {lang: by_order[lang][order] for lang in self.langs})

    @staticmethod
    def _orders(keys, n):
        """Counts by order: as they are at the top, continuation counts below."""
        found = {ORDER: (keys, n)}
        for order in range(ORDER - 1, 0, -1):
            found[order] = np.unique(found[order + 1][0] & _mask(order), return_counts=True)
        return found

    def _add_order(self, order: int, counts: dict) -> None:
        keys = np.unique(np.concatenate([counts[lang][0] for lang in self.langs]))
        grams, contexts = SortedHashes(keys), SortedHashes(np.unique(keys >> np.uint64(16)))
        keys = keys[grams.order]
        own = contexts.find(keys >> np.uint64(16))
        weight = np.ones((len(contexts.hashes), len(self.langs)), np.float32)
        prob = np.empty((len(keys), len(self.langs)), np.float32)
        lower = self.probabilities(keys & _mask(order - 1), order - 1)
        for j, lang in enumerate(self.langs):
            have, n = counts[lang]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            place = contexts.find(have >> np.uint64(16))
            total = np.bincount(place, n, len(weight))
            kinds = np.bincount(place, minlength=len(weight))
            seen = total > 0
            weight[seen, j] = discount * kinds[seen] / total[seen]
            prob[:, j] = weight[own, j] * lower[:, j]
            at = grams.find(have)
            prob[at, j] += np.maximum(n - discount, 0) / total[place]
        self.grams.append(grams)
        self.prob.append(prob)
        self.contexts.append(contexts)
        self.weight.append(weight)

    def probabilities(self, keys: np.ndarray, order: int) -> np.ndarray:
        """P(last symbol | the others) of packed keys, a column per language."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), 1 / 65536, np.float32)
        at = self.grams[order - 1].find(keys)
        out = self.prob[order - 1][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            place = self.contexts[order - 1].find(keys[miss] >> np.uint64(16))
            weight = np.where(place[:, None] < 0, np.float32(1), self.weight[order - 1][place])
            out[miss] = weight * self.probabilities(keys[miss] & _mask(order - 1), order - 1)
        return out

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per predicted symbol of every text, a column per language."""
        return _cross_entropies(texts, len(self.langs), lambda keys: self.probabilities(keys, ORDER))


class Calibration:
    """How sharp scores are, and beyond which cross-entropy a prediction is rejected."""

    def __init__(self, sharpness: float = 20.0, limit: np.ndarray | float = np.inf):
        self.sharpness, self.limit = sharpness, limit

    def scores(self, entropies):
        x = -self.sharpness * (entropies - entropies.min(axis=1, keepdims=True))
        e = np.exp(x)
        return e / e.sum(axis=1, keepdims=True)


def _text_key(lang, text):
    """Names the text of a training row; null for other rows."""
    return F.when(lang.isNotNull() & text.isNotNull(), F.unhex(F.sha2(text, 256)))


def _loss(sharpness: float):
    """Minus the logarithm of the score of the row's own language, as an exact number."""
    soft = lambda x: F.exp(F.lit(-sharpness) * (x - F.col("least")))
    total = F.aggregate(F.transform("entropies", soft), F.lit(0.0), lambda a, x: a + x)
    return (-F.log(F.greatest(soft(F.col("own")) / total, F.lit(1e-12)))).cast("decimal(20,12)")


def calibrated(scored: DataFrame, langs: list[str]) -> Calibration:
    """From every different training text: the rows of ``scored`` (h, lang, entropies) with ``h``.

    Sums and quantiles are exact and are found by Spark; a number per language reaches the driver.
    """
    once = scored.where(F.col("h").isNotNull() & F.col("entropies").isNotNull()).groupBy("h")
    once = once.agg(F.min("lang").alias("lang"), F.first("entropies").alias("entropies"))
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int")
    told = once.withColumns({"own": F.element_at("entropies", place), "least": F.array_min("entropies")})
    losses = [_loss(s).alias(f"loss_{k}") for k, s in enumerate(SHARPNESS)]
    rows = stored(told.select("lang", "own", *losses), "own-entropies")
    sums = rows.agg(*[F.sum(f"loss_{k}") for k in range(len(SHARPNESS))]).first()
    if sums[0] is None:
        return Calibration()
    limit = np.full(len(langs), np.inf)
    for r in exact_quantiles(rows, "own", {"limit": 1 - REJECTED}, ["lang"]).collect():
        limit[langs.index(r.lang)] = r.limit * 1.25
    return Calibration(SHARPNESS[sums.index(min(sums))], limit)


def _learned(counted: DataFrame) -> Model | None:
    top = counted.toPandas()
    if top.empty:
        return None
    counts = {}
    for lang, part in top.groupby("lang"):
        keys = part["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        counts[lang] = keys[order], part["n"].to_numpy(np.int64)[order]
    return Model(counts)


def train(training: DataFrame):
    """Model and calibration from ``training`` (lang, text); None if it has no rows.

    Every n-gram reaches the driver; every text calibrates.
    """
    model = _learned(stored(gram_counts(training), "grams"))
    if model is None:
        return None
    rows = training.select(_text_key(F.col("lang"), F.col("text")).alias("h"), "lang", "text")
    return model, calibrated(_scored(rows, model), model.langs)


def _known(texts: list) -> np.ndarray:
    return np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)


def _judged(known: np.ndarray, entropies: np.ndarray, langs: list[str], calibration) -> list[pa.Array]:
    """lang_pred, score, cross_entropy, rejected; ``entropies`` has a row per known text."""
    pred = np.full(len(known), UNKNOWN, object)
    score, least = np.zeros(len(known)), np.full(len(known), np.nan)
    rejected = np.ones(len(known), bool)
    at = np.flatnonzero(known)
    if len(at) and langs:
        best = entropies.argmin(axis=1)
        least[at] = entropies[np.arange(len(at)), best]
        pred[at] = np.array(langs, object)[best]
        score[at] = calibration.scores(entropies).max(axis=1)
        rejected[at] = least[at] > calibration.limit[best]
    return [
        pa.array(pred.tolist(), pa.string()),
        pa.array(score),
        pa.array(least, from_pandas=True),
        pa.array(rejected),
    ]


_JUDGED = ["lang_pred", "score", "cross_entropy", "rejected"]


def _entropies(model_bytes):
    """``entropies``, null for texts that are not known, in place of ``text``, the last column."""

    def run(batches):
        model = pickle.loads(model_bytes.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = part.column(part.num_columns - 1).to_pylist()
                lists = [None] * len(raw)
                known = np.flatnonzero(_known(raw))
                if model and len(known):
                    found = model.cross_entropies([raw[i] for i in known])
                    for i, own in zip(known.tolist(), found.tolist()):
                        lists[i] = own
                rest = [part.column(i) for i in range(part.num_columns - 1)]
                column = pa.array(lists, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*rest, column], [*batch.schema.names[:-1], "entropies"])

    return run


def _scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` with ``entropies`` by a broadcast model in place of ``text``."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    kind = T.StructType([*kept, T.StructField("entropies", T.ArrayType(T.DoubleType()))])
    slim = rows.select(*[f.name for f in kept], "text")
    return stored(slim.mapInArrow(_entropies(shared(rows.sparkSession, model)), kind), "entropies")


def _wanted(batches):
    """block, gram: the distinct n-grams of each block of texts; a task has a block's rows in turn."""
    now, parts = None, []

    def found():
        keys = np.unique(np.concatenate(parts))
        blocks = pa.array(np.full(len(keys), now, np.int64))
        return pa.RecordBatch.from_arrays([blocks, pa.array(keys.view(np.int64))], ["block", "gram"])

    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, batch.num_rows, 256):
            some, own = batch.column(1).slice(k, 256).to_pylist(), blocks[k : k + 256]
            known = _known(some)
            for block in dict.fromkeys(own[known].tolist()):
                if block != now and parts:
                    yield found()
                    parts = []
                now = block
                texts = [some[i].lower() for i in np.flatnonzero(known & (own == block))]
                for a, b in _portions(texts):
                    codes, places, _ = symbols(texts[a:b])
                    for c in range(0, len(places), BLOCK):
                        parts.append(np.unique(grams_at(codes, places[c : c + BLOCK])))
                        if len(parts) > 32:
                            parts = [np.unique(np.concatenate(parts))]
    if parts:
        yield found()


def _by_lang(langs: list[str], value):
    """An array with a sum of ``value`` for every language."""
    own = [F.sum(F.when(F.col("lang") == lang, value)) for lang in langs]
    return F.array(*[F.coalesce(x, F.lit(0)).cast("double") for x in own])


def joined_probabilities(counted: DataFrame, asked: DataFrame, langs: list[str]) -> DataFrame:
    """gram, p: what ``Model.probabilities`` gives for the distinct n-grams of ``asked``.

    No join key has more rows than there are symbols.
    """
    counts = {ORDER: counted}
    for order in range(ORDER - 1, 0, -1):
        lower = F.col("gram").bitwiseAND(F.lit(int(_mask(order))))
        shorter = counts[order + 1].groupBy("lang", lower.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        counts[order] = stored(shorter, "grams")
    found = None
    for order in range(1, ORDER + 1):
        have = counts[order]
        once = {r.lang: (r.n1, r.n2) for r in have.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
        discounts = [n1 / (n1 + 2 * n2) if n1 and n2 else 0.5 for n1, n2 in map(once.get, langs)]
        context = F.shiftrightunsigned("gram", 16)
        keys = asked
        if order < ORDER:
            keys = asked.select(F.col("gram").bitwiseAND(F.lit(int(_mask(order)))).alias("gram")).distinct()
        keys = keys.withColumn("context", context)
        seen = have.groupBy("gram").agg(_by_lang(langs, F.col("n")).alias("n"))
        contexts = have.groupBy("lang", context.alias("context")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")
        )
        contexts = contexts.groupBy("context").agg(
            _by_lang(langs, F.col("total")).alias("total"), _by_lang(langs, F.col("kinds")).alias("kinds")
        )
        rows = keys.join(seen, "gram", "left").join(contexts, "context", "left")
        if order == 1:
            rows = rows.withColumn("lower", F.array(*[F.lit(1 / 65536)] * len(langs)))
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit(int(_mask(order - 1)))))
            rows = rows.join(found.select(F.col("gram").alias("short"), F.col("p").alias("lower")), "short")
        discount = F.array(*[F.lit(float(d)) for d in discounts])

        def interpolated(p, j):
            total, kinds, n, d = (F.get(x, j) for x in (F.col("total"), F.col("kinds"), F.col("n"), discount))
            own = F.greatest(F.coalesce(n, F.lit(0.0)) - d, F.lit(0.0))
            return F.when(total > 0, (own + d * kinds * p) / total).otherwise(p)

        found = stored(rows.select("gram", F.transform("lower", interpolated).alias("p")), "probabilities")
    return found


def _score_block(langs: int):
    def run(texts: pa.Table, grams: pa.Table) -> pa.Table:
        raw = texts.column("text").to_pylist()
        known = _known(raw)
        entropies = np.full((len(raw), langs), np.nan)
        if known.any():
            keys = grams.column("gram").to_numpy().view(np.uint64)
            order = np.argsort(keys)
            keys = keys[order]
            p = grams.column("p").combine_chunks().flatten().to_numpy().reshape(-1, langs)[order]
            at = np.flatnonzero(known)
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                found = _cross_entropies([raw[i] for i in some], langs, lambda x: p[np.searchsorted(keys, x)])
                entropies[some] = found
        lists = pa.array([x.tolist() if k else None for x, k in zip(entropies, known)], pa.list_(pa.float64()))
        kept = texts.drop_columns(["block", "text"])
        return kept.append_column("entropies", lists)

    return run


def _judge_entropies(model_bytes):
    def run(batches):
        langs, calibration = pickle.loads(model_bytes.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            entropies = lists.drop_null().flatten().to_numpy().reshape(-1, max(1, len(langs)))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns = _judged(known, entropies, langs, calibration)
            yield pa.RecordBatch.from_arrays([*rest, *columns], [*batch.schema.names[:-1], *_JUDGED])

    return run


def _scored_joined(slim: DataFrame, counted: DataFrame, langs: list[str]) -> DataFrame:
    """As ``_scored``, with the model in tables."""
    rows = stored(slim.withColumn("block", F.monotonically_increasing_id()), "texts")
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    together = max(1, TEXT_BLOCK * size.rows // max(1, size.chars or 0))
    rows = rows.withColumn("block", F.shiftright("block", min(32, together.bit_length() - 1)))
    wanted = stored(rows.select("block", "text").mapInArrow(_wanted, "block long, gram long"), "wanted")
    wanted = wanted.distinct()
    p = joined_probabilities(counted, stored(wanted.select("gram").distinct(), "asked"), langs)
    grams = wanted.join(p.select("gram", F.col("p").cast("array<float>").alias("p")), "gram")
    kept = [f for f in rows.schema.fields if f.name not in ("block", "text")]
    kind = T.StructType([*kept, T.StructField("entropies", T.ArrayType(T.DoubleType()))])
    scored = rows.groupBy("block").cogroup(grams.groupBy("block")).applyInArrow(_score_block(len(langs)), kind)
    return stored(scored, "entropies")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    held_fold: int = 2,
    max_grams: int = MAX_GRAMS,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected: one row per input row.

    Rows whose ``crc32(id as text) % folds`` is ``held_fold`` are held out; the others with
    a language and a text are learned from, rows without an id are not. Texts that are null
    or have no letter are ``und`` with score 0, and so is everything if nothing was
    learned. ``rejected`` marks texts unlike all learned languages; their ``lang_pred`` is
    still the nearest one. Equal cross-entropies go to the language first by name. All n-grams
    count; ``max_grams`` decides only whether the model is broadcast or joined.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    text = F.col(text_col).cast("string")
    training = docs.where((fold != held_fold) & F.col(lang_col).isNotNull() & text.isNotNull())
    training = training.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"),
        text.alias("text"),
        F.when(fold != held_fold, F.col(lang_col).cast("string")).alias("lang"),
    )
    schema = T.StructType(
        [
            *slim.schema.fields[:2],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("cross_entropy", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    slim = slim.withColumn("h", _text_key(F.col("lang"), F.col("text")))
    counted = stored(gram_counts(training), "grams")
    if counted.count() > max_grams:
        langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
        scored = _scored_joined(slim, counted, langs)
    else:
        model = _learned(counted)
        langs = model.langs if model else []
        scored = _scored(slim, model)
    calibration = calibrated(scored, langs) if langs else Calibration()
    judge = _judge_entropies(shared(docs.sparkSession, (langs, calibration)))
    return scored.select("doc_id", "held_out", "entropies").mapInArrow(judge, schema)
