import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cityflux.llm import language
from cityflux.llm.queries import QUERIES


def plain_model(texts):
    """Interpolated Kneser-Ney over 4-grams, by dictionaries; returns P(w | context)."""
    top = Counter()
    for t in texts:
        s = "\0\0\0" + t.lower() + "\0"
        top.update(s[i - 3 : i + 1] for i in range(3, len(s)))
    counts = {4: top}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    stats = {}
    for k, c in counts.items():
        n1, n2 = (sum(1 for v in c.values() if v == m) for m in (1, 2))
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        stats[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, total, kinds

    def p(g):
        if not g:
            return 1 / 65536
        d, total, kinds = stats[len(g)]
        t = total.get(g[:-1], 0)
        if not t:
            return p(g[1:])
        return max(counts[len(g)].get(g, 0) - d, 0) / t + d * kinds[g[:-1]] / t * p(g[1:])

    return p


def test_cross_entropies_equal_plain_kneser_ney(spark):
    texts = {"aa": ["Abra cadabra", "abc", "bab ba"], "bb": ["xyz zyx", "", "öäü abra"]}
    rows = [(lang, t) for lang, ts in texts.items() for t in ts]
    df = spark.createDataFrame(rows, "lang string, text string")
    model, _ = language.train(df)
    probes = ["abra", "zyx ö", "", "neuß \U0001f600", "b" * 40]
    got = model.cross_entropies(probes)
    for j, lang in enumerate(model.langs):
        p = plain_model(texts[lang])
        for i, t in enumerate(probes):
            s = "\0\0\0" + t.lower().replace("\U0001f600", "￿") + "\0"
            bits = [-np.log2(p(s[k - 3 : k + 1])) for k in range(3, len(s))]
            assert got[i, j] == pytest.approx(np.mean(bits), rel=1e-4)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("aa", "abab bca"), ("bb", "cc ab")], "lang string, text string")
    model, _ = language.train(df)
    context = int.from_bytes("ba\0"[::1].encode("utf-16-be"), "big")
    keys = np.array([(context << 16) | c for c in range(65536)], np.uint64)
    assert model.probabilities(keys, 4).sum(axis=0, dtype=float) == pytest.approx([1, 1], abs=1e-3)


def test_query_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op9_language"](spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in held)
    assert right >= 0.97 * len(held) and len(held) > 200
    assert sum(r.rejected for r in held) <= 0.05 * len(held)


def test_defined_cases(spark):
    rows = [
        (1, "le chat est la et il dort", "fr", 1.0), (2, "the cat is here and it sleeps", "en", 1.0),
        (3, None, "en", 1.0), (4, "", "en", 1.0), (5, "123 !!", None, 1.0), (6, "the the", None, 1.0),
        (6, "the the", None, 1.0), (None, "le le", "fr", 1.0), (8, "the cat sleeps " * 20_000, None, 1.0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert language.identify(docs).count() == len(rows)
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert got[6].lang_pred == got[8].lang_pred == "en"
    assert got[None].held_out is False and got[None].lang_pred == "fr"
    assert language.identify(docs.limit(0)).count() == 0
    alone = language.identify(docs.where("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}


def test_sorted_hashes_find_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    table = language.SortedHashes(keys)
    at = table.find(keys)
    assert (keys[table.order][at] == keys).all()
    assert (table.find(keys + np.uint64(1)) < 0).mean() > 0.99
    assert (language.SortedHashes(keys[:0]).find(keys) < 0).all()


def test_rare_language_keeps_its_grams_beyond_max_grams(spark):
    """A model too large for one broadcast is joined, with the same results and no n-gram less."""
    big = [(i, f"the cat sees {i % 7} dogs and the rat runs to house {i % 11}", "en") for i in range(300)]
    big += [(i, "le chat voit la maison et il dort", "fr") for i in range(300, 500)]
    rare = [(i, t, "xx") for i, t in enumerate(["qwzx jkvb pfgm", "zxcq vbnj hytr", "jkvb qwzx \U0001f600"], 1000)]
    rows = [*big, *rare, (2000, "qwzx vbnj", None), (2001, None, None), (2002, "12", "en"), (2003, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    whole = {r.doc_id: r for r in language.identify(docs, held_fold=9).collect()}
    got = language.identify(docs, held_fold=9, max_grams=20).collect()
    assert len(got) == len(rows)
    for r in got:
        want = whole[r.doc_id]
        assert (r.held_out, r.lang_pred, r.rejected) == (want.held_out, want.lang_pred, want.rejected)
        assert r.score == pytest.approx(want.score, rel=1e-3)
        assert (r.cross_entropy is None) == (want.cross_entropy is None)
        assert r.cross_entropy is None or r.cross_entropy == pytest.approx(want.cross_entropy, rel=1e-4)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002, 2000)} == {"xx"}


def test_every_training_text_calibrates(spark):
    """Thresholds hold for over a thousand texts, however long: plain numpy over all of them."""
    rng = np.random.default_rng(3)
    words = {"en": ["the", "cat", "sees", "dogs", "house"], "fr": ["le", "chat", "voit", "maison", "dort"]}
    texts = [(lang, " ".join(rng.choice(words[lang], rng.integers(1, 9)))) for lang in ("en", "fr") for _ in range(1500)]
    texts += [("fr", "dort voit " * 2_500), ("fr", "the cat sees the dogs"), ("en", "12"), ("en", "")]
    model, calibration = language.train(spark.createDataFrame(texts, "lang string, text string"))
    least = {}
    for lang, text in texts:
        if language._LETTER.search(text):
            least[text] = min(lang, least.get(text, lang))
    assert len(least) > 1_000
    entropies = model.cross_entropies(list(least))
    own = np.array([model.langs.index(x) for x in least.values()])
    for j in range(2):
        want = np.quantile(entropies[own == j, j], 1 - language.REJECTED) * 1.25
        assert calibration.limit[j] == pytest.approx(want, rel=1e-9)
    loss = []
    for s in language.SHARPNESS:
        e = np.exp(-s * (entropies - entropies.min(axis=1, keepdims=True)))
        p = (e / e.sum(axis=1, keepdims=True))[np.arange(len(own)), own]
        loss.append(-np.log(np.maximum(p, 1e-12)).sum())
    assert calibration.sharpness == language.SHARPNESS[int(np.argmin(loss))]
