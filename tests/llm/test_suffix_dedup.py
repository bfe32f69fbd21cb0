import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cityflux.llm import suffix_dedup
from cityflux.llm.queries import QUERIES

W = suffix_dedup.WINDOW


def plain(texts, W=W):
    """(bytes, removed, spans, digest of the rest) of each text, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + W] for b in data for i in range(len(b) - W + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - W + 1):
            if seen[b[i : i + W]] > 1:
                gone[i : i + W] = True
        rest = bytes(x for x, g in zip(b, gone) if not g)
        starts = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(rest).hexdigest()))
    return out


def rows_of(df):
    out = []
    for r in df.collect():
        digest = hashlib.sha256(bytes(r.kept)).hexdigest()
        out.append((r.doc_id, (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), digest)))
    return sorted(out, key=str)


def check(docs, ids, texts, window=W):
    got = rows_of(suffix_dedup.remove_repeats(docs, window=window))
    assert got == sorted(zip(ids, plain(texts, window)), key=str)


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").toPandas()
    rows = QUERIES["op3_suffix_dedup"](spark, path).collect()
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows)
    assert got == sorted(zip(docs.doc_id.tolist(), plain(docs.text)))


def corpus(seed):
    """Random texts that share passages of many lengths, copies, periods and rims."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices("abcdeé \n", k=n))
    passages = [noise(n) for n in (200, 380, 399, 400, 401, 450, 700, 1500)]
    texts = [None, "", "x", noise(399), "ab" * 900, "q" * 1000, "q" * 401]
    for _ in range(60):
        parts = [noise(rng.randint(0, 500))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, 0, rng.randrange(len(p))])
            parts += [p[a:], noise(rng.randint(0, 300))]
        texts.append("".join(parts))
    return texts + [texts[9], texts[9], texts[12] + "tail"]


@pytest.mark.parametrize("setting", ["ordinary", "small buffers", "crowded"])
def test_random_corpora_equal_brute_force(spark, monkeypatch, setting):
    if setting == "small buffers":
        monkeypatch.setattr(suffix_dedup, "BUFFER", 1300)
        monkeypatch.setattr(suffix_dedup, "ARRIVING", 3)
        monkeypatch.setattr(suffix_dedup, "REPRESENTATIVES", 20)
    if setting == "crowded":
        monkeypatch.setattr(suffix_dedup, "CROWDED", 1)
    texts = corpus(11)
    ids = [None if i == 20 else i // 2 * 2 for i in range(len(texts))]  # ids repeat
    docs = spark.createDataFrame(
        [(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, spans int, n_chars long"
    )
    check(docs.repartition(5), ids, texts)


@pytest.mark.parametrize("window, crowded", [(64, 256), (150, 1), (200, 256), (201, 256)])
def test_other_lengths_equal_brute_force(spark, monkeypatch, window, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    texts = corpus(12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs.repartition(3), range(len(texts)), texts, window)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, window=63)


def test_query_shows_what_is_left(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in QUERIES["op3_suffix_dedup"](spark, path).collect():
        if r.n_removed == 0:
            assert r.text == texts[r.doc_id]
        else:
            assert len(r.text.replace("\ufffd", "").encode()) <= r.n_bytes - r.n_removed


def test_repeated_rows_and_documents_columns(spark):
    long = "".join(chr(97 + (i * i) % 26) for i in range(3000))
    rows = [(1, "kept é", 5), (2, long, 9), (2, long, 9), (3, None, None), (4, "é" * 50 + long[:600], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    check(docs, [r[0] for r in rows], [r[1] for r in rows])
    out = suffix_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    assert got == sorted([(1, "kept é", 6), (2, "", 0), (2, "", 0), (3, None, None), (4, "é" * 50, 50)], key=str)
    assert suffix_dedup.drop_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    family, keys = suffix_dedup.IndexFamily(), []
    for _ in range(64):
        new = rng.integers(0, 4000, 50).astype(np.uint64)
        keys.append(new)
        family.arrive(new)
        sizes = [len(level.keys) for level in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    keys = np.concatenate(keys)
    count = Counter(keys.tolist())
    assert family.repeated.tolist() == [count[k] > 1 for k in keys.tolist()]
