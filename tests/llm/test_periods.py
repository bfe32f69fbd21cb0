import hashlib
import random
import zlib

import numpy as np
import pytest

from cityflux.llm import periods
from cityflux.llm.queries import QUERIES


def plain_runs(words, least=12):
    """All runs by comparing every word with the one q later, for every q."""
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        equal = np.concatenate([[False], x[q:] == x[:-q], [False]])
        begin, end = np.flatnonzero(equal[1:] & ~equal[:-1]), np.flatnonzero(~equal[1:] & equal[:-1])
        for i in np.flatnonzero(end - begin + q >= max(least, 2 * q)):
            found.setdefault((int(begin[i]), int(end[i] - begin[i] + q)), q)
    return sorted((s, k, q) for (s, k), q in found.items())


def plain_rest(words, runs):
    gone = set()
    for s, k, q in runs:
        gone.update(range(s + q, s + k))
    return [w for i, w in enumerate(words) if i not in gone]


def sequences(seed):
    rng = random.Random(seed)
    out = [[], [1], [1] * 11, [1] * 12, [1, 2] * 6, [1, 2, 3] * 40 + [1, 2], list(range(30)) * 2, [0] * 500]
    a, b = [0], [0, 1]  # a Fibonacci word has a run at almost every place
    while len(b) < 400:
        a, b = b, b + a
    out += [b, b[::-1]]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            piece = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randint(1, 40))]
            words += piece * rng.choice([1, 1, 2, 3, 7]) + piece[: rng.randrange(len(piece))]
        out.append(words)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_equal_brute_force(seed, monkeypatch):
    if seed == 3:
        monkeypatch.setattr(periods, "PAIRS", 50)
    texts = sequences(seed)
    got = periods.find_runs(np.concatenate([np.array(t, np.int64) for t in texts]), [len(t) for t in texts])
    want = [(d, *r) for d, t in enumerate(texts) for r in plain_runs(t)]
    assert [tuple(r) for r in got.T.tolist()] == want


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 2, 700), np.zeros(300, np.int64), np.arange(900) % 45):
        values = np.append(values, -1)
        extend = periods.Extensions(values, np.zeros(len(values), np.int64))
        i, j = rng.integers(0, len(values) - 1, (2, 3000))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i.tolist(), j.tolist()):
            k = 0
            while max(a, b) + k < len(values) and values[a + k] == values[b + k]:
                k += 1
            want.append(k)
        assert extend(i, j).tolist() == want


def test_cover_reaches_every_difference():
    differences = {(a - b) % periods.MODULUS for a in periods.COVER for b in periods.COVER}
    assert differences == set(range(periods.MODULUS))


def folded(doc_id, words):
    """The words that the registered query asks for."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = folded(d.doc_id, (d.text or "").encode().split())
        runs, r = plain_runs(words), got[d.doc_id]
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256(listed.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(plain_rest(words, runs))).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == four


def test_long_text_of_copies():
    rng = np.random.default_rng(5)
    part = rng.integers(0, 5000, 7000)
    words = np.concatenate([rng.integers(0, 5000, 300), np.tile(part, 5), rng.integers(0, 5000, 300)])
    _, start, length, period = periods.find_runs(words, [len(words)])
    assert 7000 in period.tolist()
    k = period.tolist().index(7000)
    assert length[k] >= 35000 and start[k] <= 300


def test_odd_tables(spark):
    kind = "id long, body string, runs int, n_words string, doc_id int"
    long = "x " * 3000
    rows = [
        (1, None, 1, "a", 9), (1, None, 1, "a", 9), (None, "", 1, "a", 9), (2, " \t\x0b", None, None, 9),
        (3, "a\x1cb " * 12, 1, "a", 9), (4, long, 1, "a", 9), (5, "  é\n" * 6, 1, "a", 9), (6, "w" * 200_000, 1, "", 1),
    ]
    docs = spark.createDataFrame(rows, kind)
    out = periods.periodic_runs(docs, "id", "body")
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert got == sorted([
        (1, 0, [], ""), (1, 0, [], ""), (None, 0, [], ""), (2, 0, [], ""), (3, 12, [(0, 12, 1)], "a\x1cb"),
        (4, 3000, [(0, 3000, 1)], "x"), (5, 12, [(0, 12, 2)], "  é"), (6, 1, [], "w" * 200_000),
    ], key=str)
    assert periods.periodic_runs(docs.limit(0), "id", "body").count() == 0
