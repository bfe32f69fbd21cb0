import random
import re

import numpy as np
import pytest
import xxhash

from cityflux.llm import simhash
from cityflux.llm.queries import QUERIES


def plain_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_classes(ids, prints, radius=4):
    """Least id reachable over close pairs, by comparing all."""
    fp = np.array(prints, np.uint64)
    label = list(range(len(ids)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= radius):
            a, b = top(i), top(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        k = top(i)
        if x is not None:
            least[k] = min(least.get(k, x), x)
    return [least.get(top(i)) for i in range(len(ids))]


def check(df, ids, texts):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)
    prints = [plain_fingerprint(t) for t in texts]
    classes = plain_classes(ids, prints)
    want = sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, classes)), key=str)
    assert got == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet").toPandas()
    check(QUERIES["op10_simhash"](spark, path), docs.doc_id.tolist(), docs.text.tolist())


def test_defined_cases(spark):
    long = "".join(f"Wort{i % 977} " for i in range(60_000))
    rows = [
        (1, "A b\x0bC", "x"), (2, None, "x"), (3, "", None), (None, " \t\n", "y"), (5, "a B\tc", "x"),
        (5, "a B\tc", "x"), (7, long, "x"), (8, long + "End", "x"), (9, "a b", "x"), (None, "zz q", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    check(simhash.near_duplicates(docs), [r[0] for r in rows], [r[1] for r in rows])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == sorted(
        [(1, "A b\x0bC"), (2, None), (7, long), (9, "a b")]
    )
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_hot_blocks_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 300:  # a crowd around one value, and strangers
        x = rng.choice(list(values)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 7)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    edges = simhash.links(df, 4).collect()
    assert len(edges) <= 300 * 5 * 20
    roots = {r.node: r.root for r in simhash.stars(simhash.links(df, 4)).collect()}
    found = [roots.get(simhash._signed(v), simhash._signed(v)) for v in values]
    want = plain_classes(list(range(len(values))), values)
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_forest_connects_what_all_pairs_connect(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 2**63, 40).astype(np.uint64).repeat(5)
    for _ in range(4):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    n = len(fp)
    label = simhash.bit_sliced_forest(fp, np.arange(n) + 1, np.full(n, n), radius)
    assert label.tolist() == plain_classes(list(range(n)), fp.tolist(), radius)


@pytest.mark.parametrize("count", [10, 10**6, 10**9])
def test_close_values_share_a_block(count):
    masks = simhash.band_masks(count, 4)
    rng = random.Random(1)
    for _ in range(200):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any((x ^ y) & m == 0 for m in masks)
