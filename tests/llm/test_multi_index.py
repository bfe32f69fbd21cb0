import numpy as np
import pytest

from cityflux.llm import multi_index
from cityflux.llm.queries import QUERIES


def plain_nearest(rows, query_ids, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in query_ids:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), d[j]) for j in order]
    return out


def ranked(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_reaches_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in table]
    want = plain_nearest(rows, [i for i, _ in rows if i % 100 == 0])
    got = ranked(QUERIES["op1_multi_index"](spark, path).collect())
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        exact = dict(plain_nearest(rows, [q], len(rows))[q])
        assert [(v, exact[v]) for v, _ in found] == found
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and len(found) == 10
        hits += len({v for v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).round(1).tolist(), 0) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(60)]  # a crowd of equal vectors
    odd = [
        (300, None, 1), (400, [0.0] * 6, 1), (500, [nan] + [1.0] * 5, 1), (600, [inf] + [1.0] * 5, 1),
        (700, [None] + [1.0] * 5, 1), (800, [], 1), (900, [1.0, 2.0], 1), (None, [1.0] * 6, 1), (100, rows[100][1], 5),
    ]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cell int")
    asked = df.where("vec_id % 100 = 0").select(df.vec_id.alias("query_id"))
    got = ranked(multi_index.nearest(df, asked, recall=1.0).collect())
    exact = [(i, np.float32(v).astype(float).tolist()) for i, v, _ in rows]
    want = plain_nearest(exact, [0, 100, 200])
    assert got == want
    assert [v for v, _ in got[200]] == list(range(201, 211))
    few = df.where("vec_id < 4")
    got = ranked(multi_index.nearest(few, few.select(few.vec_id.alias("query_id"))).collect())
    assert got == plain_nearest(exact[:4], [0, 1, 2, 3])
    assert multi_index.nearest(df.limit(0), asked).count() == 0
    assert multi_index.nearest(df, asked.limit(0)).count() == 0


def test_cells_come_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    index = multi_index.MultiIndex(rng.standard_normal((400, 8)), 400, 3, 0.9)
    cells = len(index.books[0]) * len(index.books[1])
    index.deal({c: 1 for c in range(cells)})
    one, two = (d[0] for d in index.distances(rng.standard_normal((1, 8))))
    order = index.visited(one, two, cells)
    summed = (one[:, None] + two).ravel()
    assert sorted(order) == list(range(cells))
    assert (np.diff(summed[order]) >= 0).all()
    assert order[:7] == index.visited(one, two, 7)


def test_large_cells_take_several_buckets(monkeypatch):
    monkeypatch.setattr(multi_index, "BUCKET", 10)
    index = multi_index.MultiIndex(np.random.default_rng(2).standard_normal((100, 4)), 100, 3, 0.9)
    index.deal({0: 4, 1: 5, 2: 35, 3: 3, 4: 8})
    got = [(index.first[c], index.parts[c]) for c in range(5)]
    assert got == [(0, 1), (0, 1), (1, 4), (5, 1), (6, 1)]


@pytest.mark.parametrize("offset, spread", [(0.0, 1.0), (1e4, 1e-3), (1e5, 1e-3), (1e6, 1e-2)])
def test_vectors_far_from_the_origin(spark, offset, spread):
    rng = np.random.default_rng(3)
    rows = [(i, (offset + spread * rng.standard_normal(8)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").select(df.vec_id.alias("query_id"))
    got = ranked(multi_index.nearest(df, asked, recall=1.0).collect())
    assert got == plain_nearest(rows, range(0, 400, 20))


def test_clusters_far_apart_and_halves_of_very_different_norm(spark):
    rng = np.random.default_rng(4)
    middle = rng.choice([-1e6, 1e6], (300, 1)) * np.ones((1, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(middle + 1e-2 * rng.standard_normal((300, 8)))]
    scale = np.array([1e7] * 4 + [1e-3] * 4)
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 8)).round(0) * scale)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 25 = 0").select(df.vec_id.alias("query_id"))
    got = ranked(multi_index.nearest(df, asked, recall=1.0).collect())
    want = plain_nearest([r for r in rows if any(r[1])], got)
    assert got == want and len(got) >= 18


def test_entries_go_only_to_blocks_that_ask(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BUCKET", 50)
    monkeypatch.setattr(multi_index, "BLOCK", 7)
    rng = np.random.default_rng(5)
    spots = rng.standard_normal((12, 6)) * 100
    rows = [(i, (spots[i % 12] + rng.standard_normal(6)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 24 < 2").select(df.vec_id.alias("query_id"))
    got = ranked(multi_index.nearest(df, asked, recall=0.95).collect())
    want = plain_nearest(rows, got)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in got)
    assert len(got) == 100 and hits >= 0.95 * 1000
    schema = "query_id long, vector array<double>, bucket long, cells array<long>, home long"
    few = [(q, [0.0], b, [1], q % 5) for q in range(40) for b in (q % 5, 9)]
    blocks = multi_index._in_blocks(spark.createDataFrame(few, schema), 40, 10).collect()
    of = {}
    for r in blocks:
        of.setdefault(r.query_id, set()).add(tuple(r.block))
    assert len(blocks) == 80 and all(len(x) == 1 for x in of.values())
    sizes = [sum(b in x for x in of.values()) for b in set().union(*of.values())]
    assert max(sizes) <= 14  # a block of 7 on average
