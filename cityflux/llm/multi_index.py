"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector is quantised by its own codebook; a pair of centroids is a cell. A
query walks the cells in the order of the summed distances of their two centroids, by a
heap over the two sorted centroid lists, until the cells met hold a share of all vectors;
all vectors of these cells are then reranked by their exact distance.

Codebooks, and the share that reaches the wanted recall, come from a bounded sample; every
row is indexed. Equal vectors are one entry with the few ids that can matter, so a vector
that a third of all rows hold does not crowd a cell. Cells are dealt to buckets of bounded
size, large cells to several. Queries meet buckets in blocks of queries that start in
neighbouring buckets, and a bucket's entries go only to the blocks that ask for it.

Distances are taken from the sample's mean, and where they are found by products, vectors
within the rounding error of the cut stay until the exact distances decide.
"""

from __future__ import annotations

import heapq
import pickle
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .tables import partitions_for, shared, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: vectors that fit the codebooks, and queries among them that set the share to visit
SAMPLE, TRIALS = 16_384, 256
#: most centroids of a half, so that the cells' sizes (their square) fit the driver
CENTROIDS = 1_024
#: vectors of a bucket, queries of a block, queries of a task that walks the cells
BUCKET, BLOCK, WALK = 2_048, 2_048, 128
#: error of a squared distance found by products, as a share of the squared norms
ROUNDING = 64 * np.finfo(np.float64).eps


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, up to rounding."""
    out = (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)
    return np.maximum(out, 0)


def nearly_least(rough: np.ndarray, error: np.ndarray, k: int) -> np.ndarray:
    """Places whose value may be one of the ``k`` least, if each is off by ``error`` at most."""
    if len(rough) <= k:
        return np.arange(len(rough))
    last = np.partition(rough + error, k - 1)[k - 1]
    return np.flatnonzero(rough - error <= last)


def codebook(points: np.ndarray, size: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    centroids = points[rng.choice(len(points), min(size, len(points)), replace=False)]
    for _ in range(rounds):
        near = squared(points, centroids).argmin(axis=1)
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


class MultiIndex:
    """Two codebooks, and after ``deal`` the size and bucket of every cell."""

    def __init__(self, sample: np.ndarray, count: int, k: int, recall: float):
        self.half = sample.shape[1] // 2
        self.center = sample.mean(axis=0)
        sample = sample - self.center
        size = int(np.clip(round(np.sqrt(count) / 2), 1, CENTROIDS))
        self.books = codebook(sample[:, : self.half], size), codebook(sample[:, self.half :], size)
        self.share = self._share(sample, k, recall)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves, of vectors as they are given, to all centroids."""
        return self._distances(vectors - self.center)

    def _distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(vectors[:, : self.half], self.books[0]), squared(vectors[:, self.half :], self.books[1])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return self._cells(vectors - self.center)

    def _cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self._distances(vectors)
        return one.argmin(axis=1) * len(self.books[1]) + two.argmin(axis=1)

    def _share(self, sample: np.ndarray, k: int, recall: float) -> float:
        """Share of the sample met before ``recall`` of the true neighbours in it are.

        Neighbours in all rows are nearer than in a sample, so this errs to more work.
        """
        if len(sample) <= k + 1:
            return 1.0
        cell, met = self._cells(sample), []
        count = np.bincount(cell, minlength=len(self.books[0]) * len(self.books[1]))
        for i in range(min(TRIALS, len(sample))):
            d = ((sample - sample[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            one, two = self._distances(sample[i : i + 1])
            order = np.argsort((one[0][:, None] + two[0]).ravel(), kind="stable")
            share = np.empty(len(order))
            share[order] = np.cumsum(count[order]) / len(sample)
            met.append(share[cell[np.argpartition(d, k)[:k]]])
        return float(np.quantile(np.concatenate(met), recall))

    def deal(self, sizes: dict[int, int]) -> None:
        """Cells to buckets: ``first`` and ``parts`` by cell."""
        cells = len(self.books[0]) * len(self.books[1])
        self.sizes = np.zeros(cells, np.int64)
        self.first, self.parts = np.zeros(cells, np.int64), np.ones(cells, np.int64)
        bucket = held = 0
        for cell, n in sorted(sizes.items()):
            self.sizes[cell] = n
            parts = -(-n // BUCKET)
            if held and (parts > 1 or held + n > BUCKET):
                bucket, held = bucket + 1, 0
            self.first[cell], self.parts[cell] = bucket, parts
            bucket, held = (bucket + parts, 0) if parts > 1 else (bucket, held + n)
        self.buckets = bucket + 1

    def visited(self, one: np.ndarray, two: np.ndarray, enough: float) -> list[int]:
        """Cells in the order of ``one[i] + two[j]`` until they hold ``enough`` vectors."""
        a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        x, y = one[a].tolist(), two[b].tolist()
        a, b, wide = a.tolist(), b.tolist(), len(two)
        heap, out, met = [(x[0] + y[0], 0, 0)], [], 0
        sizes = self.sizes
        while heap and met < enough:
            _, i, j = heapq.heappop(heap)
            cell = a[i] * wide + b[j]
            if sizes[cell]:
                out.append(cell)
                met += sizes[cell]
            if j + 1 < len(y):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, width)


def _with_cells(index_bytes, width: int):
    def run(batches):
        index = pickle.loads(index_bytes.value)
        for batch in batches:
            cells = index.cells(_matrix(batch.column(0), width)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int64())], [*batch.schema.names, "cell"]
            )

    return run


def _probes(index_bytes, width: int, enough: float):
    """A row per query and bucket, with the query's cells in that bucket and its first bucket."""

    def run(batches):
        index = pickle.loads(index_bytes.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                one, two = index.distances(_matrix(part.column(1), width))
                row, bucket, cells, home = [], [], [], []
                for i in range(part.num_rows):
                    by_bucket: dict[int, list[int]] = {}
                    for cell in index.visited(one[i], two[i], enough):
                        first = int(index.first[cell])
                        for p in range(first, first + int(index.parts[cell])):
                            by_bucket.setdefault(p, []).append(cell)
                    row += [i] * len(by_bucket)
                    bucket += by_bucket.keys()
                    cells += by_bucket.values()
                    home += [next(iter(by_bucket))] * len(by_bucket)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at),
                        part.column(1).take(at),
                        pa.array(bucket, pa.int64()),
                        pa.array(cells, pa.list_(pa.int64())),
                        pa.array(home, pa.int64()),
                    ],
                    ["query_id", "vector", "bucket", "cells", "home"],
                )

    return run


def _plus(df: DataFrame, fields: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def _rerank(width: int, k: int, center: np.ndarray):
    """The best ``k`` entries of a bucket for each query of a block, by exact distance."""

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and entries.num_rows:
            queries, entries = queries.combine_chunks(), entries.combine_chunks()
            x = _matrix(entries.column("vector").chunk(0), width)
            cell = np.asarray(entries.column("cell"))
            ids = entries.column("ids").to_pylist()
            wanted, own = queries.column("cells").to_pylist(), queries.column("query_id").to_pylist()
            q = _matrix(queries.column("vector").chunk(0), width)
            x0, q0 = x - center, q - center
            norms, own_norm = (x0**2).sum(axis=1), (q0**2).sum(axis=1)
            for at in range(0, len(q), 256):
                rough = squared(q0[at : at + 256], x0)
                for i, d in enumerate(rough, at):
                    inside = np.flatnonzero(np.isin(cell, wanted[i]))
                    error = ROUNDING * width * (norms[inside] + own_norm[i])
                    inside = inside[nearly_least(d[inside], error, k + 1)]  # one may be the query itself
                    exact = np.sqrt(((x[inside] - q[i]) ** 2).sum(axis=1))
                    found = [(s, v) for s, e in zip(exact.tolist(), inside) for v in ids[e] if v != own[i]]
                    for s, v in heapq.nsmallest(k, found):
                        out[0].append(own[i])
                        out[1].append(v)
                        out[2].append(s)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array(x, kind) for x, kind in zip(out, kinds)]
        return pa.table(columns, ["query_id", "vec_id", "score"])

    return run


def _in_blocks(probes: DataFrame, queries: int, buckets: int) -> DataFrame:
    """``probes`` with ``block``: queries that start in neighbouring buckets, ``BLOCK`` at most.

    Stretches of buckets are long enough for a block of queries each; a stretch in which many
    more start is split by query.
    """
    blocks = min(buckets, partitions_for(queries, BLOCK))
    stretch = F.floor(F.col("home") * blocks / buckets)
    homes = probes.where(F.col("bucket") == F.col("home")).groupBy(stretch.alias("stretch")).count()
    parts = homes.select("stretch", F.ceil(F.col("count") / BLOCK).alias("parts"))
    joined = probes.withColumn("stretch", stretch).join(parts, "stretch")
    part = F.pmod(F.xxhash64("query_id"), F.col("parts"))
    return joined.withColumn("block", F.struct("stretch", part.alias("part"))).drop("stretch", "parts", "home")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector: one row per id, only vectors that take part.

    Null, zero and empty vectors, null or non-finite components, null ids, and lengths
    other than the most common one take no part; of rows that repeat an id the one with
    the least vector counts.
    """
    v = F.col("vector")
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & good & F.exists(v, lambda x: x != 0))
    rows = stored(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows.where(F.size("vector") == (width.width if width else 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    recall: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest found.

    ``queries`` (query_id) are ids of ``vectors``; a query never finds itself. ``score`` is
    the Euclidean distance in double precision; ties go to the smaller id. With fewer than
    ``k`` other vectors all are found. Empty inputs give empty results.
    """
    rows = usable(vectors, id_col, vector_col)
    spark, total = vectors.sparkSession, rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    # of equal vectors, the k + 1 smallest ids can matter; cut before the shuffle
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    entries = stored(
        few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries"
    )
    distinct = entries.count()
    unit = (F.xxhash64("vector") / F.lit(float(1 << 63)) + 1) / 2
    sample = entries.where(unit <= SAMPLE / distinct).select("vector").limit(SAMPLE).collect()
    if not sample:
        sample = entries.select("vector").limit(1).collect()
    points = np.array(sorted(r.vector for r in sample), np.float64)
    index = MultiIndex(points, distinct, k, recall)
    width = points.shape[1]
    celled = stored(
        entries.mapInArrow(_with_cells(shared(spark, index), width), _plus(entries, "cell long")),
        "cells",
    )
    # at most CENTROIDS ** 2 rows
    index.deal({r.cell: r["count"] for r in celled.groupBy("cell").count().collect()})
    buckets = spark.createDataFrame(
        [(c, int(index.first[c]), int(index.parts[c])) for c in np.flatnonzero(index.sizes).tolist()],
        "cell long, first long, parts long",
    )
    index_bytes = shared(spark, index)
    wanted = queries.select(F.col("query_id").cast("long").alias("vec_id")).distinct()
    asked = stored(rows.join(wanted, "vec_id").select(F.col("vec_id").alias("query_id"), "vector"), "queries")
    many = asked.count()
    enough = max(index.share * distinct, 16.0 * (k + 1))
    dealt = asked.repartition(partitions_for(many, WALK), "query_id")
    walked = dealt.mapInArrow(
        _probes(index_bytes, width, enough), _plus(asked, "bucket long, cells array<long>, home long")
    )
    probes = _in_blocks(stored(walked, "probes"), many, index.buckets)
    placed = celled.join(F.broadcast(buckets), "cell").withColumn(
        "bucket", F.col("first") + F.pmod(F.xxhash64("vector"), F.col("parts"))
    )
    # entries go where a query asks for their bucket, and nowhere else
    met = probes.select(F.col("bucket"), F.col("block").alias("to")).distinct()
    sent = placed.join(met, "bucket").select(F.col("bucket").alias("of"), "to", "cell", "vector", "ids")
    found = (
        probes.groupBy("bucket", "block")
        .cogroup(sent.groupBy("of", "to"))
        .applyInArrow(_rerank(width, k, index.center), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
