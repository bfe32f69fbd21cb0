import hashlib
import re

from cityflux.llm import exact_dedup


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, least, len(ids), digest) for i in ids]
    return out, len(groups)


def check(df, rows):
    want, groups = plain(rows)
    got = df.collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(
        want, key=key
    )
    kept = [r for r in got if r.kept]
    assert len(kept) == groups
    assert all(r.doc_id == r.keep_id for r in kept)


def test_defined_cases(spark):
    rows = [
        (3, "a  b"), (1, "a b"), (2, "a\t\nb"), (2, "a b"), (None, "a b"), (5, None), (4, ""), (None, "only"),
        (None, "only"), (6, " a b"), (7, "a b"), (8, "x" * 300_000), (9, "x" * 300_000),
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    check(exact_dedup.exact_duplicates(docs), rows)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert found == sorted(
        [(1, "a b"), (4, ""), (None, "only"), (6, " a b"), (7, "a b"), (8, "x" * 300_000)], key=str
    )
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_frequent_digests_are_found_and_skip_the_shuffle(spark):
    n = 20_000
    texts = [("hot" if i % 3 == 0 else "warm" if i % 50 == 1 else f"t{i}") for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = docs.select(
        "doc_id", exact_dedup.digest("text").alias("text_sha256"), docs["doc_id"].alias("row")
    )
    found = exact_dedup.frequent_digests(rows, 1e-2, 512).collect()
    assert sorted(r.group_size for r in found) == sorted(texts.count(t) for t in ("hot", "warm"))
    df = exact_dedup.exact_duplicates(docs, support=1e-2, counters=512)
    check(df, list(enumerate(texts)))
