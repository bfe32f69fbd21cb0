import hashlib
import random
import re
from collections import Counter

import pytest

from cityflux.llm import line_dedup
from cityflux.llm.queries import QUERIES


def plain_diff(a, b):
    """Patience diff, recursive: lines of ``b`` that are aligned."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [0] + [i + 1 for i in plain_diff(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_diff(a[:-1], b[:-1]) + [len(b) - 1]
    ca, cb = Counter(a), Counter(b)
    unique = [x for x in b if ca[x] == cb[x] == 1]
    best = [[]]  # best[k]: the chain of k lines that the sorting of piles ends with
    chains = []
    for x in unique:
        p = a.index(x)
        k = sum(1 for c in best[1:] if a.index(c[-1]) < p)
        chain = best[k] + [x]
        best[k + 1 : k + 2] = [chain]
        chains.append(chain)
    chain, out, pa, pb = best[-1], [], 0, 0
    if not chain:
        return []
    for x in [*chain, None]:
        qa, qb = (a.index(x), b.index(x)) if x is not None else (len(a), len(b))
        out += [pb + i for i in plain_diff(a[pa:qa], b[pb:qb])]
        out += [qb] if x is not None else []
        pa, pb = qa + 1, qb + 1
    return out


def plain(rows, rare_share=0.4, diff=plain_diff):
    """(lines, removed, digest of the rest) of each row by comparing it with every earlier
    document that shares a rare line."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    texts = [(t or "").split("\n") for _, t in rows]
    first = {}
    for i in order:
        first.setdefault("\n".join(texts[i]), i)
    entries = [i for i in order if first["\n".join(texts[i])] == i]
    holders = {}
    for i in entries:
        for x in {x for x in texts[i] if x.strip()}:
            holders.setdefault(x, []).append(i)
    limit = max(2, rare_share * len(entries))
    place = {i: k for k, i in enumerate(entries)}
    out = []
    for i, lines in enumerate(texts):
        gone = set()
        if first["\n".join(lines)] != i:
            gone = set(range(len(lines))) if any(x.strip() for x in lines) else set()
        else:
            rare = {x for x in lines if x.strip() and 1 < len(holders[x]) <= limit}
            earlier = {j for x in rare for j in holders[x] if place[j] < place[i]}
            for j in earlier:
                marked = diff(*[[x if x.strip() else "" for x in t] for t in (texts[j], lines)])
                gone |= {k for k in marked if lines[k] in rare}
            filler = "".join("f" if not x.strip() or len(holders[x]) > limit else "-" for x in lines)
            more = set()
            for m in re.finditer("f+", filler):
                a, b = m.span()
                sides = {k for k in (a - 1, b) if 0 <= k < len(lines)}
                if sides and sides <= gone:
                    more |= set(range(a, b))
            gone |= more
        rest = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((rows[i][0], len(lines), len(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    rows = QUERIES["op7_line_dedup"](spark, path).collect()
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in rows), key=str)
    assert got == plain(docs, diff=line_dedup.aligned)  # which is compared with plain_diff below
    assert sum(r.n_removed for r in rows) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"line {i}" for i in range(60)] + ["", "  ", "common"]
    rows = []
    for i in range(80):
        lines = rng.choices(pool, k=rng.randint(0, 12))
        if rows and rng.random() < 0.6:
            old = (rng.choice(rows)[1] or "").split("\n")
            a = rng.randrange(len(old))
            lines = lines[:3] + old[a:] + lines[3:6] + rng.choice([[], old[:2]])
        rows.append((i, "\n".join(lines)))
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None), (None, "alone"), (None, "alone")]
    rows += [(90, "a\nb"), (94, "b\nc"), (95, "p q"), (95, "r s"), (91, "x" * 200_000 + "\nline 1"), (92, "\n\n"), (93, "\n\n")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int")
    got = line_dedup.dedup_lines(df.repartition(4)).collect()
    found = [(r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(found, key=str) == plain(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_alignment_equals_plain_patience_diff():
    rng = random.Random(7)
    for _ in range(500):
        a = [rng.randint(1, 9) for _ in range(rng.randint(0, 12))]
        b = [rng.randint(1, 9) for _ in range(rng.randint(0, 12))]
        assert line_dedup.aligned(a, b) == sorted(plain_diff(a, b))


def all_pairs(texts, rare_share=0.4):
    """Lines that stay of each document when every pair that shares a rare line is aligned."""
    docs = [t.split("\n") for t in texts]
    held = Counter(x for d in docs for x in set(d))
    rare = {x for x, n in held.items() if 1 < n <= max(2, rare_share * len(docs))}
    out = []
    for i, d in enumerate(docs):
        gone = set()
        for a in docs[:i]:
            if rare & set(a) & set(d):
                gone |= set(plain_diff(a, d))
        out.append([x for k, x in enumerate(d) if k not in gone])
    return out


def kept_lines(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(line_dedup.dedup_lines(df.repartition(4)).collect(), key=lambda r: r.doc_id)
    return [bytes(r.kept).decode().split("\n") if r.n_removed < r.n_lines else [] for r in rows]


def test_later_documents_that_share_a_block_are_aligned(spark):
    texts = ["Q\nfoo\nP", "P\nQ\nx", "P\nQ\ny", "a", "b", "c", "d", "e"]
    assert kept_lines(spark, texts)[:3] == [["Q", "foo", "P"], all_pairs(texts)[1], ["y"]]


def test_every_pair_that_shares_a_rare_line_counts(spark):
    rng = random.Random(5)
    pool = [f"line {i}" for i in range(25)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(2, 9)) + [f"own {i}"]) for i in range(90)]
    assert kept_lines(spark, texts) == all_pairs(texts)
