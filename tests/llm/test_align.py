import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cityflux.llm import align
from cityflux.llm.queries import QUERIES

LEFT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LEFT.encode_special_tokens = True
RIGHT = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The bytes that the letters of a byte-level vocabulary stand for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


LETTERS = byte_of()


def tokens(text):
    """(id, bytes) of both sides, or nothing."""
    if not text:
        return None
    a = [(i, bytes(LETTERS[c] for c in LEFT.id_to_token(i))) for i in LEFT.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in RIGHT.encode(text):
        p = RIGHT.id_to_piece(i)
        b.append((i, bytes([int(p[3:-1], 16)]) if RIGHT.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in s) == whole for s in (a, b)) else None


def spans(side):
    at, out = 0, []
    for i, raw in side:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def plain(rows):
    """One row of measures per (id, text), by comparing stretches one by one."""
    parts, count = [], Counter()
    for _, text in rows:
        found = tokens(text)
        if found is None:
            parts.append(None)
            continue
        a, b = map(spans, found)
        links, j = [], 0
        for low, high, i in a:
            while b[j][1] <= low:
                j += 1
            k = j
            while k < len(b) and b[k][0] < high:
                links.append((i, b[k][2]))
                k += 1
        ends = {e for _, e, _ in a} & {e for _, e, _ in b}
        groups, at = [], [0, 0]
        for e in sorted(ends):
            group = []
            for s, side in enumerate((a, b)):
                ids = []
                while at[s] < len(side) and side[at[s]][1] <= e:
                    ids.append(str(side[at[s]][2]))
                    at[s] += 1
                group.append(",".join(ids))
            groups.append("|".join(group))
        parts.append((len(a), len(b), groups, links))
        count.update(set(links))
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for (doc, _), p in zip(rows, parts):
        if p is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = p
        best = sum(count[x] == top[x[0]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(count[x] for x in links), digest))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert rows_of(QUERIES["op12_align"](spark, path)) == plain([(d.doc_id, d.text) for d in docs])


ODD = [
    None, "", " ", "  ", " a", "a ", "a\n\nb\t c", "▁", "a▁b", "<s> </s><unk>", "<0x41>", "<|endoftext|> x", "é́ ﬁ ½",
    "日本語　テスト", "👩‍👩‍👧 ok", "\x00\x01", "﻿bom", "x" * 6000, "ab " * 700, "don't WE'LL  12345",
]


@pytest.mark.parametrize("block", [1, 400, 4 << 20])
def test_odd_rows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    rng = random.Random(block)
    texts = ODD + [" ".join(rng.choices(["the", "tokenisation", "é", "xyzzy", "\n", "a  b"], k=rng.randint(1, 30))) for _ in range(60)]
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, "the same text")] * 30 + [(2, "the same text")]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "key long, body string, n_a int, pair string")
    assert rows_of(align.align(docs.repartition(5), "key", "body")) == plain(rows)


def test_pairs_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "b")], "doc_id long, text string")
    _, pairs = align.align_texts(docs)
    got = {(r.a, r.b): (r.documents, r.best) for r in pairs.collect()}
    both = tokens("a b")
    assert got == {(both[0][0][0], both[1][0][0]): (2, True), (both[0][1][0], both[1][1][0]): (3, True)}


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id int, text string")).count() == 0
