import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cityflux.llm import idfiles
from cityflux.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\t\r\n\x0b\x0c", "a", "It's  the END of\x1cit", "<|endoftext|> x<|startoftext|>y",
    "é ́ x́", "ΣΑΣ ΟΔΟΣ'S", "İstanbul don't WE'LL 123 4.5", "x" * 5000, "日本語 テスト　が",
    "👩‍👩‍👧 ok", "</w> a</w>", "'s 't 'S", "﻿\x00\x85 z",
]


def plain(rows):
    """(id, start, tokens, checksum) by encoding whole texts, in ascending order of id."""
    model = Tokenizer.from_file(PATH)
    out, at = [], 0
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").orderBy("doc_id").collect()
    rows = QUERIES["op11_id_files"](spark, path).collect()
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows)
    assert got == plain([(d.doc_id, d.text) for d in docs])


def test_words_alone_give_the_ids_of_texts(monkeypatch):
    rng = random.Random(3)
    letters = "aB \t\n'é\u0301 ς 12<|>ÄßÿĀ×²ª.,stvemld"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(600)]
    assert idfiles.WordIds(PATH, 2).ruled
    model = Tokenizer.from_file(PATH)
    for most in (1 << 19, 7):
        monkeypatch.setattr(idfiles, "REMEMBERED", most)
        encode = idfiles.WordIds(PATH, 2)
        for part in (texts, texts[:1], texts[5:9]):
            ids, n = encode(pa.array(part, pa.string()))
            want = [model.encode(t or "", add_special_tokens=False).ids + [2] for t in part]
            assert ids.tolist() == [i for w in want for i in w]
            assert n.tolist() == [len(w) for w in want]
    with pytest.raises(ValueError):
        idfiles.WordIds(public_tokenizers.path("byte_bpe_50k.json"), 2)


@pytest.mark.parametrize("kinds", [1, 2, 300, 60_000])
def test_blocks_round_trip(kinds):
    rng = np.random.default_rng(kinds)
    ids = (rng.zipf(1.3, 150_000) % kinds).astype(np.uint32) * 7 + 5
    found, counts = np.unique(ids, return_counts=True)
    table = idfiles.Table.of_counts(found, counts)
    assert table.freq.sum() == 1 << table.bits and table.freq.min() > 0
    for n in (1, 63, 64, 65, 16_384, 16_385, 50_000):
        symbols = np.searchsorted(table.ids, ids[: 3 * n]).reshape(3, n)
        bodies = idfiles.encode_blocks(symbols, table)
        got = idfiles.decode_blocks(bodies, table)
        assert [g.tolist() for g in got] == [ids[k * n : (k + 1) * n].tolist() for k in range(3)]
    if kinds == 300:  # close to the entropy of the ids
        share = counts / counts.sum()
        entropy = -(share * np.log2(share)).sum() / 8 * 50_000
        assert len(bodies[0]) < 1.1 * entropy + 3000


def test_damage_is_found():
    symbols = np.arange(1000)[None, :] % 50
    table = idfiles.Table.of_counts(np.arange(50), np.arange(1, 51))
    body = idfiles.encode_blocks(symbols, table)[0]
    for at in (0, 20, len(body) // 2, len(body) - 1):
        bad = bytearray(body)
        bad[at] ^= 4
        with pytest.raises(idfiles.DamagedBlock):
            idfiles.decode_blocks([bytes(bad)], table)
    with pytest.raises(idfiles.DamagedBlock):
        idfiles.decode_blocks([body[:10]], table)
    with pytest.raises(idfiles.DamagedBlock):
        idfiles.decode_blocks([body], idfiles.Table.of_counts(np.arange(50), np.ones(50)))
    # a wrong state behind a mended outer checksum still shows in the checksum of the ids
    bad = bytearray(body[:-4])
    bad[40] ^= 1
    with pytest.raises(idfiles.DamagedBlock):
        idfiles.decode_blocks([bytes(bad) + struct.pack("<I", zlib.crc32(bytes(bad)))], table)


def test_checksums_join():
    rng = random.Random(1)
    for n in (0, 1, 3, 1000, 70_001):
        a, b = rng.randbytes(50), rng.randbytes(n)
        assert idfiles.crc_joined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [1 << 16, 128])
def test_odd_tables_and_documents_over_many_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(idfiles, "BLOCK", block)
    monkeypatch.setattr(idfiles, "TOGETHER", 2)
    monkeypatch.setattr(idfiles, "FILE", 3000)
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choices(["a", "Be", "sea's", "é"], k=rng.randint(0, 900))) for _ in range(40)]
    rows = [(i // 2 if i % 5 else None, t, "n", i) for i, t in enumerate(texts)] + [(7, "same", "n", 1)] * 5
    docs = spark.createDataFrame(rows, "key int, body string, n string, part int")
    path = str(tmp_path / "ids")
    idfiles.write_ids(docs.repartition(4), path, "key", "body")
    read = idfiles.read_documents(spark, path).collect()
    sums = idfiles.read_checksums(spark, path).collect()
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 1
    model = Tokenizer.from_file(PATH)
    of = {t: [*model.encode(t or "", add_special_tokens=False).ids, 2] for t in {r[1] for r in rows}}
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in read]
    assert sorted(got, key=str) == sorted(((r[0], of[r[1]]) for r in rows), key=str)
    at = 0
    for r in sorted(read, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(read, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    digest = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read), key=str)
    assert sorted((tuple(r) for r in sums), key=str) == digest
    some = idfiles.read_pieces(spark, path, "block = 0").collect()
    assert {r.part for r in some} and all(r.at == 0 for r in some if r.start == 0)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "none")
    idfiles.write_ids(docs, path)
    assert idfiles.read_documents(spark, path).count() == 0
    assert idfiles.read_checksums(spark, path).count() == 0
