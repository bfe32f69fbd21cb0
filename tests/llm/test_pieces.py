import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cityflux.llm import pieces
from cityflux.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(3)
    words = ["the", "running", "naïve", "漢字", "a", "\n", "\t", "don't", "x" * 30, "ßé", "\U0001f600", "", " "]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    letters = "".join(rng.choices("etaoinshr", k=700))
    return [*texts, letters, "".join(rng.choices("ab 漢", k=500)), "a" * 400, " " * 200, "no" + " " * 90 + "end ", "c▁d"]


@pytest.mark.parametrize("size", [40, 70, 100_000])
def test_ids_are_the_librarys(spark, library, size):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (7, texts[7])], "doc_id long, text string")
    rows = pieces.encode(df.repartition(3), chunk=size).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = library.encode(texts[r.doc_id]) if r.doc_id is not None else []
        assert np.frombuffer(r.ids, "<i4").tolist() == want, texts[r.doc_id]
    back = pieces.decode(pieces.encode(df, chunk=size)).collect()
    assert {r.doc_id: r.text for r in back if r.doc_id is not None} == {
        i: t.replace("▁", " ") for i, t in enumerate(texts)
    }
    assert pieces.encode(df.limit(0)).count() == 0


class Unigram(pieces.Pieces):
    """The same pieces as a unigram model with made-up probabilities."""

    def __init__(self, path):
        super().__init__(path)
        self.bpe = False
        self.score = {p: -len(p) ** 0.7 - (hash(p[:2]) % 7) / 10 for p in self.id}
        self.missing = -40 * pieces.SCALE


def plain_viterbi(model, text):
    best = [0] + [None] * len(text)
    for p in range(len(text)):
        for r in range(p + 1, min(len(text), p + model.longest) + 1):
            if best[p] is not None and model.known(text[p:r]):
                s = best[p] + model.step(None, text[p:r])
                if best[r] is None or s > best[r]:
                    best[r] = s
    return best[-1]


@pytest.mark.parametrize("kind", [pieces.Pieces, Unigram])
@pytest.mark.parametrize("size", [33, 50])
def test_products_of_matrices_hold_the_best_score(kind, size):
    model = kind(PATH)
    for text in odd_texts()[-8:]:
        whole = pieces.marked(text)
        reach = 2 * model.longest + 1
        borders = [*range(0, max(1, len(whole) - reach), size), len(whole)]
        matrices = []
        for x, y in zip(borders, borders[1:]):
            low = max(0, x - reach)
            body = whole[low : y + reach] + ("" if y == len(whole) else "\0")
            matrices.append(pieces.Chunk(model, body, x - low, y - low).matrix())
        left = matrices[0]
        for m in matrices[1:]:
            left = pieces.product(left, m)
        right = matrices[-1]
        for m in reversed(matrices[:-1]):
            right = pieces.product(m, right)
        assert left.tolist() == right.tolist()
        want = 0 if model.bpe else plain_viterbi(model, whole)
        assert left.tolist() == [[want]]


def test_query_round_trips(spark, library):
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op8_sentencepiece"](spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = np.array(library.encode(docs[r.doc_id]), "<i4")
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_other_columns_with_clashing_names(spark, library):
    rows = [(i, t, "x", 1, 2.0, "n") for i, t in enumerate(odd_texts()[:20])] + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key long, body string, doc_id string, row int, ids double, text string")
    got = pieces.encode(df, "key", "body", chunk=70)
    assert got.columns == ["doc_id", "ids"]
    want = {r[0]: library.encode(r[1] or "") for r in rows}
    assert {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in got.collect()} == want
    assert pieces.encode(df.limit(0), "key", "body", chunk=70).count() == 0
