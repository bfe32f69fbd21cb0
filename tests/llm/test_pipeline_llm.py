import re

import numpy as np
import pytest
from test_packing import reference_ids
from test_simhash import plain_classes, plain_fingerprint

import corpus_pipeline
from cityflux.llm import toxicity


W = corpus_pipeline.PASSAGE


def cut_repeats(texts):
    """Texts without bytes of windows that occur twice, incomplete characters dropped."""
    data = [t.encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - W + 1):
            seen[b[i : i + W]] = seen.get(b[i : i + W], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - W + 1):
            if seen[b[i : i + W]] > 1:
                gone[i : i + W] = True
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def plain_pipeline(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    net = toxicity.fit(table("documents"), table("labels"))
    ids = sorted(docs)
    score = dict(zip(ids, net.scores([docs[i] for i in ids])))
    first = {}
    for i in ids:
        if score[i] < 0.7:
            first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]), i)
    ids = sorted(first.values())
    classes = plain_classes(ids, [plain_fingerprint(docs[i]) for i in ids])
    ids = [i for i, c in zip(ids, classes) if i == c]
    texts = cut_repeats([docs[i] for i in ids])
    return dict(zip(ids, reference_ids(texts)))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_run_equals_plain_python(spark, sf):
    path = f"/root/testdata/{sf}"
    want = plain_pipeline(spark, path)
    rows = corpus_pipeline.run(spark, path).collect()
    got, places = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_take_odd_tables(spark):
    rows = [
        (1, None, "en", "s", None, "k"), (None, "", None, None, 0, None), (2, "a b c d", "en", "s", 7, "k"),
        (2, "a b c d", "en", "s", 7, "k"), (3, "a  b c d", "en", "s", 8, "k"), (4, "é" * 9000, "fr", "s", 9000, "k"),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "packing":
                assert out.dtypes == docs.dtypes, name
            docs = out
        docs.collect()


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "suffix_dedup", "packing"]
