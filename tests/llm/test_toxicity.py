import math
import random
import zlib

import numpy as np
import pytest

from cityflux.llm import toxicity
from cityflux.llm.queries import QUERIES


def small_network():
    rng = np.random.default_rng(1)
    net = toxicity.Network(
        rng.standard_normal(toxicity.BUCKETS).astype(np.float32),
        rng.standard_normal(toxicity.BUCKETS).astype(np.float32),
    )
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_gradients_equal_differences():
    net = small_network()
    lex = toxicity.Lexicon(["one two three two", "", "vier fünf " * 30])
    stripes, _, windows = toxicity.stripes_of(lex.docs)
    stripes = np.concatenate([stripes, stripes[2:]])
    begin = np.concatenate([windows - 1, np.zeros(len(windows) - 2, int)])
    slope = np.linspace(-1, 2, len(stripes))

    def value():
        return float(net.forward(net.word_inputs(lex), stripes, begin)[0] @ slope)

    # inputs are float32, so steps are coarse
    _, kept = net.forward(net.word_inputs(lex), stripes, begin)
    found = net.gradients(lex, stripes, kept, slope)
    rng = np.random.default_rng(2)
    for name, grad in found.items():
        flat = np.abs(grad).ravel()
        for at in {int(flat.argmax()), int(rng.integers(len(flat)))}:
            where = np.unravel_index(at, grad.shape)
            old, step = net.p[name][where], 1e-2
            net.p[name][where] = old + step
            up = value()
            net.p[name][where] = old - step
            down = value()
            net.p[name][where] = old
            assert grad[where] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=2e-3), name


def test_a_window_starts_at_every_word():
    for n in (0, 1, 31, 32, 33, 63, 64, 65, 200):
        stripes, owner, windows = toxicity.stripes_of([np.arange(n), np.arange(5)])
        found = []
        for row, count in zip(stripes[owner == 0], windows[owner == 0]):
            found += [row[i : i + toxicity.WINDOW].tolist() for i in range(count)]
        starts = range(max(1, n - toxicity.WINDOW + 1))
        assert found == [[i + k if i + k < n else -1 for k in range(toxicity.WINDOW)] for i in starts]


def plain_logit(net, inputs, stripe, at):
    """A window's logit, word by word and unit by unit."""
    p, size = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))
    words = [w for w in stripe.tolist() if w >= 0]
    states = [[0.0] * (2 * size) for _ in words]
    for side, d in enumerate("fb"):
        h = [0.0] * size
        for t in range(len(words)) if d == "f" else reversed(range(len(words))):
            x = inputs[words[t]]
            gate = [sum(x[i] * p["W" + d][i, j] for i in range(len(x))) + p["b" + d][j] for j in range(3 * size)]
            back = [sum(h[i] * p["U" + d][i, j] for i in range(size)) for j in range(3 * size)]
            new = []
            for j in range(size):
                z, r = sig(gate[j] + back[j]), sig(gate[size + j] + back[size + j])
                c = math.tanh(gate[2 * size + j] + r * (back[2 * size + j] + p["n" + d][j]))
                new.append((1 - z) * c + z * h[j])
            h = new
            states[t][side * size : (side + 1) * size] = h
    states = states[at : at + toxicity.WINDOW]
    scores = []
    for s in states:
        hidden = [math.tanh(sum(s[i] * p["A"][i, k] for i in range(len(s))) + p["a"][k]) for k in range(len(p["a"]))]
        scores.append(math.exp(sum(x * y for x, y in zip(hidden, p["v"]))))
    pooled = [sum(e * s[i] for e, s in zip(scores, states)) / sum(scores) for i in range(2 * size)] if states else []
    return sum(x * y for x, y in zip(pooled, p["w"])) + float(p["c"][0])


def test_logits_equal_a_plain_forward_pass():
    net = small_network()
    lex = toxicity.Lexicon(["one two three two", "", " ".join(f"w{i % 23}" for i in range(90))])
    inputs = net.word_inputs(lex)
    stripes, owner, windows = toxicity.stripes_of(lex.docs)
    logits = net.window_logits(inputs, stripes, windows)
    for k, at in ((0, 0), (1, 0), (2, 0), (2, 7), (2, 31), (3, 26)):
        want = plain_logit(net, inputs.astype(float), stripes[k], at)
        assert logits[k, at] == pytest.approx(want, rel=1e-4, abs=1e-5)
        one = net.forward(inputs, stripes[k : k + 1], np.array([at]))[0][0]
        assert one == pytest.approx(want, rel=1e-4, abs=1e-5)
    assert np.isneginf(logits[0, 1:]).all() and np.isneginf(logits[3, 27:]).all() and len(stripes) == 4
    last = np.concatenate([logits[2], logits[3, :27]])
    best = [logits[0, 0], logits[1, 0], max(last[i : i + 8].mean() for i in range(len(last) - 7))]
    texts = ["one two three two", "", " ".join(f"w{i % 23}" for i in range(90))]
    assert net.scores(texts) == pytest.approx(1 / (1 + np.exp(-np.array(best))), rel=1e-6)


def test_query_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = QUERIES["op2_toxicity"](spark, path).collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p for p, y in held if y) >= 0.7 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.02 * len(held)


def test_defined_cases(spark):
    rng = random.Random(4)
    common = [f"{a}{b}" for a in ("ra", "lo", "mi", "te", "su") for b in ("ver", "lk", "nda", "po", "sh")]
    texts = [" ".join(rng.choices(common, k=20)) for _ in range(120)]
    texts = [t if i < 60 else t + rng.choice([" idiot ", " moron "]) + "lover" for i, t in enumerate(texts)]
    rows = [(i, t, 0.5) for i, t in enumerate(texts)]
    rows += [(1000, None, 0.5), (1001, "", 0.5), (1001, "", 0.5), (None, "idiot moron", None)]
    rows += [(1002, "raver lolk mipo " * 30_000 + "idiot moron " + "sush tenda " * 30_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = [(i, int(i >= 60), 0) for i in range(120)] + [(None, 1, 0), (5, 0, 0), (7000, 1, 1), (6, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert sum(got[i].predicted == int(i >= 60) for i in range(120)) >= 118
    assert got[1000].score == pytest.approx(got[1001].score) and got[1001].predicted == 0
    assert got[1002].predicted == 1 and got[None].held_out is False
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == sorted(
        r.doc_id for r in out if r.predicted == 0 and r.doc_id
    )
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
