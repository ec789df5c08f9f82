import re

import numpy as np
import pytest

from gradewright.llm import quality_net as qn
from gradewright.llm import quality_rules as qr
from gradewright.llm import toxicity as tx
from gradewright.llm.common import crc_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "one two", "a b c a b c d", "x x x x x x", "#a $b\n\n#a $b\n c|d <e>", "é ü ß z " * 40,
         "l1\nl2\nl1\n l1\nl1", "p q r s\np q r s", "\x1c\x85 w", "a\x0bb\x0cc"]


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert qr.base_counts(text) == base(text)


def test_base_counts_of_given_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert qr.base_counts(r.text) == base(r.text)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def rates(scored, labels, column, answer):
    found = scored.join(labels, "doc_id").select("doc_id", column, answer).collect()
    held = [r for r in found if crc_fold(r.doc_id) == 0]
    hit = {c: np.mean([int(r[answer]) for r in held if r[column] == c]) for c in (0, 1)}
    return hit[0], hit[1]


def test_rules_on_held_out_labels(tables):
    docs, labels = tables
    scored = qr.apply_rules(docs, qr.train(docs, labels)).filter("not base_failed")
    junk, clean = rates(scored, labels, "quality", "kept")
    assert junk < 0.1 and clean > 0.98


def test_net_on_held_out_labels(tables):
    docs, labels = tables
    junk, clean = rates(qn.score(docs, qn.train(docs, labels)), labels, "quality", "predicted")
    assert junk < 0.25 and clean > 0.96


def test_toxicity_on_held_out_labels(tables):
    docs, labels = tables
    clean, toxic = rates(tx.score(docs, tx.train(docs, labels)), labels, "toxic", "predicted")
    assert clean < 0.03 and toxic > 0.8


EDGES = [(1, None, 3), (2, "", 4), (3, "word " * 40_000, 5), (1, None, 3), (None, "some text", 6)]


@pytest.mark.parametrize("module", [qn, tx])
def test_scores_of_edge_cases(rows, module):
    labels = rows([(1, 0, 1), (2, 1, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = rows(EDGES, "doc_id long, text string, score int")
    got = module.score(docs, module.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text is None or r.text == ""}) == 1
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    none = rows([], "doc_id long, text string")
    assert module.score(none, module.train(none, rows([], "doc_id long, quality int, toxic int"))).count() == 0


def test_rules_of_edge_cases(rows):
    labels = rows([(1, 0), (2, 1), (3, None)], "doc_id long, quality int")
    docs = rows(EDGES, "doc_id long, text string, n_words int")
    got = qr.apply_rules(docs, qr.train(docs, labels)).collect()
    assert len(got) == 5 and all(r.base_failed and not r.kept for r in got)
    assert {r.n_words for r in got if not r.text} == {0}
    none = rows([], "doc_id long, text string")
    assert qr.apply_rules(none, qr.train(none, rows([], "doc_id long, quality int"))).count() == 0


def test_gradient_of_the_net():
    r = np.random.default_rng(3)
    net = qn.Net.fresh(1)
    docs = [qn.halves("some text " * 60), qn.halves("other #### text")]
    y = np.array([1.0, 0.0])

    def loss():
        z = [net.logit(net.pool(d), qn.filled(d)) for d in docs]
        return np.mean([np.logaddexp(0, -v) if t else np.logaddexp(0, v) for v, t in zip(z, y)])
    grads = net.gradient(docs, y)
    for p, g in zip(net.params(), grads):
        flat = p.reshape(-1)
        for k in r.choice(np.argsort(-np.abs(g.ravel()))[:40], 3):
            old, eps = flat[k], 2e-3
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert (up - down) / (2 * eps) == pytest.approx(g.ravel()[k], rel=0.1, abs=2e-4)


def test_chunks_cover_the_whole_text():
    text = "a" * 5000 + "Z" + "b" * 300
    rows_ = qn.halves(text)
    assert len(rows_) * qn.HALF >= len(text) and (rows_ == ord("Z")).any()
    assert len(qn.halves("")) == 1


def test_training_reads_whole_texts(rows, monkeypatch):
    seen = {}
    monkeypatch.setattr(qn, "fit", lambda docs, y, prior: seen.update(docs=docs))
    good, bad = "word " * 20_000 + "end", "#" * 70_001
    data = rows([(i, t) for i, t in enumerate([good, bad] * 5)], "doc_id long, text string")
    qn.train(data, rows([(i, 1 - i % 2) for i in range(10)], "doc_id long, quality int"))
    assert {bytes(d) for d in seen["docs"]} == {good.encode(), bad.encode()}


def test_a_step_of_training_learns_what_scoring_sees(monkeypatch):
    text = "word " * 3000 + "\x00\x01\x02" * 100 + "word " * 3000
    given = []
    step = qn.Net.gradient
    monkeypatch.setattr(qn.Net, "gradient", lambda net, docs, y: given.extend(docs) or step(net, docs, y))
    qn.fit([text.encode(), b"word"], np.array([0.0, 1.0]), 0.5, epochs=1)
    assert any(d.shape == qn.halves(text).shape and (d == qn.halves(text)).all() for d in given)


def test_toxicity_scores_against_brute_force():
    """Word by word in plain Python, with exactly rounded sums."""
    import math
    import random
    import re
    import zlib

    import numpy as np

    from gradewright.llm import toxicity, words
    r = random.Random(6)
    g = np.random.default_rng(6)
    model = toxicity.Model(g.normal(size=(3, toxicity.SIZE)), g.normal(size=3))
    vocab = [f"{r.choice('abcdé')}{r.choice('xyzß')}{'q' * r.randint(0, 6)}{r.choice('mnü')}" for _ in range(200)]
    texts = [None, "", " \n", "12 34", "İK ΑΒ ÉÀ", "a" * 9000] + [
        " ".join(r.choice([str.upper, str.lower, str.title])(r.choice(vocab)) + r.choice(["", ",", "7", "."]) for _ in range(r.randint(0, 300)))
        for _ in range(120)]

    def score(text):
        found = set(re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()))
        keys = [k for w in found for k in [b"w" + w] + [b"%d" % n + w[:n] for n in toxicity.STEMS if len(w) >= n]]
        at = [zlib.crc32(k) >> (32 - toxicity.BITS) for k in keys]
        z = [math.fsum(model.weights[m][i] for i in at) / math.sqrt(max(1, len(at))) + model.bias[m] for m in range(3)]
        return sum(1 / (1 + math.exp(-max(-60, min(60, x)))) for x in z) / 3
    want = [score(t) for t in texts]
    for segment in (1, 700, 1 << 18):
        words.SEGMENT, kept = segment, words.SEGMENT
        try:
            got = toxicity.Scorer(model).probabilities(texts)
        finally:
            words.SEGMENT = kept
        assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12


def test_fitting_needs_no_copy_of_the_rows_as_doubles():
    import tracemalloc
    r = np.random.default_rng(2)
    x = r.random((1300, 5000), np.float32)
    y, weight = (r.random(1300) < .5).astype(float), np.full(1300, 1 / 1300)
    assert np.allclose(qr._forward(x, y[:1].repeat(5000)), x.astype(float) @ y[:1].repeat(5000))
    assert np.allclose(qr._backward(y, x), y @ x.astype(float))
    tracemalloc.start()
    qr._logistic(x, y, weight, 1e-4, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * x.nbytes  # a block as doubles at a time; all rows are twice the bytes


def test_the_driver_gets_the_model_not_the_rows(rows):
    import tracemalloc
    r = np.random.default_rng(3)
    docs = rows([(i, " ".join(f"{'good' if i % 2 else 'bad'}{k}" for k in r.integers(0, 50, 60))) for i in range(400)],
                "doc_id long, text string")
    labels = rows([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    tracemalloc.start()
    model = qr.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # some 320 rows to fit to take 10 MB
    cache = qr._Words()
    assert model.probability("good1 good2 good3", cache) > .8 > .2 > model.probability("bad1 bad2 bad3", cache)
