import os
import zlib

import numpy as np
import pytest

from gridscope.llm import toxicity

SF = "/root/testdata/sf0.1"


def brute_kernel(a, b):
    """Sum over common subsequences of ORDER letters within MAX_SPAN, each weighed by DECAY to both spans."""
    from itertools import combinations

    def phi(s):
        out = {}
        for at in combinations(range(len(s)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.MAX_SPAN:
                u = "".join(s[i] for i in at)
                out[u] = out.get(u, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    if min(len(a), len(b)) < toxicity.ORDER:
        return 0.0
    x, y = phi("<" + a + ">"), phi("<" + b + ">")  # the start and the end are letters
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernel_against_definition():
    words = ["idiot", "idxiot", "banana", "aaaa", "ab", "stupidity", "the", "oßéü"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(brute_kernel(a, b), abs=1e-5)


def test_sentences():
    assert toxicity.sentences("An i.d.i.o.t, i d i o t! 1d10t\nx y z. Q r") == [["an", "idiot", "idiot"], ["idiot"], ["xyz"]]
    assert toxicity.sentences(None) == [] and toxicity.sentences(" \n") == [] and toxicity.sentences("a b") == []
    assert all(len(w) <= toxicity.PIECE for s in toxicity.sentences("x" * 1000 + " " + "y " * 300) for w in s)


def test_scores_against_explicit_kernels():
    """The folded machine is the sum of alpha times explicit kernels; a document is its sentences' largest margins, calibrated."""
    rng = np.random.default_rng(4)
    landmarks, alpha = ["idiot", "banana", "worthless", "the", "öde"], rng.normal(size=5)
    slope = rng.normal(size=toxicity.TOPS + 1)
    m = toxicity.Model(toxicity._folded(landmarks, alpha), -0.3, slope, 0.2)
    texts = ["you id-iot. the banana is here!\nworth less", "one", "", None, "a. b.", "öde worthles. word. other words. the theme"]
    for t, got in zip(texts, m.scores(texts)):
        margins, n = [], 0
        for s in toxicity.sentences(t):
            margins.append(max(-0.3 + sum(x * brute_kernel(w, y) for x, y in zip(alpha, landmarks)) for w in s))
            n += len(s)
        tops = (sorted(margins, reverse=True) + [-0.3] * toxicity.TOPS)[: toxicity.TOPS]
        z = float(np.dot(slope, [*np.clip(tops, -4, 4), np.log1p(n)])) + 0.2
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_training_reads_whole_texts_of_bounded_rows(spark):
    texts, labels = sample(300)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    l = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")  # noqa: E741
    seen = []
    import gridscope.llm.toxicity as module

    real = module.train
    module.train = lambda t, y: seen.append(t) or real(t, y)
    try:
        toxicity.fit(d, l, max_bytes=20_000)
    finally:
        module.train = real
    assert 10 < len(seen[0]) < 200 and sum(len(t.encode()) for t in seen[0]) <= 20_000 and set(seen[0]) <= set(texts)


def sample(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    clean = ["".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for k in range(n):
        w = rng.choice(clean, rng.integers(20, 80)).tolist()
        bad = k % 6 == 0
        if bad:
            for v in rng.choice(["grumblux", "vexhog", "plumfzz"], 3):
                w.insert(int(rng.integers(0, len(w))), str(v))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_insults_with_gaps_and_inserted_letters():
    texts, labels = sample()
    m = toxicity.train(texts[:900], labels[:900])
    s = m.scores(texts[900:])
    y = np.array(labels[900:])
    assert (s[y == 1] >= 0.7).mean() > 0.97 and (s[y == 0] < 0.7).mean() > 0.97
    hide = {"grumblux": "gru.mb-lux", "vexhog": "v e x h o g", "plumfzz": "pluxmfzz"}
    masked = [" ".join(hide.get(w, w) for w in t.split()) for t, l in zip(texts[900:], labels[900:]) if l]
    assert (m.scores(masked) >= 0.7).mean() > 0.8
    assert len(m.scores(["", None])) == 2 and np.isfinite(m.scores(["", None, "x" * 100_000])).all()


def test_table_edges(spark):
    texts, labels = sample(400)
    d = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, None, 1.0), (5000, "", 1.0), (5000, "", 1.0)], "doc_id long, text string, score double")
    l = spark.createDataFrame([(i, y, "x") for i, y in enumerate(labels)] + [(None, 1, "x"), (9999, None, "x")], "doc_id long, toxic int, text string")  # noqa: E741
    out = toxicity.detect(d, l)
    assert out.count() == 403 and out.where("toxic_score IS NULL OR toxic_score < 0 OR toxic_score > 1").count() == 0
    assert toxicity.detect(d.where("false"), l).count() == 0
    assert toxicity.detect(d, l.where("false")).where("toxic_predicted = 1").count() == 0
    held = d.where(toxicity.held_out(d.doc_id)).select("doc_id").collect()
    assert {r.doc_id for r in held} == {i for i in [*range(400), 5000] if zlib.crc32(str(i).encode()) % 3 == 1}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.detect(docs, labels).where(toxicity.held_out(docs.doc_id)).join(labels.select("doc_id", "toxic"), "doc_id").select("toxic_score", "toxic").collect()
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    rank = np.argsort(np.argsort(s)) + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.93 and (s[y == 0] >= 0.7).mean() < 0.05
