"""Subword quality classifier: held-out accuracy, exactness of the word-wise score, edge rows."""

import math
import zlib

import numpy as np

from millrace.llm import quality_model as Q
from millrace.llm.common import bounded_sample, read_table

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = read_table(spark, MEDIUM, "labels").select("doc_id", "quality")
    rows = Q.op10_subword_quality(spark, MEDIUM)
    assert rows.count() == read_table(spark, MEDIUM, "documents").count()
    got = rows.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def trained(rows):
    known = {}
    return Q.Embeddings([(*Q.document_features(t, known), label) for t, label in rows])


def plain_features(text):
    """Bucket -> share, gram by gram."""
    n = {}
    for w in text.split():
        w = b"<" + w + b">"
        for g in [w] + [w[i:i + k] for k in (3, 4, 5) if k < len(w) for i in range(len(w) - k + 1)]:
            b = zlib.crc32(g) % Q.BUCKETS
            n[b] = n.get(b, 0) + 1
    return {b: k / sum(n.values()) for b, k in n.items()}


def test_training_equals_plain_gradient_descent(monkeypatch):
    """The same epochs, orders and rates with one loop per document, bucket, dimension and class."""
    monkeypatch.setattr(Q, "LEAST_STEPS", 12)
    monkeypatch.setattr(Q, "BATCH", 4)
    texts = [(b"good words here", 1), (b"BAD!! BAD!!", 0), (b"other good words", 1), (b"WORSE!! x", 0), (b"", 0), (b"fine day", 1)]
    model = trained(texts)
    rnd = np.random.default_rng(Q.SEED)
    dims = range(Q.DIMENSIONS)
    v = rnd.uniform(-1 / Q.DIMENSIONS, 1 / Q.DIMENSIONS, (Q.BUCKETS, Q.DIMENSIONS)).astype(np.float32).astype(float)
    out, bias = [[0.0, 0.0] for _ in dims], [0.0, 0.0]
    steps, done = 2 * 6, 0
    for _ in range(6):
        order = rnd.permutation(len(texts))
        for i in range(0, len(texts), 4):
            rate, docs = Q.RATE * (1 - done / steps), []
            for k in order[i:i + 4]:
                share = plain_features(texts[k][0])
                hidden = [sum(s * v[b][d] for b, s in share.items()) for d in dims]
                z = [bias[c] + sum(hidden[d] * out[d][c] for d in dims) for c in (0, 1)]
                e = [math.exp(x - max(z)) for x in z]
                err = [e[c] / sum(e) - (c == texts[k][1]) for c in (0, 1)]
                docs.append((share, hidden, err, [sum(err[c] * out[d][c] for c in (0, 1)) for d in dims]))
            for d in dims:
                for c in (0, 1):
                    out[d][c] -= rate * sum(h[d] * err[c] for _, h, err, _ in docs) / len(docs)
            for c in (0, 1):
                bias[c] -= 0.1 * rate * sum(err[c] for _, _, err, _ in docs) / len(docs)
            for share, _, _, grad in docs:
                for b, s in share.items():
                    for d in dims:
                        v[b][d] -= rate * s * grad[d]
            done += 1
    want = [sum(v[b][d] * (out[d][1] - out[d][0]) for d in dims) for b in range(0, Q.BUCKETS, 7)]
    assert np.allclose(model.amounts[::7], want, atol=1e-4) and abs(model.bias - (bias[1] - bias[0])) < 1e-4
    assert np.ptp(model.amounts) > 0.1


def test_a_sample_is_bounded_when_ids_repeat(spark):
    rows = spark.createDataFrame([(7, i % 2) for i in range(3000)] + [(i, 1) for i in range(10, 200)], "id long, label int")
    got = bounded_sample(rows, "label", "id", 50).collect()
    assert len(got) == len({r.id for r in got}) == 51 and sum(r.label for r in got) == 50


def test_score_equals_average_of_all_vectors():
    rows = [(b"good words here and there", 1), (b"BAD!! BAD!! WORDS!!", 0), (b"other good words", 1), (b"WORSE!! THINGS!!", 0)] * 20
    model = trained(rows)
    for text in (b"good words", b"BAD!! BAD!!", b"new new new", b"x" * 1000):
        at, share = Q.document_features(text, {})
        z = float((np.array(model.amounts)[at] * share).sum()) + model.bias
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-6
    assert model.scores([b"good words"])[0] > 0.5 > model.scores([b"BAD!! THINGS!!"])[0]
    assert model.scores([b""]) == model.scores([b" \n"])


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    assert [r[0] for r in docs.select(Q.score(docs.text, model)).collect()] == [0.5] * 4
    assert Q.fit(docs.limit(0), labels.limit(0)).scores([b"a"]) == [0.5]
