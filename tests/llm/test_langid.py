"""Nearest-centroid language ID: accuracy on held-out rows, brute-force vectors, edge rows."""

import math
import re
from collections import Counter

import numpy as np

from millrace.llm import langid as L
from millrace.llm.common import read_table

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = read_table(spark, MEDIUM, "documents").select("doc_id", "lang", "text")
    rows = L.op7_centroid_langid(spark, MEDIUM).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and len(r.text) >= 40]
    assert len(held) > 100
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert not any(r.rejected for r in rows if len(r.text) >= 40)


def test_counts_equal_plain_ngrams():
    text = "Ab  c!9é"
    got = L.ngram_counts(text)
    line = "ab c é".encode()
    n = Counter(line[i:i + k] for k in L.ORDERS for i in range(len(line) - k + 1))
    assert got.sum() == sum(n.values())
    assert len(np.flatnonzero(got)) <= len(n)
    long = "word and other words " * 120_000           # over one chunk
    a, b = L.ngram_counts(long), L.ngram_counts("word and other words " * 1000)
    assert set(np.flatnonzero(a)) == set(np.flatnonzero(b))


def plain_vector(text, idf=None):
    """Gram by gram: bucket -> log(1 + count) * idf, of length one."""
    line = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode())
    n = Counter()
    for size in L.ORDERS:
        for i in range(len(line) - size + 1):
            code = int.from_bytes(line[i:i + size], "big")
            n[(code * 0x9E3779B1 + (size * 0x85EBCA6B & 0xFFFFFFFF) & 0xFFFFFFFF) >> 18] += 1
    v = {b: math.log1p(k) * (1 if idf is None else idf[b]) for b, k in n.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / length for b, x in v.items()}


def test_query_equals_plain(spark, sf_dir):
    """Frequencies, limits and predictions from all rows, one text at a time; only the centroids are taken over."""
    docs = read_table(spark, sf_dir, "documents")
    train = [(r.lang, r.text) for r in L.training_rows(docs).collect() if r.lang is not None and r.text is not None and any(c.isalpha() for c in r.text)]
    model = L.fit(L.training_rows(docs))
    seen = Counter(b for _, t in train for b in plain_vector(t))
    idf = [math.log((1 + len(train)) / (1 + seen[b])) + 1 for b in range(L.BUCKETS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    cos = lambda v: [sum(x * c[b] for b, x in v.items()) for c in model.centroids.tolist()]
    by = {}
    for lang, text in train:
        v = plain_vector(text, idf)
        own = max(c for c, k in zip(cos(v), model.owner) if model.langs[k] == lang)
        by.setdefault(len(v).bit_length(), []).append(own)
    for level, own in by.items():
        assert abs(model.least[level] - L.SHARE * sorted(own)[len(own) // L.RARE]) <= L.SHARE * 2 / 1000
    got = {r.doc_id: r for r in L.op7_centroid_langid(spark, sf_dir).collect()}
    for r in docs.collect():
        have = got[r.doc_id]
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (have.lang_pred, have.score) == ("und", 0.0)
            continue
        c = cos(plain_vector(r.text, idf))
        assert abs(have.score - max(c)) < 1e-4
        assert have.lang_pred == model.langs[model.owner[int(np.argmax(c))]] or sorted(c)[-1] - sorted(c)[-2] < 1e-5


def test_limits_do_not_follow_the_sample(spark):
    docs = L.training_rows(read_table(spark, MEDIUM, "documents"))
    a, b = L.fit(docs), L.fit(docs, sample=50)
    assert (a.idf == b.idf).all()
    assert not any(m.predict(r.text)[2] for m in (a, b) for r in docs.collect() if len(r.text or "") >= 40)


def test_rejects_far_and_empty_texts(spark):
    model = L.fit(L.training_rows(read_table(spark, MEDIUM, "documents")))
    assert model.predict(None) == model.predict("") == model.predict(" 12 $%") == ("und", 0.0, True)
    assert model.predict("это совсем другой язык и другие буквы в каждом слове")[2]
    assert model.predict("日本語のテキストはここにあります")[2]
    lang, score, rejected = model.predict("The and for with that of the in, is thtion. Ing the and.")
    assert (lang, rejected) == ("en", False) and score > 0.3


def test_edge_tables(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (None, "Text here", "en", "b"), (2, "Text here", "en", "c"), (2, "Text here", "en", "c")],
                               "doc_id long, text string, lang string, found string")
    out = L.accepted(df)
    assert out.columns == df.columns
    assert L.accepted(df.limit(0)).count() == 0
    empty = L.fit(df.limit(0))
    assert empty.predict("Text") == ("und", 0.0, True)
