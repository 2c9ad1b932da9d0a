"""Wavelet matrix files: queries against plain arrays, round trip against the tokenizer."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import wavelet as X
from millrace.llm.common import read_table, shared_path


@pytest.mark.parametrize("n,top", [(1, 0), (7, 1), (5000, 49407), (100_000, 300), (70_000, 1 << 20)])
def test_queries_equal_plain_array(n, top):
    rnd = np.random.default_rng(n)
    a = np.minimum(rnd.zipf(1.3, n), top).astype(np.uint32)
    m = X.WaveletMatrix(X.build(a, [5], np.array([0])))
    assert (m.tokens() == a).all()
    for i in rnd.integers(0, n, 20):
        t = int(a[i])
        assert m.access(int(i)) == t
        assert m.rank(t, int(i)) == int((a[:i] == t).sum())
        where = np.flatnonzero(a == t)
        assert m.count(t) == len(where)
        k = int(rnd.integers(0, len(where)))
        assert m.select(t, k) == where[k]
    assert m.count(top + 12345) == 0
    with pytest.raises(IndexError):
        m.select(int(a[0]), n + 1)


def expected(docs):
    t = Tokenizer.from_file(X.default_vocabulary())
    out, at = [], 0
    for key, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, X.END_ID], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_tokenizer(spark, sf_dir):
    docs = [tuple(r) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in X.op2_wavelet_tokens(spark, sf_dir).collect())
    assert got == expected(docs)


def test_odd_texts_and_small_shards(spark):
    odd = [None, "", "   ", "It's I'LL don't x'' s 'S", "<|endoftext|> a<|startoftext|>b", " a b　c\x1cd\x85e",
           "Été ́x", "日本語のテキスト 12345 ½ ﬁ ", "a\tb\r\nc\x0bd\x0ce", "x" * 5000, "😀😀 a😀b", "ab " * 3000,
           "don't. it's!! a'!! 's. x1. 1.. a.b. É!! w|x|| <|ENDOFTEXT|>! →!! a→!! İst! क़ख़? I'VE'LL.. 'tis'' ﬀ!", "THE the The the. THE!! the!!"]
    docs = [(i * 3, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(k, t, "n") for k, t in docs], "doc_id long, text string, name string").repartition(3)
    folder = shared_path(spark, "test")
    shards = X.write_shards(df, folder, shard_tokens=50)
    got = sorted(tuple(r) for r in X.read_shards(spark, folder, shards).collect())
    assert got == expected(docs)
    assert shards.count() > 4
    assert X.encode_corpus(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in X.encode_corpus(df).collect()), key=lambda r: r[1])
    assert got == [(None, 0, 2), (1, 2, 3), (1, 5, 3), (2, 8, 1)]


def test_letters_that_the_normaliser_takes_apart():
    """Capital Turkish, Devanagari and Hebrew letters before marks: one run of marks for the splitter."""
    import random
    rnd = random.Random(3)
    letters = ["İ", "I", "\u0958", "\u095f", "\ufb1f", "\ufb4b", "ß", "ẞ", "Σ", "é", "É", "a", "Z", "ǰ", "ﬁ", "क", "各", "\u1fb7"]
    marks = [".", "!", ",", "?", "'", "\"", "-", "!!", ".)", "'s", ""]
    texts = ["HABER GELDİ.", "DEVLETİ, kurdu", "\u0958.", "\ufb1f!", "İ İ. İİ!? İ'"]
    texts += [" ".join("".join(rnd.choices(letters, k=rnd.randrange(1, 5))) + rnd.choice(marks) for _ in range(rnd.randrange(1, 6))) for _ in range(4000)]
    e = X.WordEncoder(X.default_vocabulary())
    got = [x for i in range(0, len(texts), 64) for x in e.batch([t.encode() for t in texts[i:i + 64]])]
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, e.dtype).tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, X.END_ID], repr(t)


def test_string_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([("b", "x y", 1, 2), ("a10", "z", 1, 2), (None, "q", 1, 2), ("a9", "w " * 50, 1, 2)],
                               "doc_id string, text string, name int, id int")
    got = X.encode_corpus(df, shard_tokens=3).collect()
    assert [(r.id, r.start) for r in sorted(got, key=lambda r: r.start)] == [(None, 0), ("a10", 2), ("a9", 4), ("b", 55)]


def test_little_memory_for_words():
    """Generations that turn over with every batch give the same ids."""
    texts = [f"w{i % 7} Word{i}!! same same {'x' * (i % 5)}é." for i in range(200)]
    e = X.WordEncoder(X.default_vocabulary(), 10)
    got = [x for i in range(0, 200, 16) for x in e.batch([t.encode() for t in texts[i:i + 16]])]
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, e.dtype).tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, X.END_ID]
