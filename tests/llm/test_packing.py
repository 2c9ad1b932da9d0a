"""Packing: ids against the tokenizer, sequences against their definition, the search against plain best fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing as P
from millrace.llm.common import read_table


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.default_vocabulary()[0])


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def check(rows, docs, tokenizer, length=P.LENGTH):
    """rows: (id, piece, start, length, crc, sequence, offset); docs: {id: text}. Returns the number of sequences."""
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
        places[r[5]].append((r[6], r[3]))
    assert set(by) == set(docs)
    for key, mine in by.items():
        ids, at = plain_ids(tokenizer, docs[key]), 0
        for k, r in enumerate(sorted(mine, key=lambda r: r[1])):
            assert r[1:3] == (k, at) and 1 <= r[3] <= length and (r[3] == length or k == 0)
            assert r[4] == zlib.crc32(np.array(ids[at:at + r[3]], "<u4").tobytes())
            at += r[3]
        assert at == len(ids) and len(mine) == -(-at // length)
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    return len(places)


@pytest.mark.parametrize("cache", [P.CACHE_WORDS, 3])
def test_ids_equal_tokenizer(tokenizer, cache):
    rnd = random.Random(cache)
    alphabet = [" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "a", "Word", "it's", "'ll", "1", "42", "é", "日本", "😀", ".", "!?", "-", "<|endoftext|>", "<|end", "x" * 70]
    docs = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \nb", "a\n b", "a\n  b", "\n \nb", "a\n ", "<|endoftext|>", "a <|endoftext|> b", "word " * 5000, "y" * 20000]
    docs += ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 14))) for _ in range(6000)]
    e = P.ByteEncoder(*P.default_vocabulary(), cache)
    got = [x for i in range(0, len(docs), 64) for x in e.batch(docs[i:i + 64])]
    for text, ids in zip(docs, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_query(spark, sf_dir, tokenizer):
    docs = {r.doc_id: r.text for r in read_table(spark, sf_dir, "documents").collect()}
    n = check([tuple(r) for r in P.op11_swap_packing(spark, sf_dir).collect()], docs, tokenizer)
    total = sum(len(plain_ids(tokenizer, t)) for t in docs.values())
    assert n <= -(-total // P.LENGTH) + 1


def test_search_empties_bins_and_raises_squares():
    rnd, better = np.random.default_rng(4), 0
    for kind in range(60):
        sizes = rnd.integers(*[(20, 101), (30, 45), (26, 50), (1, 101)][kind % 4], size=rnd.integers(1, 120))
        bins, fill = P.best_fit(sizes, 100)
        assert (np.bincount(bins, sizes, len(fill)) == fill).all() and fill.max() <= 100
        old, moved = fill.copy(), bins.copy()
        P.local_search(sizes, moved, fill, 100)
        assert (np.bincount(moved, sizes, len(fill)) == fill).all() and fill.max() <= 100
        assert (fill ** 2).sum() >= (old ** 2).sum()
        better += np.count_nonzero(fill) < len(old)
    assert better > 0


@pytest.mark.parametrize("sizes,a,want", [
    ([30, 20, 60, 50, 40], {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}, 30),       # move into the bin of 60
    ([50, 45, 47], {0: 0, 1: 1, 2: 1}, 5),                            # one for one: 50 for 45
    ([26, 25, 48, 47], {0: 0, 1: 0, 2: 1, 3: 1}, 4),                  # two for one: 26 + 25 for 47
    ([52, 24, 25, 45], {0: 0, 1: 1, 2: 1, 3: 1}, 3),                  # one for two: 52 for 24 + 25
])
def test_each_kind_of_change(sizes, a, want):
    sizes = np.array(sizes)
    bins = np.array([a[i] for i in range(len(sizes))])
    fill = np.bincount(bins, sizes).astype(np.int64)
    assert P._step(sizes, bins, fill, 0, 100)[0] == want


def test_rounds_and_edge_rows(spark, tokenizer):
    """Blocks of 20 pieces, so several rounds; NULLs, repeated rows and ids, texts of many pieces, odd columns."""
    rnd = random.Random(2)
    docs = {i: " ".join(rnd.choices(["alpha", "beta", "x1", "né"], k=rnd.randrange(0, 60))) for i in range(500)}
    docs |= {1000: None, 1001: "", 1002: "long " * 3000, 1003: "z" * 5000}
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs.items()],
                               "doc_id long, text string, block int, bin int, length int, piece_number int").repartition(4)
    rows = P.pack(P.pieces(df, length=64), 64, 20)
    first = sorted(tuple(r) for r in rows.collect())
    n = check(first, docs, tokenizer, 64)
    total = sum(r[3] for r in first)
    assert n <= 1.02 * total / 64 + 1
    same = spark.createDataFrame([(7, "a b")] * 30 + [(None, "c")] * 30 + [(None, None)] * 2, "doc_id string, text string")
    got = P.pack(P.pieces(same, length=8), 8).collect()
    assert len(got) == 62 and len({(r.sequence_id, r.offset) for r in got}) == 62
    assert P.pack(P.pieces(same.limit(0))).count() == 0


def test_sequences(spark, tokenizer):
    docs = {i: f"text number {i} " * (i % 40) for i in range(100)}
    df = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    packed = P.pack(P.pieces(df, length=50, with_ids=True), 50)
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in P.sequences(packed).collect()}
    for r in packed.collect():
        ids = plain_ids(tokenizer, docs[r.id])[r.start:r.start + r.length]
        assert whole[r.sequence_id][r.offset:r.offset + r.length].tolist() == ids
