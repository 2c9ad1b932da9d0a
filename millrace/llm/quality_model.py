"""Quality classifier: supervised subword embeddings.

Each word stands for itself and its character n-grams (3 to 5, with the word's ends marked), each
hashed to one of ``BUCKETS`` learned vectors. A document is the average of all its vectors, a softmax layer gives the
classes, and both are trained together by stochastic gradient descent in numpy on at most
``SAMPLE`` labelled texts per class (those that come first by the id's hash).

The score of a text is exact for its whole length: as averaging and the output layer are linear, a
word adds a fixed amount to the logit, which tasks look up by word.

Defined results: NULL and empty texts get the score of the zero vector (the output layer's bias);
without labels of both classes every score is 0.5; rows with equal text get equal scores; an id that
repeats or has labels of both classes is one text (the least) of the lower class; a score of exactly
0.5 predicts 1; texts of any length count whole; other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_sample, read_table, register, remainder, texts

BUCKETS = 1 << 15
DIMENSIONS = 12
GRAMS = (3, 4, 5)
SAMPLE = 1500
EPOCHS = 4
#: a small sample is passed over more often, for this many batches in all
LEAST_STEPS = 400
BATCH = 32
RATE = 2.0
SEED = 11
#: words whose share of the logit a task remembers
CACHE_WORDS = 1 << 18


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and its n-grams."""
    mark = b"<" + word + b">"
    grams = [mark, *(mark[i:i + n] for n in GRAMS for i in range(len(mark) - n + 1) if n < len(mark))]
    return [crc32(g) % BUCKETS for g in grams]


def document_features(text: bytes, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text; the shares add up to one. ``known``: features by word, added to."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    for w in set(words).difference(known):
        known[w] = np.array(word_features(w), np.int32)
    n = np.bincount(np.concatenate([known[w] for w in words]), minlength=BUCKETS)
    at = np.flatnonzero(n).astype(np.int32)
    return at, (n[at] / n.sum()).astype(np.float32)



class _Words:
    """What a worker process knows of words for the model in use, from task to task: a word's share
    of the logit and its number of vectors, as one complex number so that a text's sum is one sum.
    Two generations of at most ``CACHE_WORDS`` words: those used last stay."""

    def __init__(self, amounts: list[float]):
        self.amounts = amounts
        self.young: dict[bytes, complex] = {}
        self.old: dict[bytes, complex] = {}

    def learn(self, split: list[list[bytes]]) -> None:
        need = set().union(*split).difference(self.young)
        if len(self.young) + len(need) > CACHE_WORDS:
            self.old, self.young = self.young, {}
            need = set().union(*split)
        amount_of = self.amounts.__getitem__
        for w in need:
            z = self.old.get(w)
            if z is None:
                f = word_features(w)
                z = complex(sum(map(amount_of, f)), len(f))
            self.young[w] = z


_IN_USE: dict[str, _Words] = {}


class Embeddings:
    """The fitted model: a vector per bucket and the output layer."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS):
        """``rows``: (buckets, shares, label) of the sample."""
        rnd = np.random.default_rng(SEED)
        vectors = rnd.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
        found = [(at, share) for at, share, _ in rows]
        y = np.array([label for *_, label in rows], np.int64)
        batches = max(1, -(-len(rows) // BATCH))
        epochs = max(epochs, -(-LEAST_STEPS // batches))
        steps, done = epochs * batches, 0
        if len(set(y.tolist())) < 2:
            steps = epochs = 0
        for _ in range(epochs):
            order = rnd.permutation(len(rows))
            for i in range(0, len(rows), BATCH):
                pick = order[i:i + BATCH]
                x = np.zeros((len(pick), BUCKETS), np.float32)
                for k, d in enumerate(pick):
                    x[k, found[d][0]] = found[d][1]
                used = np.flatnonzero(x.any(0))
                x = x[:, used]
                hidden = x @ vectors[used]
                z = hidden @ out + bias
                z = np.exp(z - z.max(1, keepdims=True))
                err = z / z.sum(1, keepdims=True)
                err[np.arange(len(pick)), y[pick]] -= 1
                rate = RATE * (1 - done / steps)
                grad = err @ out.T
                out -= rate * (hidden.T @ err) / len(pick)
                bias -= 0.1 * rate * err.mean(0)
                # like the usual per-example updates of these vectors, not averaged over the batch
                vectors[used] -= rate * (x.T @ grad)
                done += 1
        self.amounts: list[float] = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64).tolist()
        self.bias = float(bias[1] - bias[0])
        self.name = uuid.uuid4().hex

    def scores(self, batch: list[bytes]) -> list[float]:
        """The probability of class 1 for each text."""
        if self.name not in _IN_USE:
            _IN_USE.clear()
            _IN_USE[self.name] = _Words(self.amounts)
        known, out = _IN_USE[self.name], []
        for i in range(0, len(batch), 256):
            split = [text.split() for text in batch[i:i + 256]]
            known.learn(split)
            get = known.young.__getitem__
            for words in split:
                z = sum(map(get, words), 0j)
                out.append(float(1 / (1 + np.exp(-(z.real / z.imag if z.imag else 0.0) - self.bias))))
        return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Embeddings:
    """A model from at most ``sample`` labelled texts per class; ``labels`` has id and label."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    picked = bounded_sample(marked, "label", "id", sample)
    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(picked, "id")
            .groupBy("id", "label").agg(F.min("text").alias("text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            out = [document_features(t, known) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([at.tobytes() for at, _ in out], pa.binary()),
                                              pa.array([share.tobytes() for _, share in out], pa.binary())], ["id", "label", "at", "share"])
    found = rows.select(F.col("id").cast("string").alias("id"), "label", "text").mapInArrow(counted, "id string, label int, at binary, share binary").collect()
    return Embeddings([(np.frombuffer(r.at, np.int32), np.frombuffer(r.share, np.float32), r.label) for r in sorted(found, key=lambda r: r.id)])


def score(text: Column, model: Embeddings) -> Column:
    @F.arrow_udf("double")
    def quality(col: pa.Array) -> pa.Array:
        return pa.array(model.scores(list(texts(col))), pa.float64())
    return quality(text.cast("string"))


@register("op10_subword_quality")
def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 3) != 1))
    d = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), score(F.col("text"), model).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
