"""Language ID by nearest centroid.

A text's vector: TF-IDF of hashed byte n-grams (1 to 3 bytes of the lower-cased text, everything
that is no letter as one space), of length one. Each language has up to ``CENTROIDS`` centroids,
found by spherical k-means on its training texts. The prediction is the language of the centroid
with the largest cosine. A text is rejected if that cosine is below what texts of its richness
(number of different n-grams, by powers of two) reach: a quarter of the cosine with their own language
that all but one in ``RARE`` training texts there have.

The centroids are fitted on at most ``SAMPLE`` texts per language and ``SAMPLE_ALL`` in all (those that
come first by the id's hash). Document frequencies and the cosines behind the limits are counted over
all training rows; only counts, whose number the parameters fix, come to the driver. The model goes to
the tasks as one array of fixed size.

Defined results: NULL text, empty text and text without a letter: ``und``, score 0, rejected;
without any training text everything is ``und``; ties go to the language first in code point order;
rows with equal text get equal results; texts of any length are counted whole, part by part; columns
that are not named by a parameter may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_sample, fresh, read_table, register, remainder, texts

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
CENTROIDS = 4
#: texts that the model is fitted on: at most this many per language, and in all
SAMPLE = 400
SAMPLE_ALL = 1600
ROUNDS = 8
#: rejected below this share of the cosine that all but one in RARE training texts of a level reach
SHARE = 0.25
RARE = 1000
_BINS = 1000
_LEVELS = BUCKETS.bit_length() + 1
UNKNOWN = "und"
_CHUNK = 1 << 20
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts by bucket, or None for a text without letters."""
    raw = text.lower().encode("utf-8", "replace").translate(_LETTERS)
    if not raw.strip() or not (any(97 <= b <= 122 for b in raw[:64]) or any(c.isalpha() for c in text)):
        return None
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), _CHUNK):
        a = np.frombuffer(raw[at:at + _CHUNK + max(ORDERS) - 1], np.uint8)
        keep = a != 32
        keep[1:] |= a[:-1] != 32
        code = a[keep].astype(np.uint32)
        grams, hashed = code, []
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                grams = grams[:-1] * np.uint32(256) + code[n - 1:]
            if n in ORDERS:
                hashed.append((grams * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(18))
        counts += np.bincount(np.concatenate(hashed), minlength=BUCKETS)
    return counts


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with letters in ``rows(text)``, and in how many of them each bucket occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                counts = ngram_counts(text.decode("utf-8", "replace"))
                if counts is not None:
                    seen += counts > 0
                    n += 1
        if n:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1, *at], pa.int32()), "n": pa.array([n, *seen[at]], pa.int64())})
    found = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for r in found:
        if r.bucket < 0:
            n = r.n
        else:
            seen[r.bucket] = r.n
    return n, seen


class Centroids:
    """The fitted model; without limits (``limit``) it rejects only texts without a letter."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, str]], n: int, seen: np.ndarray):
        """``rows``: (buckets, their counts, language) of the sample; ``n`` texts in all, ``seen`` by bucket."""
        self.langs, self.owner, self.least = sorted({lang for *_, lang in rows}), np.zeros(0, np.int64), np.zeros(_LEVELS)
        if not rows:
            return
        self.idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for line, (at, counts, _) in zip(x, rows):
            line[at] = np.log1p(counts)
        x *= self.idf
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        label = np.array([self.langs.index(lang) for *_, lang in rows])
        found, owner = [], []
        for k in range(len(self.langs)):
            c = self._cluster(x[label == k])
            found.append(c)
            owner += [k] * len(c)
        self.centroids, self.owner = np.concatenate(found), np.array(owner)

    def limit(self, counts: np.ndarray) -> None:
        """Set the limits from the number of training texts by level and own cosine (in bins)."""
        reached = [np.nan] * _LEVELS
        for level in range(_LEVELS):
            total = counts[level].sum()
            if total:
                reached[level] = int((np.cumsum(counts[level]) > total // RARE).argmax()) / _BINS
        for level in range(_LEVELS):   # a level without texts takes the lowest of the others
            self.least[level] = SHARE * (np.nanmin(reached) if np.isnan(reached[level]) else reached[level]) if counts.sum() else 0.0

    @staticmethod
    def _level(counts: np.ndarray) -> int:
        return int(np.count_nonzero(counts)).bit_length()

    @staticmethod
    def _cluster(x: np.ndarray) -> np.ndarray:
        rnd = np.random.default_rng(len(x))
        c = x[rnd.choice(len(x), min(CENTROIDS, len(x)), replace=False)]
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(1)
            c = np.stack([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
            c = c / np.linalg.norm(c, axis=1, keepdims=True)
        return c.astype(np.float32)

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """With each centroid."""
        at = np.flatnonzero(counts)
        v = np.log1p(counts[at]).astype(np.float32) * self.idf[at]
        return np.clip(self.centroids[:, at] @ v / np.linalg.norm(v), 0.0, 1.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected)."""
        counts = ngram_counts(text) if text else None
        if counts is None or not self.langs:
            return UNKNOWN, 0.0, True
        cosines = self.cosines(counts)
        k = int(cosines.argmax())
        best = float(cosines[k])
        return self.langs[self.owner[k]], best, bool(best < self.least[self._level(counts)])


def own_cosines(rows: DataFrame, model: Centroids) -> np.ndarray:
    """How many of ``rows(text, lang)`` are of a level and have a cosine with their own language in a bin."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((_LEVELS, _BINS + 1), np.int64)
        of = {lang: k for k, lang in enumerate(model.langs)}
        for batch in batches:
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                counts = ngram_counts(text.decode("utf-8", "replace")) if lang in of else None
                if counts is not None:
                    n[model._level(counts), int(model.cosines(counts)[model.owner == of[lang]].max() * _BINS)] += 1
        level, at = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"level": pa.array(level, pa.int32()), "bin": pa.array(at, pa.int32()), "n": pa.array(n[level, at], pa.int64())})
    out = np.zeros((_LEVELS, _BINS + 1), np.int64)
    found = rows.select("text", "lang").mapInArrow(count, "level int, bin int, n long").groupBy("level", "bin").agg(F.sum("n").alias("n"))
    for r in found.collect():
        out[r.level, r.bin] = r.n
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Centroids:
    """A model of ``docs``: centroids from at most ``sample`` rows per language, all else from all rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    langs = max(1, rows.select(F.count_distinct("lang")).first()[0])
    picked = bounded_sample(rows, "lang", "id", max(1, min(sample, SAMPLE_ALL // langs)))
    got = rows.join(picked, ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [ngram_counts(t.decode("utf-8", "replace")) for t in texts(batch.column(2))]
            keep = pa.array([x is not None for x in out])
            out = [(np.flatnonzero(x).astype("<i4"), x) for x in out if x is not None]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(keep) for k in (0, 1)), pa.array([at.tobytes() for at, _ in out], pa.binary()),
                                              pa.array([x[at].astype("<i8").tobytes() for at, x in out], pa.binary())], ["id", "lang", "at", "n"])
    found = got.select(F.col("id").cast("string").alias("id"), "lang", "text").mapInArrow(counted, "id string, lang string, at binary, n binary").collect()
    n, seen = document_frequencies(rows)
    model = Centroids([(np.frombuffer(r.at, "<i4"), np.frombuffer(r.n, "<i8"), r.lang) for r in sorted(found, key=lambda r: (r.lang, r.id))], n, seen)
    if model.langs:
        model.limit(own_cosines(rows, model))
    return model


def classify(text: Column, model: Centroids) -> Column:
    """Struct (lang, score, rejected) of a text column."""
    @F.arrow_udf("lang string, score double, rejected boolean")
    def nearest_centroid(col: pa.Array) -> pa.Array:
        found = [model.predict(x.as_py()) for x in col]
        lang, score, rejected = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                          names=["lang", "score", "rejected"])
    return nearest_centroid(text.cast("string"))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(remainder(id_col, 5) != 0)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the language ID does not reject, as they are; it learns from their training rows."""
    model = fit(training_rows(docs, id_col), id_col, text_col, lang_col)
    found = fresh(docs, "found")
    return docs.withColumn(found, classify(F.col(text_col), model)).where(~F.col(found)["rejected"]).drop(found)


@register("op7_centroid_langid")
def op7_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; ``rejected`` tells texts that are far from every centroid."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    d = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), classify(F.col("text"), model).alias("found"))
    return d.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")
