"""A training corpus from ``documents``: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. A stage works on all rows that the one before it kept, through the operator's
production parameters. ``run`` writes every stage's rows into the shared folder and reads them back,
so a lost executor costs no more than tasks of the stage it worked on.

Defined results: an empty table passes through all stages; rows with NULL text or no letter are
rejected by the language ID; rows with NULL ids are kept by the same rules as others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import fair_mix, langid, phrase_index, simhash, wavelet
from millrace.llm.common import materialize, prepare, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are far from every language's centroids."""
    prepare(spark)
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash."""
    prepare(spark)
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return phrase_index.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return fair_mix.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode into wavelet matrix files; start, length and checksum of every document, read from them."""
    prepare(spark)
    # the worker processes also serve the other stages: little memory for words
    return wavelet.encode_corpus(docs, cache_words=1 << 16).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("token_files", token_files)]

#: XXH64 votes, nearest centroids and subword ids have no SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
