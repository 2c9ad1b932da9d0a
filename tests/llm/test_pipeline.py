"""The pipeline against its stages' brute-force versions, one after the other."""

import duckdb
import pandas as pd
import pytest
from test_phrase_index import plain_hits
from test_simhash import brute_components, plain_fingerprint
from test_wavelet import expected

import __spark_entry__ as E
import corpus_pipeline as C
from millrace.llm import fair_mix, langid
from millrace.llm import simhash as S
from millrace.llm.common import read_table


def plain_pipeline(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    items = [tuple(r) for r in read_table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    model = langid.fit(langid.training_rows(docs))
    rows = {r.doc_id: r for r in docs.collect()}
    rows = {i: r for i, r in rows.items() if not model.predict(r.text)[2]}
    fps = {i: S._signed(plain_fingerprint(r.text or "")) for i, r in rows.items()}
    root, first = brute_components(fps.values()), {}
    for i, f in sorted(fps.items()):
        first.setdefault(root[f], i)
    rows = {i: rows[i] for i in first.values()}
    hit = {i for i, _, n, _ in plain_hits([(i, r.text) for i, r in rows.items()], items) if n}
    rows = {i: r for i, r in rows.items() if i not in hit}
    con = duckdb.connect()
    documents = pd.DataFrame([r.asDict() for r in rows.values()])  # noqa: F841 - read by the SQL
    con.register("documents", documents)
    copies = {i: taken // size if size else 0 for i, size, taken in
              con.execute(f"SELECT doc_id, size, taken FROM ({fair_mix.ORACLE})").fetchall()}
    return expected([(i, rows[i].text) for i in sorted(rows) for _ in range(copies[i])])


def test_run_equals_brute_force(spark, sf_dir):
    got = sorted((tuple(r) for r in C.run(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == plain_pipeline(spark, sf_dir)


def test_registered():
    assert E.queries()["pipeline"] is C.run
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in E.queries() if q.startswith("op") and q[2].isdigit()}
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "token_files"]


@pytest.mark.parametrize("stage", [name for name, _ in C.STAGES])
def test_edge_rows(spark, sf_dir, stage):
    f = dict(C.STAGES)[stage]
    rows = [(1, None, None, None, 0, 1), (2, "", "en", "a", 0, 1), (3, "12 %", "en", None, 4, 1), (None, "The words of it. " * 30, "en", "b", 9, 1),
            (4, "The words of it. " * 30, "en", "b", 9, 1), (4, "The words of it. " * 30, "en", "b", 9, 1), (5, "x" * 50_000, "fr", "b", 0, 1)]
    cols = "doc_id long, text string, lang string, source string, n_chars long, found int"
    docs = spark.createDataFrame(rows, cols)
    out = f(spark, docs, sf_dir)
    n = out.count()
    if stage != "token_files":
        assert out.columns == docs.columns
    assert n == {"language_id": 4, "near_duplicates": 4, "decontaminate": 7, "token_files": 7}.get(stage, n)
    empty = f(spark, docs.limit(0), sf_dir)
    assert empty.count() == 0 and (stage == "token_files" or empty.columns == docs.columns)
