"""What round 3's findings were about, on small tables."""

import re

import duckdb
import numpy as np
import pytest
import xxhash

from lodestone.operators import chunking, evaluation, pdf_lines, retrieval
from lodestone.plans import catalogue, seams
from lodestone.sources import readers


def _index_and_queries(spark):
    """200 chunks of the same 30 words and one or two of their own; every tenth is a query."""
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30)) + f" own{i} pair{i // 2}") for i in range(200)], "chunk_id long, text string")
    return texts, retrieval.query_terms(texts.filter("chunk_id % 10 = 0"), "text", "chunk_id")


@pytest.mark.parametrize("stored", [True, False])
def test_only_chunks_of_the_rarest_term_meet_a_query(spark, monkeypatch, stored):
    texts, queries = _index_and_queries(spark)
    tables = {}
    real = retrieval.materialise
    monkeypatch.setattr(retrieval, "materialise", lambda df, name: tables.setdefault(name, real(df, name)))
    got = retrieval.fulltext_topk(retrieval.postings(texts), queries) if stored else retrieval.fulltext_topk_of(texts, queries)
    assert sorted((r.query_id, r.chunk_id, r.pos) for r in got.collect()) == [(i, i, 1) for i in range(0, 200, 10)]
    assert tables["rarest-pairs"].count() == 20  # and not 20 queries x 200 chunks x 30 words


def test_terms_that_no_chunk_has_and_rows_of_one_query(spark):
    texts = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue"), (3, "red fox")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "red"), (1, "fox"), (2, "red absent"), (3, "")], "query_id long, query string")
    for got in (retrieval.fulltext_topk_of(texts, retrieval.query_terms(queries)), retrieval.fulltext_topk(retrieval.postings(texts), retrieval.query_terms(queries))):
        assert sorted((r.query_id, r.chunk_id, r.score) for r in got.collect()) == [(1, 1, 0.5), (1, 3, 0.5)]


def test_terms_of_a_query_are_cut_once(spark):
    plan = retrieval.query_terms(spark.createDataFrame([(1, "a b")], "query_id long, query string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2, plan  # in the words alone and in the branch of ideographs


def test_lines_that_begin_or_end_with_their_own_number(spark, tmp_path):
    text = "0 to 0\n 1 by 1 \n2 of 2.\n- 3 and 3\n  \nend\u2028"
    spark.createDataFrame([(7, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["visual_line_merge"]).fetchall()
    got = catalogue.QUERIES["visual_line_merge"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and (7, 0, "0 to 0 1 by 1 2 of 2.") in want


def test_pages_are_cleaned_where_they_lie(spark):
    pages = ["Head\r\n one\x85\rtwo.\n3\n- x\n１. y\n", None, "Head\n\n PAGE 4 \nthree\n　\n", "Head\n5 / 6", ""]
    docs = spark.createDataFrame([(1, pages), (1, ["other"]), (None, ["z."]), (2, None)], "doc_id int, pages array<string>")
    df = pdf_lines.document_text(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan  # a row holds all its pages
    got = sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    assert got == [(0, "z.\n"), (1, "one two.\n- x\n１. y\n\n\nthree\n"), (1, "other\n"), (2, "")]
    assert [pdf_lines.cleaned(["a\nb", "7"], merge=False, drop_page_numbers=False)] == ["a\nb\n\n7\n"]


def test_scores_are_held_a_few_queries_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, size=(400, 4)).astype(float)  # many ties and some zero vectors
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>").repartition(3)
    asked = rows.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    want = sorted(map(tuple, retrieval.vector_topk_batch(rows, asked, 7).collect()))
    monkeypatch.setattr(retrieval, "SCORES", 300)
    monkeypatch.setattr(retrieval, "FOUND_ROWS", 20)
    assert sorted(map(tuple, retrieval.vector_topk_batch(rows, asked, 7).collect())) == want
    n = np.linalg.norm(x, axis=1)
    best = {}
    for q in range(0, 400, 10):
        s = {i: round(float(x[q] @ x[i] / n[q] / n[i]), 6) for i in range(400) if n[q] and n[i]}
        best[q] = sorted(s, key=lambda i: (-s[i], i))[:7]
    assert {q: [c for a, c, _, p in sorted(want, key=lambda r: (r[0], r[3])) if a == q] for q in best} == best
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


def test_ground_truths_are_cut_to_what_was_retrieved(spark):
    truth = [str(i) for i in range(5000)] + ["3", None]
    records = spark.createDataFrame([(q, truth, None) for q in range(20)], "query_id int, ground_truth_chunk_ids array<string>, k int")
    found = spark.createDataFrame([(q, c, p) for q in range(20) for p, c in enumerate((3, 9999, 7), 1)], "query_id int, chunk_id int, pos int")
    df = evaluation.relevance(records, found)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert {tuple(r)[:5] for r in df.collect()} == {(q, 10, 5001, 3, 2) for q in range(20)}


def test_texts_and_pages_are_handed_on_in_small_batches(spark, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(chunking, "TEXTS", 3)
    monkeypatch.setattr(readers, "PAGES", 3)
    docs = spark.createDataFrame([(i, f"text {i}. " * 200) for i in range(20)], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.chunk_index): r.text for r in chunking.chunk_documents(docs).collect()}
    assert got == {(i, c["chunk_index"]): c["text"] for i in range(20) for c in chunking.Cutter().chunks(f"text {i}. " * 200)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    pages = spark.createDataFrame([(f"http://a/{i}.html", f"<html><p>page {i}</p>") for i in range(20)], "url string, html string").coalesce(1)
    assert {(r.url, r.text) for r in readers.read_pages(pages).collect()} == {(f"http://a/{i}.html", f"page {i}") for i in range(20)}


def test_lengths_overlaps_and_vectors_are_as_before():
    blanks = "".join(chr(i) for i in range(0x3100) if chr(i).isspace()) + "ab ​"
    assert chunking.valid_len(blanks) == len(re.sub(r"[\s　]+", "", blanks)) == 3
    cutter = chunking.Cutter()
    rung = cutter.ladder[-1]
    for part in ("x " * 450, "y" * 401 + "  ", "a　" * 500):
        solid = [i for i, c in enumerate(part) if not c.isspace()][-cutter.overlap :]
        assert cutter.repeated(part, rung) == part[solid[0] :]
    texts = ["Red fox  jumps red fox", "", None, "é" * 3]
    want = np.zeros((4, 64))
    for row, text in zip(want, texts, strict=True):
        words = (text or "").lower().split()
        for unit in (*words, *map(" ".join, zip(words, words[1:]))):
            h = xxhash.xxh3_64_intdigest(unit)
            row[h % 64] += 1.0 if h >> 63 else -1.0
        row /= np.linalg.norm(row) or 1.0
    assert seams.HashEmbedder()(texts) == want.tolist()
