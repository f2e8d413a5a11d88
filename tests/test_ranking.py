"""Fusion, reranking, filters, parents and citations on small lists."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import citations, filters, fusion, retrieval, variants

SCHEMA = "query_id int, group_idx int, pos int, chunk_id string, document_id string, source string, modality string, score double, rerank_score double, score_breakdown map<string,double>"


def hits(spark, *rows):
    full = []
    for r in rows:
        r = {"query_id": 1, "group_idx": 0, "pos": 1, "document_id": None, "source": "vector", "modality": "text", "score": 0.5, "rerank_score": None, "score_breakdown": {}} | r
        full.append(tuple(r[c.split(" ")[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(full, SCHEMA)


def order(df):
    return [r.chunk_id for r in df.orderBy("query_id", "pos").collect()]


def test_single_hit(spark):
    r = fusion.fuse(hits(spark, {"chunk_id": "1"})).first()
    assert r.score == pytest.approx(1 / 61) and r.pos == 1 and r.score_breakdown == {"vector": 0.5}


def test_contributions_add_and_first_sight_wins(spark):
    df = hits(
        spark,
        {"chunk_id": "1", "pos": 2, "score": 0.4, "document_id": "a", "score_breakdown": {"caption": 0.1, "vector": 0.9}},
        {"chunk_id": "2", "pos": 1},
        {"chunk_id": "1", "group_idx": 1, "pos": 1, "source": "fulltext", "score": 0.7, "document_id": "b", "score_breakdown": {"rerank": 1.0}},
        {"chunk_id": "1", "group_idx": 1, "pos": 3, "source": "fulltext", "score": 0.8},
    )
    r = {x.chunk_id: x for x in fusion.fuse(df, weights=(0.7, 0.3)).collect()}
    assert r["1"].score == pytest.approx(0.7 / 62 + 0.3 / 61 + 0.3 / 63, abs=1e-11)
    assert r["1"].document_id == "a" and r["1"].source == "vector"
    assert r["1"].score_breakdown == {"caption": 0.1, "vector": 0.9, "fulltext": 0.8}


def test_zero_weight_stays_and_ties_go_by_id(spark):
    df = hits(spark, {"chunk_id": "b"}, {"chunk_id": "a", "group_idx": 1})
    assert order(fusion.fuse(df)) == ["a", "b"]
    r = fusion.fuse(df, weights=(1.0, 0.0))
    assert order(r) == ["b", "a"] and r.filter("chunk_id = 'a'").first().score == 0.0


def test_weights_must_match(spark):
    with pytest.raises(Exception, match="differ in number"):
        fusion.fuse(hits(spark, {"chunk_id": "a"}, {"chunk_id": "b", "group_idx": 1}), weights=(1.0,)).collect()


def test_empty(spark):
    assert fusion.fuse(hits(spark, {"chunk_id": "a"}).limit(0)).count() == 0


@pytest.mark.parametrize(("weight", "expected"), [(0.0, ["a", "b", "c"]), (1.0, ["c", "b"]), (0.9, ["c", "b", "a"])])
def test_rerank_weights(spark, weight, expected):
    df = hits(spark, *({"chunk_id": c, "pos": i + 1} for i, c in enumerate("abc"))).drop("group_idx")
    scores = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.8), (1, "zz", 1.0)], "query_id int, chunk_id string, rerank_score double")
    assert order(fusion.rerank(df, scores, weight)) == expected


def test_rerank_leaves_images(spark):
    df = hits(spark, {"chunk_id": "a"}, {"chunk_id": "i", "pos": 2, "modality": "image_caption"}, {"chunk_id": "b", "pos": 3}).drop("group_idx")
    scores = spark.createDataFrame([(1, "b", 0.9), (1, "a", 0.1)], "query_id int, chunk_id string, rerank_score double")
    assert set(order(fusion.rerank(df, scores, 1.0))) == {"a", "b", "i"}


@pytest.mark.parametrize(("mode", "kept"), [("embedding", ["a"]), ("fulltext", ["a", "b", "c"]), ("mixed", ["a", "b"])])
def test_threshold_modes(spark, mode, kept):
    df = hits(spark, {"chunk_id": "a", "score_breakdown": {"vector": 0.5}}, {"chunk_id": "b", "pos": 2, "score_breakdown": {"fulltext": 0.6}}, {"chunk_id": "c", "pos": 3})
    assert order(filters.score_threshold(df, 0.5, mode)) == kept


def test_documents_keep_the_best_at_its_place(spark):
    df = hits(
        spark,
        {"chunk_id": "a", "document_id": "1", "rerank_score": 0.2},
        {"chunk_id": "b", "pos": 2, "document_id": "2", "rerank_score": 0.8},
        {"chunk_id": "c", "pos": 3, "document_id": "1", "rerank_score": 0.9},
        {"chunk_id": "d", "pos": 4, "document_id": "2", "rerank_score": 0.1},
        {"chunk_id": "e", "pos": 5},
        {"chunk_id": "f", "pos": 6},
    )
    assert order(filters.dedup_documents(df)) == ["b", "c", "e", "f"]


@pytest.mark.parametrize(("budget", "kept"), [(10, ["a", "c"]), (0, []), (100, ["a", "b", "c"]), (1, ["c"])])
def test_budget_skips_and_goes_on(spark, budget, kept):
    df = hits(spark, {"chunk_id": "a"}, {"chunk_id": "b", "pos": 2}, {"chunk_id": "c", "pos": 3}).withColumn("tokens", F.when(F.col("chunk_id") == "a", 6).when(F.col("chunk_id") == "b", 8).otherwise(1))
    assert order(filters.token_budget(df, budget)) == kept


def test_answers_dedup_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, 1, None, "x"), (1, 2, None, "x"), (1, 3, "q", None), (1, 4, "q", None)], "query_id int, pos int, q string, a string")
    assert [r.pos for r in filters.dedup_answers(df).orderBy("pos").collect()] == [1, 3]


def test_parents(spark):
    rows = [(f"c{i}", "d", "doc", f"t{i}", "text", None, "f", "# T" if i < 6 else "", i) for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, dataset_id string, document_id string, text string, modality string, image_path string, filename string, parent_title string, chunk_index int")
    found = chunks.filter("chunk_id in ('c0', 'c2', 'c7')").withColumn("query_id", F.lit(1)).withColumn("score", F.lit(0.8)).withColumn("score_breakdown", F.create_map(F.lit("vector"), F.lit(0.8)))
    found = fusion.ranked(found, ["query_id"], F.asc("chunk_index"))
    out = retrieval.expand_parents(found, chunks, 1).orderBy("pos").collect()
    assert [r.chunk_id for r in out] == ["c0", "c1", "c2", "c3", "c7"]
    assert [r.score for r in out] == [0.8, 0.4, 0.8, 0.4, 0.8]
    assert out[1].document_id is None and out[1].score_breakdown is None and out[2].document_id == "doc"
    assert retrieval.expand_parents(found, chunks, 0) is found


def test_citations(spark):
    df = spark.createDataFrame([(1, "a [1](CITE) b [3](CITE)[1](CITE) [01](CITE) [9](CITE)", 4), (2, "none", 2), (3, "[99999999999999999999](CITE)", 0)], "query_id int, response string, n_citations int")
    r = {x.query_id: x for x in citations.check(df).collect()}
    assert r[1].referenced_ids == [1, 3, 1, 1, 9] and r[1].referenced_unique == [1, 3, 9] and r[1].out_of_range_ids == [9] and r[1].orphan_indices == [1, 3] and not r[1].valid
    assert r[2].valid and r[2].orphan_indices == [0, 1] and r[3].referenced_ids == []
    at = df.filter("query_id = 1").select(citations.positions("response", F.sequence(F.lit(1), F.lit(4))).alias("p")).first().p
    assert at == {1: 2, 3: 14}


def test_greedy_selection():
    assert variants.select_greedy([[0.95, 0.31], [0.5, 0.866], [0.0, 1.0]], [1.0, 0.0], 2, 0.3) == [0, 2]


def test_variant_fallbacks(spark):
    schema = "query_id int, original string, candidates array<string>, original_vector array<double>, candidate_vectors array<array<double>>"
    rows = [(1, "q", ["a", "b"], [1.0], [[1.0], [1.0]]), (2, "q", ["a", "b", "c", "d"], None, None), (3, "q", None, None, None)]
    got = {r.query_id: r.variants for r in variants.select_variants(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ["a", "b"], 2: ["a", "b", "c"], 3: ["q"]}
    same = spark.createDataFrame([(1, "Ab c!", ["ab C", "x", "X?", "ÉTÉ", "été"])], "query_id int, original string, variants array<string>")
    assert [r["query"] for r in variants.distinct_variants(same).orderBy("variant_idx").collect()] == ["Ab c!", "x", "ÉTÉ"]


def test_batch_topk_matches_single(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(5)
    asked = chunks.filter("chunk_id in (3, 50, 300)").withColumnRenamed("chunk_id", "query_id")
    got = retrieval.vector_topk_batch(chunks, asked, 7, block=2)
    for q in (3, 50):
        one = retrieval.vector_topk(chunks, rows[q][1], 7)
        key = lambda df: [(r.chunk_id, r.pos) for r in df.orderBy("pos").collect()]
        assert key(got.filter(f"query_id = {q}")) == key(one)
    assert got.filter("query_id = 300").count() == 0


def test_fulltext_needs_every_term(spark):
    chunks = spark.createDataFrame([("a", "red fox"), ("b", "red red fox 狐狸"), ("c", "red")], "chunk_id string, text string")
    terms = retrieval.query_terms(spark.createDataFrame([(1, "Fox RED"), (2, "狐狸"), (3, "blue red")], "query_id int, query string"))
    got = {}
    for r in retrieval.fulltext_topk(retrieval.postings(chunks), terms).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: ["b", "a"], 2: ["b"]}
