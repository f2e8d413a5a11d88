"""Ingest, search, evaluation, streaming and the registry as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.config import EvalConfig, SearchConfig
from lodestone.errors import EngineError
from lodestone.operators import evaluation
from lodestone.plans import evaluate, ops, search, seams
from lodestone.plans.ingest import Warehouse, build_postings, ingest_paths, ingest_texts
from lodestone.streaming.ingest import watch_folder

TEXTS = "filename string, text string, format_text string, page_count int, error struct<code:string,message:string>"


def texts(spark, **files):
    return spark.createDataFrame([(f, t, None, None, None if t is not None else ("reader.parse", "broken")) for f, t in files.items()], TEXTS)


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, f"file://{tmp_path}/store")


def test_versions_and_soft_delete(spark, warehouse):
    first = ingest_texts(warehouse, texts(spark, a="Apples are red.", b="Bears are brown.", c=None), "one")
    got = {r.filename: r for r in first.documents.collect()}
    assert got["a"].status == "completed" and got["c"].status == "failed" and got["c"].error_code == "reader.parse" and got["a"].total_chunks == 1
    second = ingest_texts(warehouse, texts(spark, a="Apples are green."), "one").documents.first()
    assert (second.old_chunks, second.new_chunks) == (1, 1)
    docs = {r.filename: r for r in warehouse.read("documents").collect()}
    assert docs["a"].generation == 2 and docs["b"].generation == 1
    chunks = warehouse.read("chunks")
    assert chunks.count() == 3 and {r.text for r in schema.active(chunks).collect()} == {"Apples are green.", "Bears are brown."}
    assert warehouse.read("datasets").count() == 1 and schema.violations(warehouse.read("documents"), "dataset_id", "filename").isEmpty()


def test_resume_adds_what_is_missing(spark, warehouse):
    body = texts(spark, a="Apples are red.")
    ingest_texts(warehouse, body, "one")
    warehouse.commit("documents", warehouse.read("documents").withColumn("status", F.lit("running")))
    ingest_texts(warehouse, body, "one")
    assert warehouse.read("chunks").count() == 1
    ingest_texts(warehouse, body, "one")  # completed: the chunks are written anew
    assert warehouse.read("chunks").count() == 2 and schema.active(warehouse.read("chunks")).count() == 1


def test_failing_embedder_marks_its_documents(spark, warehouse):
    def broken(batch):
        raise RuntimeError("offline")

    report = ingest_texts(warehouse, texts(spark, a="x"), "one", embedder=broken, pause=0)
    assert report.documents.first().error_code == "ingest.persist.embed_failed" and warehouse.read("chunks").count() == 0


def test_file_without_chunks_loses_its_old_ones(spark, warehouse):
    ingest_texts(warehouse, texts(spark, a="Apples"), "one")
    ingest_texts(warehouse, texts(spark, a="  "), "one")
    assert schema.active(warehouse.read("chunks")).count() == 0


def test_search_and_answer(spark, warehouse):
    ingest_texts(warehouse, texts(spark, a="Apples are red fruit.", b="Bears are brown animals."), "one")
    ingest_texts(warehouse, texts(spark, c="Cars are fast machines."), "two")
    ids = {r["name"]: r["id"] for r in warehouse.read("datasets").collect()}
    queries = spark.createDataFrame([("1", "apples are red", [ids["one"]]), ("2", "fast machines", [ids["two"], "missing"])], "query_id string, query string, dataset_ids array<string>")
    build_postings(warehouse)
    plain = search.search(warehouse.read("chunks"), queries, SearchConfig(top_k=2))
    indexed = search.search(warehouse.read("chunks"), queries, SearchConfig(top_k=2), index=warehouse.read("postings"))
    key = lambda df: sorted((r.query_id, r.cite_id, r.filename, r.score) for r in df.collect())
    assert key(plain) == key(indexed)
    top = {r.query_id: r.filename for r in plain.filter("cite_id = 1").collect()}
    assert top == {"1": "a", "2": "c"} and plain.filter("query_id = '1' and filename = 'c'").isEmpty()
    rows = {r.query_id: r for r in search.answer(plain, queries, datasets=warehouse.read("datasets")).collect()}
    assert rows["1"].response.endswith("[1](CITE)") and rows["1"].valid and rows["1"].positions[1] > 0 and rows["2"].failed_dataset_ids == ["missing"]
    ranked = search.search(warehouse.read("chunks"), queries, SearchConfig(top_k=2, rerank_weight=1.0), reranker=lambda q, t: [float("Bears" in x) for x in t])
    assert ranked.filter("query_id = '1' and cite_id = 1").first().filename == "b"
    none = search.answer(plain.limit(0), queries).collect()
    assert {r.response for r in none} == {seams.REFUSAL}


def test_variants(spark, warehouse):
    ingest_texts(warehouse, texts(spark, a="Apples are red fruit.", b="Bears are brown animals."), "one")
    ids = [r["id"] for r in warehouse.read("datasets").collect()]
    queries = spark.createDataFrame([("1", "apples", ids, ["Apples!", "brown bears", "red", "fruit"])], "query_id string, query string, dataset_ids array<string>, candidates array<string>")
    asked = search.extended(queries, SearchConfig(), seams.HashEmbedder()).collect()
    assert asked and {r["query"] for r in asked if r["variant_idx"] == 0} == {"apples"} and "Apples!" not in {r["query"] for r in asked}
    assert search.search(warehouse.read("chunks"), queries, SearchConfig(top_k=2)).count() == 2


def test_weights_of_a_dataset(spark, warehouse):
    ingest_texts(warehouse, texts(spark, a="Apples are red fruit."), "one", dataset_settings={"rrf_k": 9, "vector_weight": 1.0, "fulltext_weight": 0.0})
    with pytest.raises(ValueError):
        ingest_texts(warehouse, texts(spark, a="x"), "two", dataset_settings={"colour": 1})
    datasets = warehouse.read("datasets")
    queries = spark.createDataFrame([("1", "apples are red", [datasets.first()["id"]])], "query_id string, query string, dataset_ids array<string>")
    asked = search.extended(queries, SearchConfig(), seams.HashEmbedder())
    chunks = warehouse.read("chunks").withColumnRenamed("id", "chunk_id")
    from lodestone.operators import fusion, retrieval

    plain = search.recall(chunks, asked, SearchConfig(), seams.HashEmbedder(), datasets=datasets)
    assert plain.count() == 1 and search.search(warehouse.read("chunks"), queries, datasets=datasets).count() == 1
    hits = spark.createDataFrame([(1, 0, 1, "a", "vector", 0.5, 1.0, 9)], "query_id int, group_idx int, pos int, chunk_id string, source string, score double, _weight double, _k int")
    assert fusion.fuse(hits, weights="_weight", k="_k").first().score == 0.1 and retrieval.QUERY_BLOCK > 0


def test_replies_and_proposals(spark):
    assert seams.structured_value({"parsed": {"variants": ["a"]}, "parsing_error": None, "raw": ""}, "variants") == (["a"], None)
    assert seams.structured_value(None)[1] and seams.structured_value({"parsed": None})[1] and seams.structured_value({"parsed": 1, "parsing_error": "x"})[1] and seams.structured_value({"a": 1}, "b")[1]

    def provider(q):
        if q == "bad":
            raise RuntimeError
        return {"variants": [q + "?", " ", 3]} if q == "dict" else ["x"] * 60

    got = {r["query"]: r.candidates for r in seams.propose_variants(spark.createDataFrame([("bad",), ("dict",), ("list",)], "query string"), provider, pause=0).collect()}
    assert got == {"bad": ["bad"], "dict": ["dict?"], "list": ["x"] * 50}


def test_requests_are_checked():
    for bad in ({"top_k": 0}, {"top_k": True}, {"vector_weight": -1.0}, {"parent_decay": 2.0}):
        with pytest.raises(EngineError):
            SearchConfig(**bad)
    with pytest.raises(EngineError):
        search.validate(" ", ["x"])


def test_metrics(spark):
    records = spark.createDataFrame([("1", ["a", "b", "b"], 2), ("2", [], 5), ("3", ["z"], None), ("4", ["a"], 0)], "query_id string, ground_truth_chunk_ids array<string>, k int")
    hits = spark.createDataFrame([("1", "x", 1), ("1", "a", 2), ("1", "b", 3), ("3", "q", 1), ("4", "a", 1)], "query_id string, chunk_id string, pos int")
    got = {(r.query_id, r.metric): r.value for r in evaluation.retrieval_metrics(records, hits).collect()}
    assert got["1", "recall@2"] == 0.5 and got["1", "precision@2"] == 0.5 and got["1", "hit_rate@2"] == 1.0 and got["1", "mrr"] == 0.5
    assert got["1", "ndcg@2"] == pytest.approx((1 / 1.584962500721156) / (1 + 1 / 1.584962500721156))
    assert got["2", "recall@5"] == 0.0 and got["3", "recall@10"] == 0.0 and got["3", "mrr"] == 0.0 and got["4", "recall@0"] == 0.0 and got["4", "mrr"] == 1.0
    summary = {r.metric: r for r in evaluation.aggregate(evaluation.retrieval_metrics(records, hits), records).collect()}
    assert summary["recall@2"]["count"] == 4 and summary["recall@2"].mean == 0.125 and summary["mrr"].median == 0.25


def test_heuristics(spark):
    row = spark.createDataFrame([("red apples", "Apples are red. Bears fly!", ["apples are red"], ["c1", "c2"], ["c1"])], "query string, answer string, contexts array<string>, retrieved_ids array<string>, ground_truth_chunk_ids array<string>").withColumn("query_id", F.lit(1))
    got = {r.metric: r.value for r in evaluation.generation_metrics(row).collect()}
    assert got == {"faithfulness": 0.5, "answer_relevance": 0.4, "context_precision": 0.5}
    assert evaluation.generation_metrics(row, backend="skip").count() == 0
    with pytest.raises(ValueError):
        evaluation.generation_metrics(row, backend="other")
    judge = spark.createDataFrame([(1, "faithfulness", 0.9), (1, "other", 1.0)], "query_id int, metric string, value double")
    assert evaluation.generation_metrics(row, backend="judge", judge=judge).count() == 1


def test_gate(spark):
    agg = spark.createDataFrame([("recall@10", 0.5), ("recall@5", 0.9), ("mrr", 0.4)], "metric string, mean double")
    gate = lambda t, **k: {(r.kind, r.metric) for r in evaluation.gate(agg, spark.createDataFrame(t, "metric_base string, min_value double"), **k).collect()}
    assert gate([("recall", 0.6), ("mrr", 0.4), ("none", 1.0)]) == {("threshold", "recall@10")}
    delta = evaluation.baseline_delta(agg, spark.createDataFrame([("mrr", 0.5), ("recall@5", 0.0)], "metric string, mean double"))
    assert [(r.metric, round(r.delta_pct, 6)) for r in delta.collect()] == [("mrr", -20.0)]
    assert gate([("mrr", 0.1)], delta=delta, max_regression=10.0) == {("regression", "mrr")} and gate([("mrr", 0.1)], delta=delta, max_regression=20.0) == set()


def test_evaluation_end_to_end(spark, warehouse, tmp_path):
    ingest_texts(warehouse, texts(spark, a="Apples are red fruit.", b="Bears are brown animals."), "one")
    dataset = warehouse.read("datasets").first()["id"]
    chunk = {r["filename"]: r["id"] for r in warehouse.read("chunks").collect()}
    lines = [json.dumps({"query": "apples are red", "dataset_ids": [dataset], "ground_truth_chunk_ids": [chunk["a"]], "k": 1}), "", "{broken", json.dumps({"query": "brown bears", "dataset_ids": [dataset], "ground_truth_chunk_ids": [chunk["b"]]})]
    (tmp_path / "eval.jsonl").write_text("\n".join(lines))
    records = evaluate.load_records(spark, f"file://{tmp_path}/eval.jsonl")
    report = evaluate.run(warehouse.read("chunks"), records, SearchConfig(top_k=2), EvalConfig(thresholds={"mrr": 1.0}))
    assert report.passed and {r.metric: r["count"] for r in report.aggregates.collect()}["mrr"] == 2
    evaluate.write_artifacts(report, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/summary").filter("metric = 'mrr'").first()["mean"] == 1.0
    assert not evaluate.evaluate(records, spark.createDataFrame([], "query_id string, chunk_id string, pos int, text string"), config=EvalConfig(thresholds={"mrr": 0.5})).passed
    assert evaluate.evaluate(records.limit(0), spark.createDataFrame([], "query_id string, chunk_id string, pos int, text string"), config=EvalConfig(thresholds={"mrr": 0.5})).passed


def test_paths_and_stream(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Apples")
    (folder / "b.md").write_text("# Bears\nbrown")
    report = ingest_paths(warehouse, [f"file://{folder}", "file:///no/such"], "files")
    assert report.documents.count() == 2 and len(report.warnings) == 1
    watch = lambda: watch_folder(spark, f"file://{folder}", warehouse, "stream", f"file://{tmp_path}/cp").awaitTermination()
    watch()
    (folder / "c.txt").write_text("Cars")
    watch()
    stream = warehouse.read("datasets").filter("name = 'stream'").first()["id"]
    assert {r.filename: r.generation for r in warehouse.read("documents").filter(F.col("dataset_id") == stream).collect()} == {"a.txt": 1, "b.md": 1, "c.txt": 1}


def test_structure_gates(spark):
    docs = spark.createDataFrame([("plain",), ("# A\n# B",), ("fail",)], "text string")

    def model(text):
        if text == "fail":
            raise RuntimeError
        return "# T\n" + text

    got = {r.text: (r.skipped, r.degraded) for r in seams.normalise_structure(docs, model, pause=0).collect()}
    assert got == {"# T\nplain": (False, False), "# A\n# B": (True, False), "fail": (False, True)}
    assert seams.normalise_structure(docs).filter("not skipped").isEmpty()


def test_cache_and_audit(spark, tmp_path):
    assert ops.search_key(["b", "a"], {"a": 1, "b": 1}, "q") != ops.search_key(["a", "b"], {"a": 2, "b": 1}, "q")
    assert ops.search_key(["b", "a"], {"a": 1}, "q") == ops.search_key(["a", "b"], {"a": 1}, "q") != ops.search_key(["a", "b"], {"a": 1}, "q", top_k=3)
    with pytest.raises(ValueError):
        ops.cache_entries(spark.range(1), "none", F.lit("k"))
    versions = spark.createDataFrame([("a", 1), ("b", 1)], "dataset_id string, version int")
    assert {r.dataset_id: r.version for r in ops.invalidate(versions, "a").collect()} == {"a": 2, "b": 1}
    results = spark.createDataFrame([("1", ["d"], "q", 1, "resp", True, [2], [])], "query_id string, dataset_ids array<string>, query string, n_citations int, response string, valid boolean, out_of_range_ids array<int>, orphan_indices array<int>")
    assert ops.write_audit(results, f"file://{tmp_path}/audit") and ops.read_audit(spark, f"file://{tmp_path}/audit").first()["query_chars"] == 1
    assert not ops.write_audit(spark.range(1), f"file://{tmp_path}/audit2")
    assert ops.doctor(spark).filter("status = 'fail'").isEmpty()



def test_scan_gets_filters_and_columns(spark, warehouse):
    ingest_texts(warehouse, texts(spark, a="Apples"), "one")
    plan = schema.active(warehouse.read("chunks")).filter("dataset_id = 'x'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(deleted_at)" in plan and "EqualTo(dataset_id,x)" in plan and "embedding" not in plan.split("ReadSchema")[1]


def test_commands(spark, tmp_path, capsys):
    from lodestone import cli

    (tmp_path / "a.txt").write_text("Apples are red fruit.")
    root = ["--warehouse", f"file://{tmp_path}/w", "--output", "json"]
    assert cli.main([*root, "ingest", f"file://{tmp_path}/a.txt", "--dataset-name", "one"], spark) == 0
    assert cli.main([*root, "datasets"], spark) == 0
    dataset = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert dataset["name"] == "one" and dataset["chunk_count"] == 1
    assert cli.main([*root, "search", "-q", "apples are red", "--dataset-id", dataset["id"], "--score-threshold", "0.1"], spark) == 0
    assert "[1](CITE)" in capsys.readouterr().out
    assert cli.main([*root, "search", "-q", " ", "--dataset-id", "x"], spark) == 1 and cli.main([*root, "datasets", "--limit", "0"], spark) == 1
    assert cli.main([*root, "doctor"], spark) == 0
