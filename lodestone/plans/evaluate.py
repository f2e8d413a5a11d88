"""Evaluation: records against search results, metrics, aggregates, deltas and the gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.config import EvalConfig, SearchConfig
from lodestone.operators import evaluation
from lodestone.plans import search, seams
from lodestone.session import materialise
from lodestone.sources.readers import read_json_lines


@dataclass
class EvalReport:
    per_query: DataFrame
    aggregates: DataFrame
    delta: DataFrame | None
    failures: DataFrame

    @property
    def passed(self) -> bool:
        return self.failures.isEmpty()


def load_records(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json_lines(spark, path, schema.EVAL_RECORDS).filter("query is not null and trim(query) <> ''")
    return rows.withColumn("query_id", F.xxhash64("query", F.to_json("dataset_ids")).cast("string"))


def evaluate(records: DataFrame, hits: DataFrame, responses: DataFrame | None = None, config: EvalConfig | None = None, baseline: DataFrame | None = None, judge: DataFrame | None = None) -> EvalReport:
    """``records`` as loaded, ``hits(query_id, chunk_id, pos, text)``, ``responses(query_id, response)``.

    Metrics in long form; a record without one counts as 0 in the aggregate. No
    record at all passes the gate.
    """
    config = config or EvalConfig()
    values = evaluation.retrieval_metrics(records, hits, config.metrics, config.default_k)
    if responses is not None and config.backend != "skip":
        lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("chunk_id").cast("string").alias("c"), F.coalesce("text", F.lit("")).alias("t")))).alias("l"))
        samples = records.join(responses.select("query_id", F.col("response").alias("answer")), "query_id").join(lists, "query_id", "left")
        empty = F.array().cast("array<string>")
        samples = samples.select(
            "query_id", "query", "answer", F.coalesce(F.transform("l", lambda x: x["t"]), empty).alias("contexts"), F.coalesce(F.transform("l", lambda x: x["c"]), empty).alias("retrieved_ids"), F.coalesce("ground_truth_chunk_ids", empty).alias("ground_truth_chunk_ids")
        )
        values = values.unionByName(evaluation.generation_metrics(samples, config.generation_metrics, config.backend, judge))
    aggregates = evaluation.aggregate(values, records)
    delta = evaluation.baseline_delta(aggregates, baseline) if baseline is not None else None
    thresholds = records.sparkSession.createDataFrame([(k, float(v)) for k, v in config.thresholds.items()], "metric_base string, min_value double")
    return EvalReport(values, aggregates, delta, evaluation.gate(aggregates, thresholds, delta, config.max_regression))


def run(chunks: DataFrame, records: DataFrame, search_config: SearchConfig | None = None, config: EvalConfig | None = None, embedder: seams.Embedder | None = None, writer: seams.Writer = seams.extract_answer, **options) -> EvalReport:
    """Searches for every record in one plan and evaluates the hits and answers."""
    queries = records.select("query_id", "query", "dataset_ids")
    hits = materialise(search.search(chunks, queries, search_config, embedder), "eval-hits")
    responses = search.answer(hits, queries, writer).select("query_id", "response")
    return evaluate(records, hits, responses, config, **options)


def write_artifacts(report: EvalReport, path: str) -> None:
    """Per-query metrics as JSON lines, and a summary."""
    report.per_query.write.mode("overwrite").json(f"{path}/per_query")
    report.aggregates.withColumn("passed", F.lit(report.passed)).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
