"""Whole pipelines and request logs."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from lodestone.config import SearchConfig
from lodestone.plans import evaluate, ingest, ops, search
from lodestone.plans.catalogue_search import _read
from lodestone.session import shared_dir


def _stored(spark, sf_dir):
    """A warehouse with all documents, whole, as two datasets."""
    root = f"{shared_dir(spark).rstrip('/')}/warehouse-{uuid.uuid4().hex}"
    warehouse = ingest.Warehouse(spark, root)
    atexit.register(_drop, warehouse)
    texts = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("item-"), "doc_id", F.lit(".txt")).alias("filename"), "text", F.lit(None).cast("string").alias("format_text"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("struct<code:string,message:string>").alias("error"))
    for name, parity in (("even", 0), ("odd", 1)):
        ingest.ingest_texts(warehouse, texts.filter(F.col("doc_id") % 2 == parity).drop("doc_id"), name)
    return warehouse


def _drop(warehouse) -> None:
    try:
        warehouse.drop()
    except Exception:  # the session has ended: nothing is left to remove it with
        pass


def _asked(warehouse, spark, sf_dir):
    """The whole texts of the documents whose id 100 divides, asked of both datasets."""
    ids = [r["id"] for r in warehouse.read("datasets").orderBy("id").collect()]
    queries = _read(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    return queries.withColumn("dataset_ids", F.array(*map(F.lit, ids)))


def ingest_pipeline(spark, sf_dir):
    """Stored documents and their chunks."""
    warehouse = _stored(spark, sf_dir)
    return warehouse.read("documents").select("filename", "status", "generation", "total_chunks")


def search_pipeline(spark, sf_dir):
    """Whole texts as queries over both datasets, with parents and citations."""
    warehouse = _stored(spark, sf_dir)
    cited = search.search(warehouse.read("chunks"), _asked(warehouse, spark, sf_dir), SearchConfig(top_k=5, parent_window=1))
    return cited.select("query_id", "cite_id", "filename", "chunk_index", F.round("score", 9).alias("score"))


def eval_pipeline(spark, sf_dir):
    """Each text that is asked must find its own chunks."""
    warehouse = _stored(spark, sf_dir)
    chunks = warehouse.read("chunks")
    truth = chunks.select(F.regexp_extract("filename", r"\d+", 0).alias("query_id"), "id").groupBy("query_id").agg(F.collect_list("id").alias("ground_truth_chunk_ids"))
    records = _asked(warehouse, spark, sf_dir).join(truth, "query_id").withColumn("k", F.lit(5))
    report = evaluate.run(chunks, records, SearchConfig(top_k=5))
    return report.aggregates.select("metric", F.round("mean", 6).alias("mean"), "count")


def audit_rollup(spark, sf_dir):
    """Requests by type and day."""
    events = _read(spark, sf_dir, "events")
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users"))


def cache_entries(spark, sf_dir):
    """Entries of a layer that have not expired at a given time."""
    events = _read(spark, sf_dir, "events").select("event_id", "ts")
    key = F.concat(F.lit("search:"), F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 32))
    entries = ops.cache_entries(events, "search", key, F.col("ts"))
    return ops.live_entries(entries, None, F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id", "cache_key")


QUERIES = {f.__name__: f for f in (ingest_pipeline, search_pipeline, eval_pipeline, audit_rollup, cache_entries)}

ORACLE_SQL = {
    "audit_rollup": "select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(sum(value), 2) as total, count(distinct user_id) as users from events group by 1, 2",
    "cache_entries": "select event_id, 'search:' || substr(sha256(event_id::varchar), 1, 32) as cache_key from events where epoch(ts)::bigint + 300 > epoch(timestamp '2024-01-10 00:00:00')",
}
