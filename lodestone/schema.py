"""Schemas of the stored tables, of ranked hits and of evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _table(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


DATASETS = _table(
    "id string, name string, embed_model string, embed_dim int, chunk_size int, rerank_model string, rrf_k int, vector_weight double, fulltext_weight double, "
    "query_select_alpha double, prompt_template string, system_prompt string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
DOCUMENTS = _table(
    "id string, dataset_id string, filename string, content_hash binary, modality string, page_count int, total_chunks int, status string, generation int, "
    "error_code string, last_processed_at timestamp, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
CHUNKS = _table(
    "id string, dataset_id string, document_id string, text string, modality string, image_path string, parent_title string, chunk_index int, filename string, "
    "embedding array<float>, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
EVAL_RECORDS = _table(
    "query string, dataset_ids array<string>, ground_truth_chunk_ids array<string>, k int, reference_answer string, reference_contexts array<string>, metadata map<string,string>"
)

DATASET_DEFAULTS = {"chunk_size": 1000, "rrf_k": 60, "vector_weight": 0.7, "fulltext_weight": 0.3, "query_select_alpha": 0.3, "prompt_template": ""}
STATUSES = ("pending", "running", "completed", "failed")
SOURCES = ("vector", "fulltext", "caption", "rerank")
MODALITIES = ("text", "image_caption")


def active(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Rows that are not soft-deleted; the predicate reaches the Parquet scan."""
    return df if include_deleted else df.filter("deleted_at is null")


def violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once among active rows: a commit needs this to be empty."""
    return active(df).groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
