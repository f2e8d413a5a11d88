"""Versioned, soft-deletable tables: upsert, resume, soft delete, listings.

Tables are immutable files: an operation takes frames and returns the new ones,
which the caller writes (one writer at a time). ``plans.ingest`` does so.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import DATASET_MISSING, EngineError
from lodestone.operators.fusion import ranked
from lodestone.schema import DATASET_DEFAULTS, active


def stable_id(*parts: Column | str) -> Column:
    """A UUID-shaped id that depends on the parts alone, so that a rerun gives the same."""
    h = F.md5(F.concat_ws("\u0001", *parts).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def content_hash(chunks: DataFrame, keys: tuple[str, ...] = ("document_id",), index: str = "chunk_index", text: str = "text") -> DataFrame:
    """SHA-256 over the texts in order, each with a NUL behind it."""
    rows = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("l"))
    whole = F.array_join(F.transform("l", lambda x: F.concat(x["t"], F.lit("\u0000"))), "")
    return rows.select(*keys, F.sha2(F.encode(whole, "utf-8"), 256).alias("content_hash"))


def create_datasets(datasets: DataFrame, names: DataFrame, embed_model: str, embed_dim: int, now: Column, settings: Mapping[str, object] | None = None) -> DataFrame:
    """Existing datasets and those of ``names(name)`` that no active one has, with defaults where ``settings`` has no value."""
    if unknown := set(settings or ()) - {*DATASET_DEFAULTS, "rerank_model", "system_prompt"}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    wanted = names.filter("name is not null and trim(name) <> ''").select("name").distinct().join(active(datasets).select("name"), "name", "left_anti")
    values: Mapping[str, Column] = {
        "id": stable_id(F.lit("dataset"), "name"),
        "name": F.col("name"),
        "embed_model": F.lit(embed_model),
        "embed_dim": F.lit(embed_dim),
        **{c: F.lit(v) for c, v in {**DATASET_DEFAULTS, **(settings or {})}.items()},
        "created_at": now,
        "updated_at": now,
    }
    new = wanted.select(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in datasets.schema])
    return datasets.unionByName(new)


def require_datasets(datasets: DataFrame, ids: list[str]) -> list[str]:
    """The ids of ``ids`` that no active dataset has, in order."""
    known = {r[0] for r in active(datasets).filter(F.col("id").isin(*ids)).select("id").collect()} if ids else set()
    return [i for i in ids if i not in known]


def dataset_by(datasets: DataFrame, column: str, value: str, include_deleted: bool = False) -> DataFrame:
    if column not in ("id", "name"):
        raise EngineError(DATASET_MISSING, f"datasets are found by id or name, not by {column}")
    return active(datasets, include_deleted).filter(F.col(column) == value)


def list_datasets(datasets: DataFrame, documents: DataFrame, name_like: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Active datasets with their active documents' chunks, newest first. ``name_like`` may hold SQL wildcards."""
    totals = active(documents).groupBy(F.col("dataset_id").alias("id")).agg(F.sum("total_chunks").alias("chunk_count"))
    rows = active(datasets)
    if name_like:
        rows = rows.filter(F.col("name").like(f"%{name_like}%"))
    out = rows.join(totals, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    out = out.orderBy(F.desc("created_at"), F.asc("id"))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def active_documents(documents: DataFrame) -> DataFrame:
    """The active row of highest generation for each dataset and filename."""
    return ranked(active(documents), ["dataset_id", "filename"], F.desc("generation"), F.asc("id"), limit=1, name="_n").drop("_n")


def documents_of(documents: DataFrame, dataset_id: str) -> DataFrame:
    return active(documents).filter(F.col("dataset_id") == dataset_id).orderBy(F.desc("created_at"), F.asc("id"))


def upsert_documents(documents: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """``incoming(dataset_id, filename, content_hash, page_count, total_chunks)`` into ``documents``.

    An active row of the name becomes running, one generation up, its error
    cleared; other names get a new row of generation 1. Rows of other names,
    and deleted ones, stay as they are. A name twice among the incoming counts
    once. ``is_resume`` marks names whose active row was still running with the
    same content: their chunks are kept.
    """
    new = ranked(incoming, ["dataset_id", "filename"], F.asc("content_hash"), limit=1, name="_n").drop("_n")
    new = new.select("dataset_id", "filename", F.col("content_hash").alias("_hash"), F.col("page_count").alias("_pages"), F.col("total_chunks").alias("_chunks"), F.lit(True).alias("_in"))
    current = active_documents(documents).select("id", F.lit(True).alias("_active"))
    rows = documents.withColumn("is_resume", F.lit(False)).join(current, "id", "left")
    kept = rows.filter("_active is null").drop("_active")
    merged = rows.filter("_active").drop("_active").join(new, ["dataset_id", "filename"], "full_outer")
    changed = F.col("_in").isNotNull()
    fresh = F.col("id").isNull()
    resume = changed & ~fresh & (F.col("status") == "running") & F.col("content_hash").eqNullSafe(F.col("_hash"))
    values = {
        "id": F.coalesce("id", stable_id(F.lit("document"), "dataset_id", "filename")),
        "content_hash": F.when(changed, F.col("_hash")).otherwise(F.col("content_hash")),
        "modality": F.coalesce("modality", F.lit("text")),
        "page_count": F.when(changed, F.col("_pages")).otherwise(F.col("page_count")),
        "total_chunks": F.when(changed, F.col("_chunks")).otherwise(F.col("total_chunks")),
        "status": F.when(changed, F.lit("running")).otherwise(F.col("status")),
        "generation": F.when(fresh, F.lit(1)).otherwise(F.col("generation") + changed.cast("int")),
        "error_code": F.when(~changed, F.col("error_code")),
        "last_processed_at": F.when(changed, now).otherwise(F.col("last_processed_at")),
        "created_at": F.coalesce("created_at", now),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
        "is_resume": resume,
    }
    merged = merged.select(*[(values.get(f.name, F.col(f.name))).cast(f.dataType).alias(f.name) for f in documents.schema], values["is_resume"].alias("is_resume"))
    return kept.select(*merged.columns).unionByName(merged)


def mark_status(documents: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Status and error code of the ids in ``outcomes(id, status, error_code)``; the others stay."""
    new = outcomes.select("id", F.col("status").alias("_s"), F.col("error_code").alias("_e"))
    rows = documents.join(new, "id", "left")
    hit = F.col("_s").isNotNull()
    return rows.select(
        *[
            F.when(hit, {"status": F.col("_s"), "error_code": F.col("_e"), "updated_at": now}[c]).otherwise(F.col(c)).alias(c) if c in ("status", "error_code", "updated_at") else F.col(c)
            for c in documents.columns
        ]
    )


def existing_indexes(chunks: DataFrame, document_id: str) -> DataFrame:
    return active(chunks).filter(F.col("document_id") == document_id).select("chunk_index").distinct()


def pending_chunks(incoming: DataFrame, chunks: DataFrame) -> DataFrame:
    """Incoming chunks whose document has no active chunk of that index."""
    return incoming.join(active(chunks).select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti")


def soft_delete(df: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Active rows that match a row of ``keys`` on its columns are marked as deleted at ``now``."""
    names = keys.columns
    hit = keys.select(*names).distinct().withColumn("_hit", F.lit(True))
    out = df.join(hit, names, "left")
    gone = F.col("_hit").isNotNull() & F.col("deleted_at").isNull()
    return out.select(*[F.when(gone, now).otherwise(F.col(c)).alias(c) if c == "deleted_at" else F.col(c) for c in df.columns])


def count_by_dataset(chunks: DataFrame) -> DataFrame:
    return active(chunks).groupBy("dataset_id").agg(F.count("*").alias("chunk_count"))


def chunk_rows(chunks: DataFrame, now: Column) -> DataFrame:
    """Stored rows from (dataset_id, document_id, filename, chunk_index, text, heading_stack, embedding)."""
    return chunks.select(
        stable_id(F.lit("chunk"), "document_id", F.col("generation").cast("string"), F.col("chunk_index").cast("string")).alias("id"),
        "dataset_id",
        "document_id",
        "text",
        F.lit("text").alias("modality"),
        F.lit(None).cast("string").alias("image_path"),
        F.coalesce(F.get("heading_stack", F.lit(0)), F.lit("")).alias("parent_title"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "filename",
        F.col("embedding").cast("array<float>").alias("embedding"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def backfill_documents(documents: DataFrame, chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Documents for the active chunks' (dataset, filename) pairs that have none, and chunks that point to them.

    Chunk counts of the documents follow. Chunks without a filename stay as
    they are.
    """
    named = active(chunks).filter("filename is not null")
    missing = named.select("dataset_id", "filename").distinct().join(active(documents), ["dataset_id", "filename"], "left_anti")
    values = {
        "id": stable_id(F.lit("document"), "dataset_id", "filename"), "dataset_id": F.col("dataset_id"), "filename": F.col("filename"), "modality": F.lit("text"),
        "total_chunks": F.lit(0), "status": F.lit("completed"), "generation": F.lit(1), "created_at": now, "updated_at": now,
    }
    new = missing.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in documents.schema])
    every = documents.unionByName(new)
    ids = active_documents(every).select("dataset_id", "filename", F.col("id").alias("_doc"))
    linked = chunks.join(ids, ["dataset_id", "filename"], "left")
    linked = linked.select(*[F.coalesce(F.when(F.col("deleted_at").isNull(), F.coalesce("document_id", "_doc")), F.col("document_id")).alias(c) if c == "document_id" else F.col(c) for c in chunks.columns])
    counts = active(linked).groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("_n"))
    every = every.join(counts, "id", "left").select(*[F.coalesce("_n", "total_chunks").alias(c) if c == "total_chunks" else F.col(c) for c in documents.columns])
    return every, linked
