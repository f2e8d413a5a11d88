"""Ingest: files to text, chunks, vectors and stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.config import ChunkSettings
from lodestone.functions import text as X
from lodestone.operators import retrieval, store
from lodestone.operators.chunking import chunk_documents
from lodestone.plans import seams
from lodestone.sources import readers


#: Skipped files that a report names; it counts the others.
NAMED_FILES = 1000
#: Versions of a table that stay, for readers that have begun.
KEPT_VERSIONS = 3


class Warehouse:
    """The tables of one root folder. A commit writes a new version and then moves the pointer to it: one writer at a time."""

    SCHEMAS = {"datasets": schema.DATASETS, "documents": schema.DOCUMENTS, "chunks": schema.CHUNKS}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def version(self, name: str) -> int:
        """The highest version whose write was committed; 0 without one."""
        fs, folder = self._fs(f"{self.root}/{name}")
        if not fs.exists(folder):
            return 0
        done = [0]
        for status in fs.listStatus(folder):
            path = status.getPath()
            if path.getName().startswith("v") and fs.exists(self._fs(f"{path}/_SUCCESS")[1]):
                done.append(int(path.getName()[1:]))
        return max(done)

    def read(self, name: str) -> DataFrame:
        n = self.version(name)
        of = self.SCHEMAS.get(name)
        if n == 0:
            if of is None:
                raise ValueError(f"no table {name}")
            return self.spark.createDataFrame([], of)
        reader = self.spark.read.schema(of) if of is not None else self.spark.read
        return reader.parquet(f"{self.root}/{name}/v{n}")

    def commit(self, name: str, df: DataFrame, partition_by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        n = self.version(name) + 1
        writer.parquet(f"{self.root}/{name}/v{n}")
        if n > KEPT_VERSIONS:
            fs, old = self._fs(f"{self.root}/{name}/v{n - KEPT_VERSIONS}")
            fs.delete(old, True)

    def truncate(self) -> None:
        for name, of in self.SCHEMAS.items():
            self.commit(name, self.spark.createDataFrame([], of))

    def drop(self) -> None:
        fs, root = self._fs(self.root)
        fs.delete(root, True)


@dataclass
class IngestReport:
    documents: DataFrame
    warnings: list[str] = field(default_factory=list)


def ingest_texts(warehouse: Warehouse, texts: DataFrame, dataset: str, embedder: seams.Embedder | None = None, settings: ChunkSettings | None = None, embed_model: str = "hash", embed_dim: int = 64, restructure=None, mode: str = "auto", pause: float = 0.5, dataset_settings: dict | None = None) -> IngestReport:
    """``texts(filename, text, format_text, page_count, error)`` into the dataset of that name, made if it is new.

    A known filename becomes the next generation and its old chunks are deleted
    softly, unless the last run stopped half-way on the same content: then only
    missing chunks are embedded. A file whose reading or embedding failed is
    marked as failed with the code, and the others go on.
    """
    spark, now = warehouse.spark, F.current_timestamp()
    embedder = embedder or seams.HashEmbedder(embed_dim)
    datasets = store.create_datasets(warehouse.read("datasets"), spark.createDataFrame([(dataset,)], "name string"), embed_model, embed_dim, now, dataset_settings)
    warehouse.commit("datasets", datasets)
    dataset_id = store.dataset_by(warehouse.read("datasets"), "name", dataset).first()["id"]

    good = seams.normalise_structure(texts.filter("error is null"), restructure, mode, pause=pause)
    chunks = chunk_documents(good.select("filename", "page_count", "text", "format_text"), "text", "format_text", settings)
    document = store.stable_id(F.lit("document"), F.lit(dataset_id), "filename")
    # Reading and cutting run once: hashes, counts and rows to store come from the table of this run.
    warehouse.commit("chunks_cut", chunks.withColumn("dataset_id", F.lit(dataset_id)).withColumn("document_id", document))
    chunks = warehouse.read("chunks_cut")
    hashes = store.content_hash(chunks)
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("total_chunks"))
    incoming = texts.select(F.lit(dataset_id).alias("dataset_id"), "filename", "page_count", document.alias("document_id"), F.col("error.code").alias("read_error"))
    incoming = incoming.join(hashes, "document_id", "left").join(counts, "document_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))
    incoming = incoming.withColumn("content_hash", F.unhex("content_hash"))

    merged = store.upsert_documents(warehouse.read("documents"), incoming.select("dataset_id", "filename", "content_hash", "page_count", "total_chunks"), now)
    warehouse.commit("documents_running", merged)
    running = warehouse.read("documents_running")
    mine = running.filter((F.col("dataset_id") == dataset_id) & F.col("deleted_at").isNull()).join(incoming.select("filename", "read_error").distinct(), "filename")

    stale = mine.filter(~F.col("is_resume")).select(F.col("id").alias("document_id"))
    stored = warehouse.read("chunks")
    old = store.soft_delete(stored, stale, now)
    versions = mine.select(F.col("id").alias("document_id"), "generation")
    todo = store.pending_chunks(chunks.drop("document_id").join(mine.select("filename", F.col("id").alias("document_id"), "generation"), "filename"), old)
    embedded = seams.embed(todo, embedder, pause=pause)
    warehouse.commit("chunks_new", embedded)
    embedded = warehouse.read("chunks_new")
    failed = embedded.filter("embed_error is not null").select("document_id").distinct()
    fresh = store.chunk_rows(embedded.join(failed, "document_id", "left_anti"), now)
    warehouse.commit("chunks", old.unionByName(fresh))

    bad = failed.withColumn("embed_failed", F.lit(True))
    outcome = mine.select("id", "read_error").join(bad, F.col("id") == F.col("document_id"), "left")
    code = F.coalesce("read_error", F.when(F.col("embed_failed"), F.lit("ingest.persist.embed_failed")))
    outcome = outcome.select("id", F.when(code.isNull(), "completed").otherwise("failed").alias("status"), code.alias("error_code"))
    warehouse.commit("documents", store.mark_status(running.drop("is_resume"), outcome, now))
    done = warehouse.read("documents").join(versions.select(F.col("document_id").alias("id")), "id", "left_semi")
    count = lambda df, name: schema.active(df).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(name))
    done = done.join(count(stored, "old_chunks"), "id", "left").join(count(fresh, "new_chunks"), "id", "left")
    done = done.withColumn("old_chunks", F.coalesce("old_chunks", F.lit(0))).withColumn("new_chunks", F.coalesce("new_chunks", F.lit(0)))
    return IngestReport(done.select("id", "filename", "status", "error_code", "generation", "total_chunks", "old_chunks", "new_chunks"))


def ingest_paths(warehouse: Warehouse, paths: list[str], dataset: str, **options) -> IngestReport:
    """Files and folders; those that are hidden, too large or missing give a warning."""
    files, warnings = readers.list_files(warehouse.spark, paths)
    skipped = files.filter(~F.col("eligible")).select("path")
    named = skipped.orderBy("path").limit(NAMED_FILES).collect()
    more = skipped.count() - len(named)
    warnings += [f"{r[0]}: skipped" for r in named] + [f"{more} more files: skipped"] * (more > 0)
    texts = readers.read_files(files.filter("eligible"))
    report = ingest_texts(warehouse, texts, dataset, **options)
    report.warnings = warnings
    return report


def build_postings(warehouse: Warehouse) -> None:
    """The inverted index over active chunks, in order of the term, so that a query's terms prune row groups."""
    chunks = schema.active(warehouse.read("chunks"))
    index = retrieval.postings(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id", "text", ["dataset_id"])
    warehouse.commit("postings", index.repartitionByRange("term").sortWithinPartitions("term"))


def titled(texts: DataFrame) -> DataFrame:
    return texts.withColumn("title", X.title(F.col("text"), F.col("filename")))
