"""The catalogue of datasets, documents and chunks; customers, orders and line items stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.operators import store
from lodestone.plans.catalogue_search import _read

_NOW = "2024-01-01 00:00:00"
_SINCE = "1990-01-01 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


def _datasets(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "customer")
    values = {"id": F.col("c_custkey").cast("string"), "name": F.col("c_name"), "chunk_size": F.lit(1000), "created_at": F.expr(f"timestamp'{_SINCE}' + make_interval(0, 0, 0, cast(c_nationkey as int))"), "deleted_at": F.when(F.col("c_acctbal") < 0, _now())}
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.DATASETS])


def _documents(spark, sf_dir) -> DataFrame:
    """A customer's orders: priority as filename, key as generation; finished ones are deleted."""
    rows = _read(spark, sf_dir, "orders")
    values = {
        "id": F.col("o_orderkey").cast("string"), "dataset_id": F.col("o_custkey").cast("string"), "filename": F.col("o_orderpriority"), "content_hash": F.md5(F.col("o_orderstatus").cast("binary")).cast("binary"), "modality": F.lit("text"),
        "total_chunks": F.floor("o_totalprice"), "status": F.when(F.col("o_orderkey") % 2 == 0, "running").otherwise("completed"), "generation": F.col("o_orderkey"), "created_at": F.col("o_orderdate"), "updated_at": F.col("o_orderdate"),
        "deleted_at": F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")),
    }
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.DOCUMENTS])


def _chunks(spark, sf_dir) -> DataFrame:
    """Line items by order and line; of repeated ones the cheapest."""
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("price"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line"))
    values = {
        "id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "dataset_id": F.col("flag"), "document_id": F.col("l_orderkey").cast("string"), "text": F.col("price").cast("string"), "modality": F.lit("text"), "parent_title": F.lit(""),
        "chunk_index": F.col("l_linenumber"), "filename": F.concat(F.lit("f"), (F.col("l_orderkey") % 50).cast("string")), "deleted_at": F.when(F.col("line") == "O", _now()),
    }
    return rows.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CHUNKS])


def soft_delete_scan(spark, sf_dir):
    return schema.active(_documents(spark, sf_dir)).select("id", "dataset_id", "filename")


def dataset_listing(spark, sf_dir):
    return store.list_datasets(_datasets(spark, sf_dir), _documents(spark, sf_dir), "1", 20, 5).select("id", "name", "chunk_count")


def dataset_by_name(spark, sf_dir):
    return store.dataset_by(_datasets(spark, sf_dir), "name", "Customer#000000001").select("id", "name")


def create_datasets(spark, sf_dir):
    names = _read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(" set"))).alias("name"))
    made = store.create_datasets(_datasets(spark, sf_dir), names, "hash", 64, _now())
    return schema.active(made).select("id", "name", "embed_model", F.coalesce("rrf_k", F.lit(-1)).alias("rrf_k"))


def active_document(spark, sf_dir):
    return store.active_documents(_documents(spark, sf_dir)).select("id", "dataset_id", "filename", "generation")


def documents_by_dataset(spark, sf_dir):
    return store.documents_of(_documents(spark, sf_dir), "1").select("id", "filename", "status")


def existing_indexes(spark, sf_dir):
    return store.existing_indexes(_chunks(spark, sf_dir), "1")


def count_by_dataset(spark, sf_dir):
    return store.count_by_dataset(_chunks(spark, sf_dir))


def pending_chunks(spark, sf_dir):
    incoming = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), (F.col("l_linenumber") + F.col("l_orderkey") % 2).cast("int").alias("chunk_index")).distinct()
    return store.pending_chunks(incoming, _chunks(spark, sf_dir))


def document_upsert(spark, sf_dir):
    incoming = _read(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 3).cast("string").alias("dataset_id"), F.col("o_orderpriority").alias("filename"), F.md5(F.col("o_orderstatus").cast("binary")).cast("binary").alias("content_hash"), F.lit(None).cast("int").alias("page_count"), F.lit(3).alias("total_chunks"))
    merged = store.upsert_documents(_documents(spark, sf_dir), incoming, _now())
    return merged.select("id", "dataset_id", "filename", "status", "generation", "total_chunks", "is_resume")


def mark_status(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    outcomes = docs.filter(F.col("generation") % 5 == 0).select("id", F.lit("failed").alias("status"), F.lit("reader.parse").alias("error_code"))
    return store.mark_status(docs, outcomes, _now()).select("id", "status", "error_code")


def soft_delete(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    keys = chunks.filter("chunk_index = 1").select("document_id")
    return store.soft_delete(chunks, keys, _now()).groupBy("dataset_id").agg(F.count("deleted_at").alias("deleted"), F.count("*").alias("n"))


def backfill_documents(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).withColumn("document_id", F.lit(None).cast("string"))
    existing = _documents(spark, sf_dir).limit(0)
    documents, linked = store.backfill_documents(existing, chunks, _now())
    links = linked.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("linked"))
    return documents.join(links, "id").select("id", "dataset_id", "filename", "total_chunks", "linked")


def key_violations(spark, sf_dir):
    return schema.violations(_documents(spark, sf_dir), "dataset_id", "filename")


def content_hash(spark, sf_dir):
    lines = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return store.content_hash(lines)


QUERIES = {f.__name__: f for f in (
    soft_delete_scan, dataset_listing, dataset_by_name, create_datasets, active_document, documents_by_dataset, existing_indexes, count_by_dataset, pending_chunks, document_upsert, mark_status, soft_delete, backfill_documents, key_violations, content_hash,
)}

_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_DOCS = "docs as (select o_orderkey::varchar as id, o_custkey::varchar as dataset_id, o_orderpriority as filename, o_orderkey as generation, o_orderstatus as s, o_orderstatus = 'F' as gone, floor(o_totalprice)::bigint as total_chunks, o_orderdate from orders)"
_ITEMS = "items as (select l_orderkey, l_linenumber, min(l_returnflag) as flag, min(l_linestatus) = 'O' as gone from lineitem group by 1, 2)"

ORACLE_SQL = {
    "soft_delete_scan": f"with {_DOCS} select id, dataset_id, filename from docs where not gone",
    "dataset_listing": f"""with {_DOCS}, t as (select dataset_id, sum(total_chunks)::bigint as n from docs where not gone group by 1)
        select c_custkey::varchar as id, c_name as name, coalesce(n, 0)::bigint as chunk_count from customer left join t on dataset_id = c_custkey::varchar
        where c_acctbal >= 0 and c_name like '%1%' order by c_nationkey desc, c_custkey::varchar limit 20 offset 5""",
    "dataset_by_name": "select c_custkey::varchar as id, c_name as name from customer where c_name = 'Customer#000000001' and c_acctbal >= 0",
    "create_datasets": f"""with old as (select c_custkey::varchar as id, c_name as name from customer where c_acctbal >= 0),
        new as (select distinct case when c_custkey % 2 = 0 then c_name else c_mktsegment || ' set' end as name from customer)
        select id, name, null::varchar as embed_model, -1 as rrf_k from old
        union all select {_UUID}, name, 'hash', 60 from (select name, md5('dataset' || chr(1) || name) as h from new where name not in (select name from old))""",
    "active_document": f"with {_DOCS} select id, dataset_id, filename, generation::int as generation from docs where not gone qualify row_number() over (partition by dataset_id, filename order by generation desc) = 1",
    "documents_by_dataset": f"with {_DOCS} select id, filename, case when generation % 2 = 0 then 'running' else 'completed' end as status from docs where not gone and dataset_id = '1'",
    "existing_indexes": f"with {_ITEMS} select distinct l_linenumber as chunk_index from items where l_orderkey = 1 and not gone",
    "count_by_dataset": f"with {_ITEMS} select flag as dataset_id, count(*) as chunk_count from items where not gone group by 1",
    "pending_chunks": f"""with {_ITEMS} select distinct l_orderkey::varchar as document_id, (l_linenumber + l_orderkey % 2)::int as chunk_index from lineitem l
        where not exists (select 1 from items i where not gone and i.l_orderkey = l.l_orderkey and i.l_linenumber = l.l_linenumber + l.l_orderkey % 2)""",
    "document_upsert": f"""with {_DOCS}, a as (select *, row_number() over (partition by dataset_id, filename, gone order by generation desc) = 1 and not gone as top from docs),
        i as (select (o_custkey + o_orderkey % 3)::varchar as dataset_id, o_orderpriority as filename, min(md5(o_orderstatus)) as hash from orders group by 1, 2),
        x as (select a.*, i.hash from a left join i on a.top and a.dataset_id = i.dataset_id and a.filename = i.filename)
        select id, dataset_id, filename, case when hash is not null or generation % 2 = 0 then 'running' else 'completed' end as status, (generation + (hash is not null)::int)::int as generation,
          (case when hash is not null then 3 else total_chunks end)::int as total_chunks, coalesce(hash = md5(s) and generation % 2 = 0, false) as is_resume from x
        union all
        select {_UUID}, dataset_id, filename, 'running', 1, 3, false from (select *, md5('document' || chr(1) || dataset_id || chr(1) || filename) as h from i
          where not exists (select 1 from a where top and a.dataset_id = i.dataset_id and a.filename = i.filename))""",
    "mark_status": f"with {_DOCS} select id, case when generation % 5 = 0 then 'failed' when generation % 2 = 0 then 'running' else 'completed' end as status, case when generation % 5 = 0 then 'reader.parse' end as error_code from docs",
    "soft_delete": f"with {_ITEMS} select flag as dataset_id, count(*) filter (gone or l_orderkey in (select l_orderkey from items where l_linenumber = 1)) as deleted, count(*) as n from items group by 1",
    "backfill_documents": f"""with {_ITEMS}, n as (select flag, 'f' || l_orderkey % 50 as filename, count(*) as c from items where not gone group by 1, 2)
        select {_UUID} as id, flag as dataset_id, filename, c::int as total_chunks, c as linked from (select *, md5('document' || chr(1) || flag || chr(1) || filename) as h from n)""",
    "key_violations": f"with {_DOCS} select dataset_id, filename, count(*) as rows from docs where not gone group by 1, 2 having count(*) > 1",
    "content_hash": "select doc_id as document_id, sha256(array_to_string(string_split(text, chr(10)), chr(0)) || chr(0)) as content_hash from documents",
}
