"""Search over many queries in one plan: variants, recall, fusion, rerank, filters, parents, citations, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.config import SearchConfig
from lodestone.errors import SEARCH_INVALID, EngineError
from lodestone.operators import citations, filters, fusion, retrieval, variants
from lodestone.plans import ops, seams
from lodestone.session import materialise

HIT_FIELDS = ("dataset_id", "document_id", "text", "modality", "image_path", "filename", "parent_title", "chunk_index")


def validate(query: str, dataset_ids: list[str]) -> None:
    if not query or not query.strip():
        raise EngineError(SEARCH_INVALID, "the query is blank")
    if not dataset_ids:
        raise EngineError(SEARCH_INVALID, "no dataset is given")


def extended(queries: DataFrame, config: SearchConfig, embedder: seams.Embedder, pause: float = 0.5) -> DataFrame:
    """``(query_id, dataset_ids, variant_idx, query)``: the original and its chosen variants.

    ``queries`` may bring ``candidates array<string>`` from a model; without them,
    or with extension off, each query stands for itself.
    """
    base = queries.select("query_id", "dataset_ids", F.col("query").alias("original"))
    if not config.query_extension or "candidates" not in queries.columns:
        return base.select("query_id", "dataset_ids", F.lit(0).alias("variant_idx"), F.col("original").alias("query"))
    rows = queries.select("query_id", F.col("query").alias("original"), F.slice("candidates", 1, variants.CANDIDATES).alias("candidates"))
    texts = rows.select("query_id", F.posexplode(F.concat(F.array("original"), F.coalesce("candidates", F.array().cast("array<string>")))).alias("i", "text"))
    vectors = seams.embed(texts, embedder, pause=pause).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "embedding"))).alias("v"))
    got = rows.join(vectors, "query_id").select("query_id", "original", "candidates", F.get("v", F.lit(0))["embedding"].alias("original_vector"), F.transform(F.slice("v", F.lit(2), F.size("v")), lambda x: x["embedding"]).alias("candidate_vectors"))
    chosen = variants.distinct_variants(variants.select_variants(got, config.max_variants, config.select_alpha))
    return chosen.join(base.select("query_id", "dataset_ids"), "query_id").select("query_id", "dataset_ids", "variant_idx", "query")


def recall(chunks: DataFrame, asked: DataFrame, config: SearchConfig, embedder: seams.Embedder, index: DataFrame | None = None, pause: float = 0.5, datasets: DataFrame | None = None) -> DataFrame:
    """Fused hits for each query and variant and dataset, then for each query: narrow rows without texts.

    Weights and k of a dataset come from ``datasets`` where they are set there,
    else from ``config``.
    """
    keys = ["query_id", "variant_idx", "dataset_id"]
    asked = seams.embed(asked, embedder, "query", pause=pause).withColumn("part", F.concat_ws("\u0001", F.col("query_id").cast("string"), "variant_idx"))
    vector = retrieval.vector_topk_batch(chunks, asked.select(F.col("part").alias("query_id"), "embedding", "dataset_ids"), config.top_k, group="dataset_id", groups="dataset_ids")
    by_dataset = asked.select(F.col("part").alias("query_id"), "query", F.explode(F.array_distinct("dataset_ids")).alias("dataset_id"))
    terms = retrieval.query_terms(by_dataset, extra=["dataset_id"])
    full = retrieval.fulltext_topk(index, terms, config.top_k, ["dataset_id"]) if index is not None else retrieval.fulltext_topk_of(chunks, terms, config.top_k, ["dataset_id"])
    hits = vector.withColumn("source", F.lit("vector")).unionByName(full, allowMissingColumns=True)
    hits = hits.withColumnRenamed("query_id", "part").join(asked.select("part", "query_id", "variant_idx"), "part").drop("part")
    hits = hits.withColumn("group_idx", F.when(F.col("source") == "vector", 0).otherwise(1))
    is_vector = F.col("source") == "vector"
    default = F.when(is_vector, F.lit(config.vector_weight)).otherwise(F.lit(config.fulltext_weight))
    if datasets is None:
        hits = hits.withColumn("_weight", default).withColumn("_k", F.lit(config.rrf_k))
    else:
        own = datasets.select(F.col("id").alias("dataset_id"), "vector_weight", "fulltext_weight", "rrf_k")
        hits = hits.join(own, "dataset_id", "left").withColumn("_weight", F.coalesce(F.when(is_vector, F.col("vector_weight")).otherwise(F.col("fulltext_weight")), default))
        hits = hits.withColumn("_k", F.coalesce("rrf_k", F.lit(config.rrf_k))).drop("vector_weight", "fulltext_weight", "rrf_k")
    fused = fusion.fuse(hits, keys, "_weight", "_k")
    fused = fusion.refuse(fused, "dataset_id", ["query_id", "variant_idx"], config.rrf_k)
    return fusion.refuse(fused, "variant_idx", ["query_id"], config.rrf_k)


def search(chunks: DataFrame, queries: DataFrame, config: SearchConfig | None = None, embedder: seams.Embedder | None = None, reranker: seams.Reranker | None = None, index: DataFrame | None = None, pause: float = 0.5, datasets: DataFrame | None = None, provider=None, vocabulary: str | None = None) -> DataFrame:
    """Cited hits of ``queries(query_id, query, dataset_ids)``: ranked, filtered, expanded and numbered.

    Texts join last, when few rows are left. A stage without its model leaves
    the order as it is. ``provider`` proposes variants of the queries that bring
    no candidates; ``vocabulary`` is the tokenizer file of the token budget.
    """
    config, embedder = config or SearchConfig(), embedder or seams.HashEmbedder()
    if provider is not None and config.query_extension and "candidates" not in queries.columns:
        queries = seams.propose_variants(queries, provider, pause=pause)
    stored = schema.active(chunks).withColumnRenamed("id", "chunk_id")
    asked = extended(queries, config, embedder, pause)
    hits = recall(stored, asked, config, embedder, index, pause, schema.active(datasets) if datasets is not None else None)
    hits = hits.join(stored.select("chunk_id", *HIT_FIELDS), "chunk_id").withColumn("rerank_score", F.lit(None).cast("double"))
    if config.use_rerank and reranker is not None:
        scores = seams.rerank_scores(hits.join(queries.select("query_id", "query"), "query_id"), reranker)
        hits = fusion.rerank(hits, scores, config.rerank_weight)
    hits = seams.count_tokens(hits, vocabulary=vocabulary)
    hits = filters.filter_chain(hits, config.score_threshold, config.threshold_mode, config.token_budget).drop("tokens")
    if config.parent_window:
        hits = retrieval.expand_parents(hits, stored.select("chunk_id", *HIT_FIELDS), config.parent_window, config.parent_decay)
    return retrieval.cite(hits)


#: What a cached hit holds.
CACHED_FIELDS = ("query_id", "cite_id", "source_name", "chunk_id", "score", "rerank_score", "pos", *HIT_FIELDS)


def search_cached(cache: ops.Cache, chunks: DataFrame, queries: DataFrame, versions: DataFrame, config: SearchConfig | None = None, **options) -> DataFrame:
    """``search``, asking the cache first: only queries without a live entry are searched, and their hits are put there.

    A key holds the query, its datasets and their ``versions(dataset_id,
    version)``, and the settings, so that a new version of a dataset misses. A
    cache that cannot be read or written costs its gain and no result.
    """
    config = config or SearchConfig()
    of = queries.select("query_id", F.explode("dataset_ids").alias("dataset_id")).join(versions, "dataset_id", "left")
    of = of.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("dataset_id", F.coalesce("version", F.lit(0)).alias("version")))).alias("versions"))
    keyed = queries.join(of, "query_id").withColumn("cache_key", ops.key_column("search", F.col("query"), F.col("versions"), F.lit(repr(config)).alias("settings")))
    keyed = materialise(keyed, "search-keys")
    found, missed = cache.get(keyed.select("query_id", "cache_key"))
    asked = keyed.join(missed.select("query_id"), "query_id", "left_semi").drop("versions", "cache_key")
    fresh = materialise(search(chunks, asked, config, **options).select(*CACHED_FIELDS), "search-fresh")
    rows = keyed.select("query_id", "cache_key").join(missed, ["query_id", "cache_key"], "left_semi").join(fresh.groupBy("query_id").agg(F.collect_list(F.struct(*CACHED_FIELDS[1:])).alias("hits")), "query_id", "left")
    found = None if found is None else materialise(found.select("query_id", "hits"), "search-found")  # as it was before the next line
    cache.put(rows.drop("query_id"))
    return fresh if found is None else fresh.unionByName(found.select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*"))


def answer(cited: DataFrame, queries: DataFrame, writer: seams.Writer = seams.extract_answer, datasets: DataFrame | None = None) -> DataFrame:
    """One row for each query: response, citations with positions, checks, and the datasets that are missing."""
    context = retrieval.context_of(cited)
    rows = queries.select("query_id", "query", "dataset_ids").join(context, "query_id", "left")
    rows = seams.answers(rows, writer)
    lists = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cite_id", "source_name", "chunk_id", "dataset_id", "score", "rerank_score", F.col("text").alias("content"), "image_path"))).alias("citations"))
    rows = rows.join(lists, "query_id", "left").withColumn("n_citations", F.coalesce(F.size("citations"), F.lit(0)))
    rows = rows.withColumn("n_citations", F.greatest("n_citations", F.lit(0)))
    rows = citations.check(rows).withColumn("positions", citations.positions("response", F.sequence(F.lit(1), F.greatest("n_citations", F.lit(1)))))
    if datasets is not None:
        asked = queries.select("query_id", F.posexplode("dataset_ids").alias("i", "id"))
        missing = asked.join(schema.active(datasets).select("id"), "id", "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("m"))
        rows = rows.join(missing, "query_id", "left").withColumn("failed_dataset_ids", F.coalesce(F.transform("m", lambda x: x["id"]), F.array().cast("array<string>"))).drop("m")
    return rows
