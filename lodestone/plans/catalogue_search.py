"""Retrieval, fusion, filters and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import citations, filters, fusion, retrieval, variants


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return list(_vectors(spark, sf_dir).filter(F.col("chunk_id") == vec_id).first()["embedding"])


def vector_topk(spark, sf_dir):
    return retrieval.vector_topk(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select("chunk_id", "score", "pos")


def _batch(spark, sf_dir, k: int = 10, every: int = 100) -> DataFrame:
    """The vectors whose id ``every`` divides, against all."""
    vectors = _vectors(spark, sf_dir)
    return retrieval.vector_topk_batch(vectors, vectors.filter(F.col("chunk_id") % every == 0).withColumnRenamed("chunk_id", "query_id"), k)


def vector_topk_batch(spark, sf_dir):
    return _batch(spark, sf_dir)


def _texts(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _fulltext(spark, sf_dir) -> DataFrame:
    """The whole texts of the documents whose id 100 divides, against all."""
    texts = _texts(spark, sf_dir)
    return retrieval.fulltext_topk_of(texts, retrieval.query_terms(texts.filter("chunk_id % 100 = 0"), "text", "chunk_id"))


def fulltext_and_topk(spark, sf_dir):
    return _fulltext(spark, sf_dir).select("query_id", "chunk_id", "score", "pos")


def postings(spark, sf_dir):
    return retrieval.postings(_texts(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("uses"))


def _hybrid(spark, sf_dir) -> DataFrame:
    vector = _batch(spark, sf_dir).withColumn("source", F.lit("vector")).select("query_id", "chunk_id", "score", "pos", "source")
    return fusion.hybrid(vector, _fulltext(spark, sf_dir).select("query_id", "chunk_id", "score", "pos", "source"))


def hybrid_wrrf(spark, sf_dir):
    """Vector and full-text hits fused, without repeated chunks, above a threshold, numbered as citations."""
    hits = filters.score_threshold(filters.dedup_chunks(_hybrid(spark, sf_dir)), 0.1)
    part = lambda s: F.try_element_at("score_breakdown", F.lit(s))
    return retrieval.cite(hits).select("cite_id", "source_name", "query_id", "chunk_id", F.round("score", 9).alias("score"), "source", part("vector").alias("vector_score"), part("fulltext").alias("fulltext_score"))


def score_threshold_mixed(spark, sf_dir):
    return filters.score_threshold(_hybrid(spark, sf_dir), 0.5).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


def wrrf_multi_variant(spark, sf_dir):
    """Each query vector, and itself without every second component as its variant, fused over variants."""
    v = _vectors(spark, sf_dir)
    asked = v.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id").select("query_id", "embedding")
    half = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(0.0).cast("float")))
    asked = asked.unionByName(asked.select((F.col("query_id") + 1).alias("query_id"), half.alias("embedding")))
    hits = retrieval.vector_topk_batch(v, asked, 10).withColumn("variant_idx", (F.col("query_id") % 100).cast("int")).withColumn("query_id", F.col("query_id") - F.col("query_id") % 100)
    fused = fusion.refuse(hits.withColumn("source", F.lit("vector")), "variant_idx")
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "pos", F.try_element_at("score_breakdown", F.lit("vector")).alias("vector_score"))


def _hits(spark, sf_dir) -> DataFrame:
    """Vector hits with the label as document; label 9 has none."""
    labels = _vectors(spark, sf_dir).select("chunk_id", F.when(F.col("label") < 9, F.col("label")).alias("document_id"))
    hits = _batch(spark, sf_dir, 20).join(labels, "chunk_id")
    return hits.withColumn("source", F.lit("vector")).withColumn("score_breakdown", F.create_map(F.lit("vector"), F.col("score"))).withColumn("rerank_score", F.when(F.col("chunk_id") % 3 == 0, (F.col("chunk_id") % 7) / 10))


def rerank_refuse(spark, sf_dir):
    hits = _hits(spark, sf_dir).drop("rerank_score")
    scores = hits.filter("chunk_id % 3 <> 0").select("query_id", "chunk_id", ((F.col("chunk_id") % 11) / 10).alias("rerank_score"))
    return fusion.rerank(hits, scores, 0.7).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "pos", "source")


def noop_rerank(spark, sf_dir):
    return fusion.pseudo_scores(_batch(spark, sf_dir)).select("query_id", "chunk_id", "rerank_score")


def dedup_chunk(spark, sf_dir):
    hits = _batch(spark, sf_dir, 10)
    twice = hits.unionByName(hits.withColumn("pos", F.col("pos") + 5))
    return filters.dedup_chunks(twice).select("query_id", "chunk_id", "pos")


def dedup_document(spark, sf_dir):
    return filters.dedup_documents(_hits(spark, sf_dir)).select("query_id", "chunk_id", F.coalesce("document_id", F.lit(-1)).alias("document_id"), "pos")


def dedup_qa(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("role").alias("q"), F.col("text").alias("a"))
    return filters.dedup_answers(rows)


def token_budget(spark, sf_dir):
    """The documents of each language and source, in order, under 20,000 estimated tokens."""
    docs = _read(spark, sf_dir, "documents").select(F.concat("lang", "source").alias("query_id"), "doc_id", F.ceil(F.length("text") / 4).alias("tokens"))
    hits = fusion.ranked(docs, ["query_id"], F.asc("doc_id"))
    return filters.token_budget(hits, 20_000).select("query_id", "doc_id", "pos")


def _sections(spark, sf_dir) -> DataFrame:
    """Documents as chunks: language as dataset, source as title, order of the ids as index."""
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("dataset_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("parent_title"), F.lit("text").alias("modality"))
    return fusion.ranked(rows, ["dataset_id", "parent_title"], F.asc("chunk_id"), name="n").withColumn("chunk_index", F.col("n") - 1).drop("n")


def sibling_slice(spark, sf_dir):
    chunks = _sections(spark, sf_dir)
    return retrieval.siblings(chunks, chunks.filter("chunk_id % 100 = 0"), 2).select("chunk_id", F.col("sibling.chunk_id").alias("sibling_id"), F.col("sibling.chunk_index").alias("sibling_index"))


def parent_window(spark, sf_dir):
    chunks = _sections(spark, sf_dir)
    hits = chunks.filter("chunk_id % 100 = 0").withColumn("query_id", F.col("chunk_id") % 3).withColumn("score", 1.0 / (F.col("chunk_id") + 1)).withColumn("score_breakdown", F.create_map(F.lit("vector"), F.col("score")))
    hits = fusion.ranked(hits, ["query_id"], F.asc("chunk_id"))
    return retrieval.expand_parents(hits, chunks, 2).select("query_id", "chunk_id", F.coalesce("document_id", F.lit(-1)).alias("document_id"), F.round("score", 9).alias("score"), "pos")


def cite_numbering(spark, sf_dir):
    return retrieval.cite(_batch(spark, sf_dir)).select("query_id", "chunk_id", "cite_id", "source_name")


def context_text(spark, sf_dir):
    hits = _batch(spark, sf_dir, 3).join(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id", "left")
    return retrieval.context_of(retrieval.cite(hits))


def _answers(spark, sf_dir) -> DataFrame:
    n = lambda m: F.concat(F.lit("["), (F.col("doc_id") % m).cast("string"), F.lit("](CITE)"))
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat("text", n(7), F.lit(" and "), n(3), n(7)).alias("response"), (F.col("doc_id") % 5).alias("n_citations"))


def cite_parse(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", F.posexplode(citations.markers("response")).alias("at", "cite_id"))


def cite_check(spark, sf_dir):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return citations.check(_answers(spark, sf_dir)).select("doc_id", joined("referenced_ids"), joined("referenced_unique"), joined("out_of_range_ids"), joined("orphan_indices"), "valid")


def cite_positions(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    found = citations.positions("response", F.sequence(F.lit(0), F.lit(6)))
    return rows.select("doc_id", F.explode(found).alias("cite_id", "position"))


def variant_dedup(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("original"))
    rows = rows.withColumn("variants", F.array(F.concat("original", F.lit("!")), F.concat("original", F.lit("?")), F.reverse("original")))
    return variants.distinct_variants(rows)


def submodular_select(spark, sf_dir):
    """Each hundredth vector as a query, the ten nearest of all the others as its candidates."""
    v = _vectors(spark, sf_dir)
    asked = v.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("of"), F.col("embedding").alias("original_vector"))
    near = _batch(spark, sf_dir, 11).withColumnRenamed("query_id", "of").filter("chunk_id <> of").join(v, "chunk_id")
    near = near.groupBy("of").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "embedding"))), 1, 10).alias("l"))
    rows = asked.join(near, "of", "left")
    rows = rows.select(F.floor(F.col("of") / 100).alias("query_id"), F.col("of").cast("string").alias("original"), F.transform("l", lambda x: x["chunk_id"].cast("string")).alias("candidates"), "original_vector", F.transform("l", lambda x: x["embedding"]).alias("candidate_vectors"))
    return variants.select_variants(rows).select("query_id", "original", F.array_join("variants", ",").alias("variants"))


QUERIES = {f.__name__: f for f in (
    hybrid_wrrf, vector_topk, vector_topk_batch, fulltext_and_topk, postings, score_threshold_mixed, wrrf_multi_variant, rerank_refuse, noop_rerank, dedup_chunk, dedup_document, dedup_qa,
    token_budget, sibling_slice, parent_window, cite_numbering, context_text, cite_parse, cite_check, cite_positions, variant_dedup, submodular_select,
)}

_COS = "round(list_cosine_similarity(b.embedding::double[], a.embedding::double[]), 6)"
_TERMS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
#: Top hits of each hundredth vector.
_BATCH = f"""
  select query_id, chunk_id, score, pos from (
    select a.vec_id as query_id, b.vec_id as chunk_id, {_COS} as score,
      cast(row_number() over (partition by a.vec_id order by {_COS} desc, b.vec_id) as int) as pos
    from embeddings a, embeddings b where a.vec_id % 100 = 0)
  where pos <= """
_VECTOR = f"""vector as (
  select b.vec_id as chunk_id, {_COS} as score, cast(row_number() over (order by {_COS} desc, b.vec_id) as int) as pos
  from embeddings a, embeddings b where a.vec_id = 0 qualify pos <= 10)"""
_INDEX = f"index as (select doc_id as chunk_id, term, cast(count(*) as int) as tf from (select doc_id, unnest({_TERMS}) as term from documents) group by all)"


_FULLTEXT = f"""{_INDEX},
asked as (select chunk_id as query_id, term, count(*) over (partition by chunk_id) as n from index where chunk_id % 100 = 0),
fulltext as (
  select query_id, index.chunk_id, round(sum(index.tf / (index.tf + 1.0)) / max(n), 6) as score
  from index join asked using (term) group by query_id, index.chunk_id having count(*) = max(n)),
top as (select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as pos from fulltext qualify pos <= 10)"""


_HYBRID = f"""vector as ({_BATCH} 10), {_FULLTEXT},
fused as (
  select query_id, chunk_id, round(sum(w / (60 + pos)), 12) as score, max(case when s = 'vector' then score end) as vector_score,
    max(case when s = 'fulltext' then score end) as fulltext_score, max(s) as source
  from (select query_id, chunk_id, score, pos, 0.7 as w, 'vector' as s from vector union all select query_id, chunk_id, score, pos, 0.3, 'fulltext' from top)
  group by query_id, chunk_id)"""

_HITS = f"""hits as (
  select h.*, case when label < 9 then label end as document_id, case when chunk_id % 3 = 0 then (chunk_id % 7) / 10.0 end as rerank_score
  from ({_BATCH} 20) h join embeddings on chunk_id = vec_id)"""

_SECTIONS = "sections as (select doc_id as chunk_id, lang, source, cast(row_number() over (partition by lang, source order by doc_id) - 1 as int) as i from documents)"
_ANSWERS = "answers as (select doc_id, text || '[' || doc_id % 7 || '](CITE) and [' || doc_id % 3 || '](CITE)[' || doc_id % 7 || '](CITE)' as response, doc_id % 5 as n from documents)"

ORACLE_SQL = {
    "vector_topk": f"with {_VECTOR} select chunk_id, score, pos from vector",
    "vector_topk_batch": f"{_BATCH} 10",
    "fulltext_and_topk": f"with {_FULLTEXT} select query_id, chunk_id, score, pos from top",
    "postings": f"with {_INDEX} select term, count(*) as chunks, sum(tf)::bigint as uses from index group by term",
    "hybrid_wrrf": f"""with {_HYBRID}
        select query_id, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as cite_id, 'src-' || row_number() over (partition by query_id order by score desc, chunk_id) as source_name, chunk_id, round(score, 9) as score, source, vector_score, fulltext_score
        from fused where greatest(coalesce(vector_score, 0), coalesce(fulltext_score, 0)) >= 0.1""",
    "score_threshold_mixed": f"with {_HYBRID} select query_id, chunk_id, round(score, 9) as score from fused where greatest(coalesce(vector_score, 0), coalesce(fulltext_score, 0)) >= 0.5",
    "wrrf_multi_variant": f"""with q as (
        select vec_id, 0 as variant, embedding from embeddings where vec_id % 100 = 0
        union all select vec_id, 1, list_transform(embedding, lambda x, i: case when i % 2 = 1 then x else 0::float end) from embeddings where vec_id % 100 = 0),
        v as (
        select a.vec_id as query_id, b.vec_id as chunk_id, {_COS} as score, row_number() over (partition by a.vec_id, a.variant order by {_COS} desc, b.vec_id) as p
        from q a, embeddings b qualify p <= 10),
        f as (select query_id, chunk_id, round(sum(1.0 / (60 + p)), 12) as s, max(score) as vector_score from v group by all)
        select query_id, chunk_id, round(s, 9) as score, cast(row_number() over (partition by query_id order by s desc, chunk_id) as int) as pos, vector_score from f""",
    "rerank_refuse": f"""with {_HITS},
        r as (select query_id, chunk_id, row_number() over (partition by query_id order by (chunk_id % 11) / 10.0 desc, pos) as p from hits where chunk_id % 3 <> 0),
        f as (select query_id, chunk_id, round(sum(w / (60 + p)), 12) as s, max(src) as source from
          (select query_id, chunk_id, p, cast(0.7 as double) as w, 'rerank' as src from r union all select query_id, chunk_id, pos, 1.0 - cast(0.7 as double), 'vector' from hits) group by all),
        g as (select query_id, chunk_id, s, case when chunk_id % 3 <> 0 then 'rerank' else 'vector' end as source from (select query_id, chunk_id, round(sum(s), 12) as s from f group by all))
        select query_id, chunk_id, round(s, 9) as score, cast(row_number() over (partition by query_id order by s desc, chunk_id) as int) as pos, source from g""",
    "noop_rerank": f"select query_id, chunk_id, round(1.0 - cast(0.01 as double) * (pos - 1), 10) as rerank_score from ({_BATCH} 10)",
    "dedup_chunk": f"with h as ({_BATCH} 10) select query_id, chunk_id, min(pos) as pos from (select * from h union all select query_id, chunk_id, score, pos + 5 from h) group by query_id, chunk_id",
    "dedup_document": f"""with {_HITS}
        select query_id, chunk_id, coalesce(document_id, -1) as document_id, pos from hits
        qualify document_id is null or row_number() over (partition by query_id, document_id order by coalesce(rerank_score, -1) desc, score desc, pos) = 1""",
    "dedup_qa": "select conv_id as query_id, turn as pos, role as q, text as a from conversations qualify row_number() over (partition by conv_id, role, text order by turn) = 1",
    "token_budget": """with recursive d as (
        select lang || source as query_id, doc_id, cast(ceil(length(text) / 4) as bigint) as cost, cast(row_number() over (partition by lang || source order by doc_id) as int) as pos from documents),
        r as (
          select query_id, doc_id, pos, case when cost <= 20000 then cost else 0 end as used, cost <= 20000 as kept from d where pos = 1
          union all
          select d.query_id, d.doc_id, d.pos, case when r.used + d.cost <= 20000 then r.used + d.cost else r.used end, r.used + d.cost <= 20000 from r join d on d.query_id = r.query_id and d.pos = r.pos + 1)
        select query_id, doc_id, pos from r where kept""",
    "sibling_slice": f"with {_SECTIONS} select h.chunk_id, s.chunk_id as sibling_id, s.i as sibling_index from sections h join sections s on h.lang = s.lang and h.source = s.source and s.i between greatest(0, h.i - 2) and h.i + 2 where h.chunk_id % 100 = 0",
    "parent_window": f"""with {_SECTIONS}, h as (select *, chunk_id % 3 as query_id, row_number() over (partition by chunk_id % 3 order by chunk_id) as hp from sections where chunk_id % 100 = 0),
        x as (select h.query_id, s.chunk_id, h.hp, s.i, s.chunk_id = h.chunk_id as own, case when s.chunk_id = h.chunk_id then 1.0 else 0.5 end * (cast(1 as double) / (h.chunk_id + 1)) as score
          from h join sections s on h.lang = s.lang and h.source = s.source and s.i between h.i - 2 and h.i + 2),
        f as (select * from x qualify row_number() over (partition by query_id, chunk_id order by hp, i, not own) = 1)
        select query_id, chunk_id, case when own then chunk_id else -1 end as document_id, round(score, 9) as score, cast(row_number() over (partition by query_id order by hp, i, not own) as int) as pos from f""",
    "cite_numbering": f"select query_id, chunk_id, pos as cite_id, 'src-' || pos as source_name from ({_BATCH} 10)",
    "context_text": f"""with h as ({_BATCH} 3) select query_id, string_agg('[' || pos || '] ' || coalesce(text, ''), chr(10) || chr(10) order by pos) as context from h left join documents on chunk_id = doc_id group by query_id""",
    "cite_parse": rf"with {_ANSWERS} select doc_id, generate_subscripts(l, 1)::int - 1 as at, unnest(l)::bigint as cite_id from (select doc_id, regexp_extract_all(response, '\[(\d+)\]\(CITE\)', 1) as l from answers)",
    "cite_check": rf"""with {_ANSWERS}, a as (select doc_id, n, list_transform(regexp_extract_all(response, '\[(\d+)\]\(CITE\)', 1), lambda x: x::bigint) as l from answers),
        b as (select *, list_filter(l, lambda x: x < 1 or x > n) as bad, list_sort(list_distinct(l)) as u, list_transform(list_filter(range(1, n + 1), lambda i: not list_contains(l, i)), lambda i: i - 1) as orphans from a)
        select doc_id, array_to_string(l, ',') as referenced_ids, array_to_string(u, ',') as referenced_unique, array_to_string(bad, ',') as out_of_range_ids, array_to_string(orphans, ',') as orphan_indices, len(bad) = 0 as valid from b""",
    "cite_positions": f"with {_ANSWERS} select doc_id, cast(i as int) as cite_id, cast(strpos(response, '[' || i || '](CITE)') - 1 as int) as position from answers, range(0, 7) t(i) where strpos(response, '[' || i || '](CITE)') > 0",
    "variant_dedup": r"""with q as (select conv_id || '-' || turn as query_id, text as o from conversations where role = 'user'),
        v as (select query_id, unnest([o, o || '!', o || '?', reverse(o)]) as query, unnest([0, 1, 2, 3]) as i from q),
        f as (select * from v qualify row_number() over (partition by query_id, lower(regexp_replace(query, '[^\p{L}\p{N}_]+', '', 'g')) order by i) = 1)
        select query_id, cast(row_number() over (partition by query_id order by i) - 1 as int) as variant_idx, query from f""",
}
