"""Weighted reciprocal rank fusion and reranking.

A ranked relation has one row for each hit: ``query_id``, ``pos`` (1-based
order), ``chunk_id``, ``score``, ``source``, ``score_breakdown`` and whatever else
belongs to the hit. Order is never implied: it is always in ``pos``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
#: Decimals of a fused score: sums of different order agree to these.
DECIMALS = 12


def ranked(df: DataFrame, keys: Sequence[str], *order: Column, limit: int | None = None, name: str = "pos") -> DataFrame:
    """Adds the 1-based place within ``keys``; with ``limit`` only the first rows stay (Spark prunes them before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int"))
    return out if limit is None else out.filter(F.col(name) <= limit)


def _greatest_map(a: Column, b: Column) -> Column:
    empty = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.greatest(x, y)))


def fuse(groups: DataFrame, keys: Sequence[str] = ("query_id",), weights: Sequence[float] | str | None = None, k: int | str = RRF_K, group: str = "group_idx") -> DataFrame:
    """Σ weight / (k + pos) of each chunk over its groups.

    ``groups`` holds all groups, numbered from 0 by ``group``. The first sight of
    a chunk (by group, then ``pos``) gives all other fields; its breakdown starts
    from its own map and takes the highest score of every source it was seen
    with. A chunk twice in a group counts twice. Ties go by ``chunk_id``.
    ``weights`` has one for each group (a group without raises at run time) or
    names a column that holds it, as ``k`` may.
    """
    own_columns = {c for c in (weights, k) if isinstance(c, str)}
    if isinstance(weights, str):
        weight = F.col(weights)
    elif weights is None:
        weight = F.lit(1.0)
    else:
        values = F.array(*[F.lit(float(w)) for w in weights])
        weight = F.when(F.col(group) < len(weights), F.get(values, F.col(group))).otherwise(F.raise_error(F.lit("groups and weights differ in number")).cast("double"))
    first = [c for c in groups.columns if c not in {*keys, *own_columns, "chunk_id", group, "pos", "score", "score_breakdown"}]
    has_map = "score_breakdown" in groups.columns
    own = F.col("score_breakdown") if has_map else F.create_map().cast("map<string,double>")
    rows = groups.select(*keys, "chunk_id", group, "pos", F.col("source").alias("_source"), F.col("score").alias("_score"), F.struct(*first, own.alias("_map")).alias("_first"), (weight / ((F.col(k) if isinstance(k, str) else F.lit(k)) + F.col("pos"))).alias("_part"))
    # One row for each source first: highest score, share of the sum, earliest sight.
    sight = F.struct(group, "pos")
    per_source = rows.groupBy(*keys, "chunk_id", "_source").agg(F.sum("_part").alias("_part"), F.max("_score").alias("_score"), F.min(sight).alias("_at"), F.min_by("_first", sight).alias("_first"))
    fused = per_source.groupBy(*keys, "chunk_id").agg(
        F.round(F.sum("_part"), DECIMALS).alias("score"),
        F.min_by("_first", "_at").alias("_first"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_source", "_score")))).alias("_sources"),
    )
    fused = fused.select(*keys, "chunk_id", "score", *[F.col(f"_first.{c}").alias(c) for c in first], _greatest_map(F.col("_first._map"), F.col("_sources")).alias("score_breakdown"))
    return ranked(fused, keys, F.desc("score"), F.asc("chunk_id"))


def hybrid(vector: DataFrame, fulltext: DataFrame, keys: Sequence[str] = ("query_id",), weights: tuple[float, float] = (0.7, 0.3), k: int = RRF_K) -> DataFrame:
    """Vector and full-text hits of the same keys fused; either may be empty."""
    both = vector.withColumn("group_idx", F.lit(0)).unionByName(fulltext.withColumn("group_idx", F.lit(1)), allowMissingColumns=True)
    return fuse(both, keys, weights, k)


def refuse(hits: DataFrame, level: str, keys: Sequence[str] = ("query_id",), k: int = RRF_K) -> DataFrame:
    """Ranked lists of the same query, one for each value of ``level`` (dataset or variant), fused with equal weights."""
    numbered = hits.withColumn("group_idx", (F.dense_rank().over(Window.partitionBy(*keys).orderBy(level)) - 1).cast("int"))
    return fuse(numbered.drop(level), keys, None, k)


def pseudo_scores(hits: DataFrame) -> DataFrame:
    """The scores of a reranker that changes nothing: 1 - 0.01 for each place."""
    return hits.withColumn("rerank_score", F.round(F.lit(1.0) - F.lit(0.01) * (F.col("pos") - 1), 10))


def rerank(hits: DataFrame, scores: DataFrame, weight: float = 0.5, keys: Sequence[str] = ("query_id",), k: int = RRF_K) -> DataFrame:
    """Text hits reordered by ``scores(keys, chunk_id, rerank_score)``, images fused in after them with equal weights.

    A weight of 1 or more takes the reranked order alone, 0 or less the old
    one, else both are fused by (weight, 1 - weight). Scores of unknown chunks
    are ignored; text without a score is not in the reranked list.
    """
    text = hits.filter("modality is null or modality <> 'image_caption'") if "modality" in hits.columns else hits
    images = hits.filter("modality = 'image_caption'") if "modality" in hits.columns else None
    out = text
    if weight > 0:
        scored = text.drop("rerank_score").join(scores.select(*keys, "chunk_id", "rerank_score"), [*keys, "chunk_id"])
        scored = ranked(scored.withColumn("source", F.lit("rerank")).withColumn("score", F.col("rerank_score")), keys, F.desc("rerank_score"), F.asc("pos"))
        if weight >= 1:
            out = scored
        else:
            plain = text if "rerank_score" in text.columns else text.withColumn("rerank_score", F.lit(None).cast("double"))
            both = scored.withColumn("group_idx", F.lit(0)).unionByName(plain.withColumn("group_idx", F.lit(1)), allowMissingColumns=True)
            out = fuse(both, keys, (weight, 1.0 - weight), k)
    if images is not None:
        both = out.withColumn("group_idx", F.lit(0)).unionByName(images.withColumn("group_idx", F.lit(1)), allowMissingColumns=True)
        out = fuse(both, keys, (1.0, 1.0), k)
    return out


def rerank_model(use_rerank: bool, request: str | None, dataset: Column | str | None) -> Column:
    """The model to rerank with: none if it is off, else the request's, else the dataset's."""
    if not use_rerank:
        return F.lit(None).cast("string")
    other = F.col(dataset) if isinstance(dataset, str) else dataset if dataset is not None else F.lit(None).cast("string")
    return F.coalesce(F.lit(request), other)
