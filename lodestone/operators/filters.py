"""Filters after retrieval: duplicates, thresholds and the token budget."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.fusion import ranked

TOKEN_BUDGET = 960_000


def keep_first(df: DataFrame, keys: Sequence[str | Column], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; null keys are equal."""
    return ranked(df, keys, *order, limit=1, name="_first").drop("_first")


def dedup_chunks(hits: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    return keep_first(hits, [*keys, "chunk_id"], F.asc("pos"))


def dedup_documents(hits: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """The best chunk of each document, at its own place; chunks without a document all stay."""
    part = F.col("score_breakdown")
    best = (
        F.desc(F.coalesce(F.col("rerank_score"), F.try_element_at(part, F.lit("rerank")), F.lit(-1.0))),
        F.desc(F.coalesce(F.try_element_at(part, F.lit("vector")), F.lit(-1.0))),
        F.desc("score"),
        F.asc("pos"),
    )
    lone = F.when(F.col("document_id").isNull(), F.col("chunk_id"))  # spreads the null group over its chunks
    place = F.when(F.col("document_id").isNull(), F.col("pos"))
    return keep_first(hits, [*keys, "document_id", lone, place], *best)


def dedup_answers(rows: DataFrame, keys: Sequence[str] = ("query_id",), question: str = "q", answer: str = "a") -> DataFrame:
    return keep_first(rows, [*keys, question, answer], F.asc("pos"))


def score_threshold(hits: DataFrame, threshold: float | None, mode: str = "mixed") -> DataFrame:
    """Hits at or above ``threshold``: by vector score, by the better of vector and full text, or, in mode ``fulltext``, all."""
    if mode not in ("embedding", "fulltext", "mixed"):
        raise ValueError(f"unknown mode {mode}")
    if threshold is None or mode == "fulltext":
        return hits
    of = lambda s: F.coalesce(F.try_element_at("score_breakdown", F.lit(s)), F.lit(0.0))
    value = of("vector") if mode == "embedding" else F.greatest(of("vector"), of("fulltext"))
    return hits.filter(value >= threshold)


def token_budget(hits: DataFrame, budget: int = TOKEN_BUDGET, keys: Sequence[str] = ("query_id",), cost: str = "tokens") -> DataFrame:
    """Hits in order as long as they fit; one that does not is skipped and later ones still count.

    That depends on the order in a way no window expresses, so the narrow rows
    of a query (its place and cost) stream through one task in order, which
    holds a single sum and no list. Null keys are keys like others; a null
    cost is none.
    """
    names = list(keys)
    narrow = hits.select(*names, "pos", F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("_cost")).filter(F.col("_cost") <= budget)
    narrow = narrow.repartition(*names).sortWithinPartitions(*names, "pos") if names else narrow.coalesce(1).sortWithinPartitions("pos")

    def run(batches):
        last, used = None, 0
        for b in batches:
            fits = []
            for *key, price in zip(*(b.column(i).to_pylist() for i in [*range(len(names)), len(names) + 1]), strict=True):
                if key != last:
                    last, used = key, 0
                fits.append(used + price <= budget)
                used += price * fits[-1]
            yield b.filter(pa.array(fits, pa.bool_())).drop_columns(["_cost"])

    kept = narrow.mapInArrow(run, narrow.drop("_cost").schema)
    kept = kept.select(*(F.col(c).alias(f"_{c}") for c in [*names, "pos"]))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*names, "pos"]))
    return hits.join(kept, same, "left_semi")


def filter_chain(hits: DataFrame, threshold: float | None = None, mode: str = "mixed", budget: int = TOKEN_BUDGET, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Chunks, threshold, documents, budget; places close up at the end."""
    out = dedup_chunks(hits, keys)
    out = dedup_documents(score_threshold(out, threshold, mode), keys)
    out = token_budget(out, budget, keys)
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")).cast("int"))
