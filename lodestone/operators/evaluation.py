"""Retrieval metrics, heuristic generation metrics, aggregation and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.fusion import ranked
from lodestone.session import materialise

#: Retrieved rows up to which they are broadcast to the ground truths.
BROADCAST_ROWS = 1_000_000


def relevance(records: DataFrame, retrieved: DataFrame, default_k: int = 10) -> DataFrame:
    """One row for each record with what the metrics need.

    ``records``: query_id, ground_truth_chunk_ids, k (nullable); ``retrieved``:
    query_id, chunk_id, pos. Repeated retrieved ids count each time, repeated
    ids of the ground truth once.
    """
    own = records.select("query_id", F.coalesce("k", F.lit(default_k)).alias("k"), F.coalesce("ground_truth_chunk_ids", F.array().cast("array<string>")).alias("gt"))
    # Ground truths may be long: they are counted, and cut to what was retrieved, before anything is shuffled.
    truth = own.select("query_id", "k", F.size(F.array_distinct("gt")).alias("n_truth"))
    found = materialise(retrieved.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "pos"), "retrieved")
    pairs = found.select("query_id", "chunk_id").distinct()
    pairs = F.broadcast(pairs) if found.count() <= BROADCAST_ROWS else pairs
    gt = own.select("query_id", F.explode("gt").alias("chunk_id")).join(pairs, ["query_id", "chunk_id"], "left_semi").distinct().withColumn("relevant", F.lit(True))
    marked = found.join(gt, ["query_id", "chunk_id"], "left")
    marked = marked.join(truth.select("query_id", "k"), "query_id")
    within = F.col("pos") <= F.col("k")
    hit = F.coalesce("relevant", F.lit(False))
    per_query = marked.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.sum((hit & within).cast("int")).alias("hits"),
        F.min(F.when(hit, F.col("pos"))).alias("first_hit"),
        F.sum(F.when(hit & within, 1.0 / F.log2(F.col("pos") + 1.0))).alias("dcg"),
    )
    return truth.join(per_query, "query_id", "left").select(
        "query_id", "k", "n_truth", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"), "first_hit", F.coalesce("dcg", F.lit(0.0)).alias("dcg")
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _ideal() -> Column:
    size = F.least("k", "n_truth")
    return F.when(size > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))).otherwise(F.lit(0.0))


def metric_columns() -> dict[str, Column]:
    """Metrics over the columns of ``relevance``; each is 0 where ``k`` or the ground truth is empty."""
    ok = (F.col("k") > 0) & (F.col("n_truth") > 0)
    zero = F.lit(0.0)
    return {
        "recall": F.when(ok, F.col("hits") / F.greatest("n_truth", F.lit(1))).otherwise(zero),
        "precision": F.when(F.col("k") > 0, _share(F.col("hits"), F.least("k", "n"))).otherwise(zero),
        "hit_rate": F.when(F.col("hits") > 0, F.lit(1.0)).otherwise(zero),
        "mrr": F.coalesce(1.0 / F.col("first_hit"), zero),
        "ndcg": F.when(ok, _share(F.col("dcg"), _ideal())).otherwise(zero),
    }


def retrieval_metrics(records: DataFrame, retrieved: DataFrame, metrics: tuple[str, ...] = ("recall", "precision", "hit_rate", "mrr", "ndcg"), default_k: int = 10) -> DataFrame:
    """Long form ``(query_id, metric, value)``; names carry ``@k`` but for ``mrr``."""
    known = metric_columns()
    if unknown := [m for m in metrics if m not in known]:
        raise ValueError(f"unknown metrics: {unknown}")
    entries = F.array(*[F.struct((F.lit("mrr") if m == "mrr" else F.concat(F.lit(f"{m}@"), F.col("k").cast("string"))).alias("metric"), known[m].alias("value")) for m in metrics])
    return relevance(records, retrieved, default_k).select("query_id", F.explode(entries).alias("m")).select("query_id", "m.metric", "m.value")


def faithfulness(answer: Column | str, contexts: Column | str) -> Column:
    """Share of the answer's claims whose tokens all occur in the contexts; 1 without claims, 0 without context tokens."""
    known = F.array_distinct(F.flatten(F.transform(contexts, X.heuristic_tokens)))
    parts = X.claims(answer)
    backed = F.size(F.filter(parts, lambda c: F.size(F.array_except(c, known)) == 0))
    return F.when(F.size(parts) == 0, F.lit(1.0)).when(F.size(known) == 0, F.lit(0.0)).otherwise(backed / F.size(parts))


def answer_relevance(query: Column | str, answer: Column | str) -> Column:
    """Jaccard similarity of the tokens."""
    a, b = X.heuristic_tokens(query), X.heuristic_tokens(answer)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def context_precision(retrieved: Column | str, truth: Column | str) -> Column:
    """Share of the retrieved ids that are in the ground truth; 1 if none was retrieved, 0 without ground truth."""
    hits = F.size(F.filter(retrieved, lambda c: F.array_contains(truth, c)))
    return F.when(F.size(retrieved) == 0, F.lit(1.0)).when(F.size(truth) == 0, F.lit(0.0)).otherwise(hits / F.size(retrieved))


GENERATION_METRICS = ("faithfulness", "answer_relevance", "context_precision")


def generation_metrics(samples: DataFrame, metrics: tuple[str, ...] = GENERATION_METRICS, backend: str = "naive", judge: DataFrame | None = None) -> DataFrame:
    """Long form ``(query_id, metric, value)`` over query, answer, contexts, retrieved_ids, ground_truth_chunk_ids.

    ``backend``: ``naive`` (heuristics), ``skip`` (no rows) or ``judge``, which takes
    the rows of ``judge(query_id, metric, value)`` that an outer model made. With
    ``naive``, context precision has no row where nothing was retrieved.
    """
    if backend == "skip":
        return samples.limit(0).select("query_id", F.lit("").alias("metric"), F.lit(0.0).alias("value"))
    if backend == "judge":
        if judge is None:
            raise ValueError("the judge backend needs the judge's rows")
        return judge.filter(F.col("metric").isin(*metrics) & F.col("value").isNotNull()).select("query_id", "metric", "value")
    if backend != "naive":
        raise ValueError(f"unknown backend {backend}")
    values = {
        "faithfulness": faithfulness("answer", "contexts"),
        "answer_relevance": answer_relevance("query", "answer"),
        "context_precision": F.when(F.size("retrieved_ids") > 0, context_precision("retrieved_ids", "ground_truth_chunk_ids")),
    }
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), values[m].alias("value")) for m in metrics])
    return samples.select("query_id", F.explode(entries).alias("m")).select("query_id", "m.metric", "m.value").filter("value is not null")


def aggregate(values: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """``metric, mean, std, min, max, median, count``: population deviation, exact median.

    With ``records`` a record that lacks a metric counts as 0.
    """
    if records is not None:
        grid = values.select("metric").distinct().join(records.select("query_id").distinct())
        values = grid.join(values, ["query_id", "metric"], "left").select("query_id", "metric", F.coalesce("value", F.lit(0.0)).alias("value"))
    return values.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.median("value").alias("median"), F.count("*").alias("count")
    )


def baseline_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of the means in percent; metrics without a baseline, or with one of 0, have no row."""
    base = baseline.select("metric", F.col("mean").alias("base"))
    return current.join(base, "metric").filter("base <> 0").select("metric", ((F.col("mean") - F.col("base")) / F.col("base") * 100).alias("delta_pct"))


def gate(aggregates: DataFrame, thresholds: DataFrame, delta: DataFrame | None = None, max_regression: float | None = None) -> DataFrame:
    """One row for each check that failed: ``(kind, metric, value, bound)``.

    ``thresholds(metric_base, min_value)`` meet the first metric, by name, that
    is the base or starts with it and ``@``; those that meet none are skipped.
    A regression fails where a delta lies below ``-max_regression`` percent.
    """
    t = thresholds.filter("min_value is not null")
    near = (F.col("metric") == F.col("metric_base")) | F.col("metric").startswith(F.concat(F.col("metric_base"), F.lit("@")))
    first = ranked(aggregates.join(t, near), ["metric_base"], F.asc("metric"), limit=1)
    out = first.filter("mean < min_value").select(F.lit("threshold").alias("kind"), "metric", F.col("mean").alias("value"), F.col("min_value").alias("bound"))
    if delta is not None and max_regression is not None:
        fallen = delta.filter(F.col("delta_pct") < -max_regression)
        out = out.unionByName(fallen.select(F.lit("regression").alias("kind"), "metric", F.col("delta_pct").alias("value"), F.lit(-float(max_regression)).alias("bound")))
    return out
