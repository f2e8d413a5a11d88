"""Metrics, aggregates and gates; labels of vectors are the ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluation
from lodestone.plans.catalogue_search import _BATCH, _batch, _read, _vectors


def _records(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    same = v.groupBy("label").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("ground_truth_chunk_ids"))
    return v.filter("chunk_id % 100 = 0").join(same, "label").select(F.col("chunk_id").alias("query_id"), "ground_truth_chunk_ids", F.when(F.col("chunk_id") % 200 == 0, 5).alias("k"))


def _metrics(spark, sf_dir, *names):
    rows = evaluation.retrieval_metrics(_records(spark, sf_dir), _batch(spark, sf_dir, 20), names or ("recall", "precision", "hit_rate", "mrr", "ndcg"))
    return rows.select("query_id", "metric", F.round("value", 9).alias("value"))


def recall_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir, "recall")


def precision_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir, "precision")


def hit_rate(spark, sf_dir):
    return _metrics(spark, sf_dir, "hit_rate")


def mrr(spark, sf_dir):
    return _metrics(spark, sf_dir, "mrr")


def ndcg_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir, "ndcg")


def _aggregates(spark, sf_dir):
    return evaluation.aggregate(_metrics(spark, sf_dir), _records(spark, sf_dir))


def metric_aggregate(spark, sf_dir):
    return _aggregates(spark, sf_dir).select("metric", *[F.round(c, 8).alias(c) for c in ("mean", "std", "min", "max", "median")], "count")


def _baseline(spark):
    return spark.createDataFrame([("recall@5", 0.5), ("recall@10", 0.01), ("mrr", 0.9), ("ndcg@5", 0.0), ("other", 1.0)], "metric string, mean double")


def baseline_delta(spark, sf_dir):
    return evaluation.baseline_delta(_aggregates(spark, sf_dir), _baseline(spark)).select("metric", F.round("delta_pct", 5).alias("delta_pct"))


def gate_eval(spark, sf_dir):
    current = _aggregates(spark, sf_dir)
    thresholds = spark.createDataFrame([("recall", 0.9), ("mrr", 0.1), ("precision", 0.99), ("absent", 0.5), ("ndcg", None)], "metric_base string, min_value double")
    failed = evaluation.gate(current, thresholds, evaluation.baseline_delta(current, _baseline(spark)), 5.0)
    return failed.select("kind", "metric", F.round("value", 5).alias("value"), "bound")


def _turns(spark, sf_dir):
    """A user's turn and the assistant's next one."""
    rows = _read(spark, sf_dir, "conversations")
    asked = rows.filter("role = 'user'").groupBy("conv_id", "turn").agg(F.min("text").alias("query"))
    told = rows.filter("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.min("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"])


def jaccard_relevance(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(evaluation.answer_relevance("query", "answer"), 9).alias("value"))


def claim_faithfulness(spark, sf_dir):
    """Answers against the question and the first half of the answer as contexts."""
    contexts = F.array("query", F.expr("substring(answer, 1, cast(length(answer) / 2 as int))"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(evaluation.faithfulness("answer", contexts), 9).alias("value"))


def context_precision(spark, sf_dir):
    hits = _batch(spark, sf_dir, 20).groupBy("query_id").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("retrieved"))
    rows = _records(spark, sf_dir).join(hits, "query_id")
    return rows.select("query_id", F.round(evaluation.context_precision("retrieved", "ground_truth_chunk_ids"), 9).alias("value"))


QUERIES = {f.__name__: f for f in (recall_at_k, precision_at_k, hit_rate, mrr, ndcg_at_k, metric_aggregate, baseline_delta, gate_eval, jaccard_relevance, claim_faithfulness, context_precision)}

_REL = f"""h as ({_BATCH} 20), q as (select vec_id as query_id, label, case when vec_id % 200 = 0 then 5 else 10 end as k from embeddings where vec_id % 100 = 0),
n as (select label, count(*) as n from embeddings group by 1),
m as (select h.*, q.k, n.n, b.label = q.label as hit from h join q using (query_id) join n on q.label = n.label join embeddings b on h.chunk_id = b.vec_id),
r as (select query_id, k, n, count(*) filter (hit and pos <= k) as hits, min(case when hit then pos end) as first, count(*) as got, coalesce(sum(case when hit and pos <= k then 1 / log2(pos + 1) end), 0) as dcg from m group by all),
v as (
  select query_id, 'recall@' || k as metric, hits / n as value from r union all
  select query_id, 'precision@' || k, hits / least(k, got) from r union all
  select query_id, 'hit_rate@' || k, (hits > 0)::int::double from r union all
  select query_id, 'mrr', coalesce(1 / first, 0) from r union all
  select query_id, 'ndcg@' || k, dcg / (select sum(1 / log2(i + 1)) from range(1, least(k, n) + 1) t(i)) from r),
values_ as (select query_id, metric, round(value, 9) as value from v)"""
_AGG = f"""{_REL}, g as (select distinct metric, q.query_id from values_, q), x as (select g.metric, coalesce(value, 0) as value from g left join values_ using (query_id, metric)),
agg as (select metric, avg(value) as mean, stddev_pop(value) as std, min(value) as min, max(value) as max, median(value) as median, count(*) as count from x group by 1)"""
_BASE = "base(metric, base) as (values ('recall@5', 0.5), ('recall@10', 0.01), ('mrr', 0.9), ('ndcg@5', 0.0), ('other', 1.0)), delta as (select metric, (mean - base) / base::double * 100 as d from agg join base using (metric) where base <> 0)"
_TOKENS = lambda c: rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'))"
_TURNS = "t as (select conv_id, turn, a.text as query, b.text as answer from (select conv_id, turn, min(text) as text from conversations where role = 'user' group by all) a join (select conv_id, turn - 1 as turn, min(text) as text from conversations where role = 'assistant' group by all) b using (conv_id, turn))"

ORACLE_SQL = {
    **{name: f"with {_REL} select query_id, metric, value from values_ where metric like '{m}%'" for name, m in (("recall_at_k", "recall"), ("precision_at_k", "precision"), ("hit_rate", "hit"), ("mrr", "mrr"), ("ndcg_at_k", "ndcg"))},
    "metric_aggregate": f"with {_AGG} select metric, round(mean, 8) as mean, round(std, 8) as std, round(min, 8) as min, round(max, 8) as max, round(median, 8) as median, count from agg",
    "baseline_delta": f"with {_AGG}, {_BASE} select metric, round(d, 5) as delta_pct from delta",
    "gate_eval": f"""with {_AGG}, {_BASE}, th(b, m) as (values ('recall', 0.9), ('mrr', 0.1), ('precision', 0.99), ('absent', 0.5)),
        f as (select th.*, agg.* from th join agg on metric = b or starts_with(metric, b || '@') qualify row_number() over (partition by b order by metric) = 1)
        select 'threshold' as kind, metric, round(mean, 5) as value, m::double as bound from f where mean < m
        union all select 'regression', metric, round(d, 5), -5.0::double from delta where d < -5""",
    "jaccard_relevance": f"""with {_TURNS}, s as (select conv_id, turn, {_TOKENS("query")} as a, {_TOKENS("answer")} as b from t)
        select conv_id, turn, round(case when len(list_distinct(a || b)) > 0 then len(list_intersect(a, b)) / len(list_distinct(a || b)) else 0 end, 9) as value from s""",
    "claim_faithfulness": rf"""with {_TURNS}, s as (select conv_id, turn, {_TOKENS("query || ' ' || substr(answer, 1, (length(answer) // 2)::bigint)")} as known,
          list_filter(list_transform(string_split_regex(answer, '[.!?。！？\n]+'), lambda p: list_distinct(regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}_]+'))), lambda c: len(c) > 0) as claims from t)
        select conv_id, turn, round(case when len(claims) = 0 then 1 when len(known) = 0 then 0 else len(list_filter(claims, lambda c: len(list_intersect(c, known)) = len(c))) / len(claims) end, 9) as value from s""",
    "context_precision": f"with {_REL} select query_id, round(count(*) filter (hit) / count(*), 9) as value from m group by query_id",
}
