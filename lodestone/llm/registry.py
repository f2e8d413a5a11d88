"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import embedding_dedup, media, minhash_dedup, mixing, packing, pii, pitman_yor, quality, toxicity, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_minhash_near_dup": minhash_dedup.op1_minhash_near_dup,
    "op2_pitman_yor": pitman_yor.op2_pitman_yor,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_mixing": mixing.op4_mixing,
    "op5_media": media.op5_media,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_embedding_near_dup": embedding_dedup.op8_embedding_near_dup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_pii_spans": pii.op10_pii_spans,
}

ORACLE_SQL = {"op3_url_filter": url_filter.SQL, "op4_mixing": mixing.SQL}
