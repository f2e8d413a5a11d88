"""Query variants: cutting, greedy selection and duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.fusion import ranked

CANDIDATES = 10


def _cosine(a, b) -> float:
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 0.0


def select_greedy(vectors: list, original, keep: int, alpha: float) -> list[int]:
    """Indices of ``keep`` candidates: likeness to the original against likeness to those chosen; ties to the first."""
    like = [_cosine(v, original) for v in vectors]
    nearest, chosen = [0.0] * len(vectors), []
    while len(chosen) < min(keep, len(vectors)):
        gains = [-np.inf if i in chosen else alpha * like[i] + (1 - alpha) * (1.0 - (nearest[i] if chosen else 0.0)) for i in range(len(vectors))]
        best = int(np.argmax(gains))
        chosen.append(best)
        nearest = [_cosine(v, vectors[best]) if len(chosen) == 1 else max(n, _cosine(v, vectors[best])) for v, n in zip(vectors, nearest, strict=True)]
    return chosen


def select_variants(queries: DataFrame, keep: int = 3, alpha: float = 0.3, candidates: int = CANDIDATES) -> DataFrame:
    """Adds ``variants`` to (query_id, original, candidates, original_vector, candidate_vectors).

    Up to ``candidates`` are looked at; ``keep`` or fewer stay as they are. Where
    a vector is missing the first ``keep`` are taken. Rows are independent of each
    other, so no shuffle is needed.
    """
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                texts = (r["candidates"] or [])[:candidates] or [r["original"]]
                vectors = (r["candidate_vectors"] or [])[: len(texts)]
                if len(texts) > keep:
                    whole = r["original_vector"] is not None and len(vectors) == len(texts) and None not in vectors
                    texts = [texts[i] for i in select_greedy(vectors, r["original_vector"], keep, alpha)] if whole else texts[:keep]
                out.append(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], ["query_id", "original", "variants"])

    return queries.select("query_id", "original", "candidates", "original_vector", "candidate_vectors").mapInArrow(run, f"query_id {kind}, original string, variants array<string>")


def distinct_variants(queries: DataFrame) -> DataFrame:
    """``(query_id, variant_idx, query)``: the original first, then variants that differ in more than case and punctuation."""
    every = F.concat(F.array("original"), F.coalesce("variants", F.array().cast("array<string>")))
    rows = queries.select("query_id", F.posexplode(every).alias("i", "query")).withColumn("_key", X.variant_key("query"))
    first = ranked(rows, ["query_id", "_key"], F.asc("i"), limit=1, name="_n")
    return ranked(first, ["query_id"], F.asc("i"), name="variant_idx").select("query_id", (F.col("variant_idx") - 1).cast("int").alias("variant_idx"), "query")
