"""Where remote models plug in. Each seam is an Arrow-batch callable with a deterministic local default."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import PERSIST_EMBED_FAILED
from lodestone.functions import text as X
from lodestone.session import arrow_map

#: Texts to vectors; called once for each batch.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: (query, texts) to one score for each text.
Reranker = Callable[[str, Sequence[str]], Sequence[float]]
#: (query, context) to an answer.
Writer = Callable[[str, str], str]

EMBED_BATCH = 256
ATTEMPTS = 3
REFUSAL = "No relevant content was found for this question."


class HashEmbedder:
    """A bag of hashed words and word pairs as a unit vector: equal texts are equal, similar ones near."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        digest = xxhash.xxh3_64_intdigest
        for row, text in zip(out, texts, strict=True):
            words = (text or "").lower().split()
            h = np.fromiter(map(digest, (*words, *map(" ".join, zip(words, words[1:])))), np.uint64)
            row += np.bincount((h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), self.dim)
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out.tolist()


#: Longest pause between attempts that double it.
LONGEST_PAUSE = 10.0


def with_retries(call: Callable, *args, attempts: int = ATTEMPTS, pause: float = 0.5, double: bool = False):
    """The result of ``call``; after the last attempt its error goes on. Pauses grow with the attempt, or ``double`` up to ``LONGEST_PAUSE``."""
    for n in range(1, attempts + 1):
        try:
            return call(*args)
        except Exception:  # whatever a remote model raises counts as a failed attempt
            if n == attempts:
                raise
            time.sleep(min(LONGEST_PAUSE, pause * 2 ** (n - 1)) if double else pause * n)


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", vector: str = "embedding", batch: int = EMBED_BATCH, pause: float = 0.5) -> DataFrame:
    """Adds ``vector`` and ``embed_error``: a batch that fails has no vectors and an error, and the job goes on."""
    keep = [c for c in rows.columns if c not in (vector, "embed_error")]
    source = rows.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                try:
                    vectors, error = [list(map(float, v)) for v in with_retries(embedder, [t or "" for t in b.column(1).to_pylist()], pause=pause)], None
                except Exception as e:  # the row says so
                    vectors, error = [None] * b.num_rows, f"{PERSIST_EMBED_FAILED}: {e}"
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([error] * b.num_rows, pa.string())], ["row", "v", "e"])

    out = arrow_map(source, run, f"row {source.schema['row'].dataType.simpleString()}, v array<float>, e string")
    return out.select("row.*", F.col("v").alias(vector), F.col("e").alias("embed_error"))


def structured_value(reply, field: str | None = None) -> tuple[object, str | None]:
    """(value, None) of a model's reply or (None, why there is none).

    A reply is a value, an object or dict with ``field``, or a dict of
    ``parsed``, ``parsing_error`` and ``raw``.
    """
    if reply is None:
        return None, "no reply"
    if isinstance(reply, dict) and "parsed" in reply:
        if reply.get("parsing_error"):
            return None, f"not parsed: {reply['parsing_error']}"
        reply = reply["parsed"]
        if reply is None:
            return None, "nothing was parsed"
    if field is None:
        return reply, None
    value = reply.get(field) if isinstance(reply, dict) else getattr(reply, field, None)
    return value, None if value is not None else f"no {field} in the reply"


def propose_variants(queries: DataFrame, provider: Callable[[str], object], query: str = "query", most: int = 50, pause: float = 0.5) -> DataFrame:
    """Adds ``candidates``: what ``provider`` makes of a query (a list, or a reply with ``variants``), the query alone where it fails."""
    keep = [c for c in queries.columns if c != "candidates"]
    source = queries.select(F.struct(*keep).alias("row"), F.col(query).alias("q"))

    def run(batches):
        for b in batches:
            out = []
            for q in b.column(1).to_pylist():
                try:
                    reply = with_retries(provider, q, pause=pause)
                    found = reply if isinstance(reply, list) else structured_value(reply, "variants")[0]
                    found = [v for v in found or [] if isinstance(v, str) and v.strip()][:most]
                except Exception:  # the query stands for itself
                    found = []
                out.append(found or [q])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["row", "candidates"])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, candidates array<string>").select("row.*", "candidates")


def rerank_scores(hits: DataFrame, reranker: Reranker, query: str = "query", text: str = "text", keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """``(keys, chunk_id, rerank_score)`` of a query's texts, which are no more than its retrievers gave; a failing query has no row."""
    lists = hits.groupBy(*keys).agg(F.first(query).alias("q"), F.array_sort(F.collect_list(F.struct("pos", "chunk_id", F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("l"))
    source = lists.select(F.struct(*keys).alias("key"), "q", "l")
    id_type = hits.schema["chunk_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                rows = b.column(2)[k].as_py()
                try:
                    scores = list(reranker(b.column(1)[k].as_py(), [r["t"] for r in rows]))[: len(rows)]
                except Exception:  # the old order stays where the model fails
                    continue
                chunk = b.column(2).values.field("chunk_id").type
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(scores), b.column(0).type), pa.array([r["chunk_id"] for r in rows[: len(scores)]], chunk), pa.array(scores, pa.float64())], ["key", "chunk_id", "rerank_score"])

    out = source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, chunk_id {id_type}, rerank_score double")
    return out.select("key.*", "chunk_id", "rerank_score")


def extract_answer(query: str, context: str) -> str:
    """A stand-in for a language model: the first cited passage's first sentence, with its marker."""
    first = context.split("\n\n", 1)[0]
    body = first.split("] ", 1)[-1]
    return f"{body.split('. ')[0].strip()} [1](CITE)"


def answers(contexts: DataFrame, writer: Writer = extract_answer, query: str = "query", context: str = "context") -> DataFrame:
    """Adds ``response``: a refusal without a context, and an error text where the writer fails."""
    keep = [c for c in contexts.columns if c != "response"]
    source = contexts.select(F.struct(*keep).alias("row"), F.col(query).alias("q"), F.col(context).alias("c"))

    def run(batches):
        for b in batches:
            out = []
            for q, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    out.append(writer(q, c) if c else REFUSAL)
                except Exception as e:  # an answer that failed is a text, as callers expect one
                    out.append(f"Generation failed: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row", "response"])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, response string").select("row.*", "response")


def token_counts(text: Column | str) -> Column:
    """The default token count; a tokenizer may take its place as a column of its own."""
    return X.estimated_tokens(text)


def count_tokens(rows: DataFrame, text: str = "text", name: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """Adds ``name``: ids that the tokenizer file ``vocabulary`` (JSON, readable by every executor) makes of ``text``, null for null; the estimate without one."""
    if vocabulary is None:
        return rows.withColumn(name, token_counts(text))
    keep = [c for c in rows.columns if c != name]
    source = rows.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))

    def run(batches):
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(vocabulary).encode
        for b in batches:
            n = [None if t is None else len(encode(t, add_special_tokens=False).ids) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["row", "n"])

    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, n int").select("row.*", F.col("n").alias(name))


def normalise_structure(docs: DataFrame, restructure: Callable[[str], str] | None = None, mode: str = "auto", text: str = "text", most: int = 50_000, pause: float = 0.5) -> DataFrame:
    """Lets a model add headings to ``text``; adds ``skipped`` and ``degraded``.

    Skipped without a model, in mode ``forbid``, and in mode ``auto`` where there
    are two headings already. The model sees the first ``most`` characters; where
    it fails, or returns nothing, the text stays and ``degraded`` is set.
    """
    if mode not in ("auto", "force", "forbid"):
        raise ValueError(f"unknown mode {mode}")
    if restructure is None or mode == "forbid":
        return docs.withColumn("skipped", F.lit(True)).withColumn("degraded", F.lit(False))
    skip = (X.heading_count(F.col(text)) >= 2) if mode == "auto" else F.lit(False)
    keep = [c for c in docs.columns if c != text]
    source = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("t"), F.coalesce(skip | (F.trim(F.col(text)) == ""), F.lit(True)).alias("skip"))

    def run(batches):
        for b in batches:
            out, bad = [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                new = None
                if not s:
                    try:
                        new = with_retries(restructure, t[:most], pause=pause)
                    except Exception:  # the raw text stands in
                        new = None
                out.append(new + t[most:] if new else t)
                bad.append(not s and not new)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2), pa.array(bad, pa.bool_())], ["row", "t", "skip", "bad"])

    out = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, t string, skip boolean, bad boolean")
    return out.select(*[F.col(f"row.{c}").alias(c) if c != text else F.col("t").alias(text) for c in docs.columns], F.col("skip").alias("skipped"), F.col("bad").alias("degraded"))
