"""Vector and full-text top-k, siblings and counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vectors as V
from lodestone.operators.fusion import ranked
from lodestone.session import arrow_map, materialise, spread

#: Decimals of a score: engines agree to these, and ties are broken by id.
DECIMALS = 6
#: Queries in a block and vectors in a tile: one matrix product.
QUERY_BLOCK = 2048
TILE_ROWS = 4096
#: Scores that a task holds at a time, and rows it finds before it keeps the best of them.
SCORES = 1 << 20
FOUND_ROWS = 250_000
#: Bytes of query vectors up to which their blocks are broadcast; more meet the tiles in a shuffle.
BROADCAST_BYTES = 64 << 20
#: Queries up to which their rarest terms are broadcast.
BROADCAST_QUERIES = 200_000


def vector_topk(chunks: DataFrame, query: Sequence[float], k: int = 10, chunk_id: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` chunks of highest cosine with one query vector: a top-k that every task takes first.

    Null, zero and differently sized vectors have no cosine and are left out.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.filter((F.size(vector) == len(query)) & (V.norm(F.col(vector)) > 0)).withColumn("score", F.round(V.cosine(F.col(vector), q), DECIMALS))
    top = scored.orderBy(F.desc("score"), F.asc(chunk_id)).limit(k)
    return ranked(top.drop(vector), [], F.desc("score"), F.asc(chunk_id)).withColumn("source", F.lit("vector"))


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction, and which rows these are; the rows have one length."""
    lengths = np.diff(column.offsets.to_numpy())
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), int(lengths[0]) if len(lengths) else 0)
    n = np.linalg.norm(x, axis=1)
    good = np.nonzero(np.isfinite(n) & (n > 0))[0]
    return x[good] / n[good, None], good


def _tiles(chunks: DataFrame, id_kind: str) -> DataFrame:
    """``(g, dim, ids, raw)``: the vectors of a task packed by group and length, with no shuffle."""

    def run(batches):
        kind = None
        held: dict = {}

        def out(key):
            ids, raw = zip(*held.pop(key), strict=True)
            ids = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), lists, pa.array([np.concatenate(raw).tobytes()], pa.binary())], ["g", "dim", "ids", "raw"])

        for b in batches:
            kind = b.schema.field(0).type
            # Null vectors and those with null components have no cosine.
            whole = np.array([v.is_valid and v.values.null_count == 0 and len(v) > 0 for v in b.column(1)], bool)
            b = b.filter(pa.array(whole))
            sizes, groups = np.diff(b.column(1).offsets.to_numpy()), np.array(b.column(2).to_pylist(), object)
            for key in sorted(set(zip(groups.tolist(), sizes.tolist(), strict=True)), key=repr):
                at = np.nonzero((groups == key[0]) & (sizes == key[1]))[0]
                own = b.take(pa.array(at))
                unit, good = _unit_rows(own.column(1))
                if len(good):
                    held.setdefault(key, []).append((own.column(0).take(pa.array(good)), unit))
                    if sum(len(i) for i, _ in held[key]) >= TILE_ROWS:
                        yield out(key)
        for key in list(held):
            yield out(key)

    return arrow_map(chunks, run, f"g string, dim int, ids array<{id_kind}>, raw binary")


def vector_topk_batch(
    chunks: DataFrame, queries: DataFrame, k: int = 10, chunk_id: str = "chunk_id", vector: str = "embedding", query_id: str = "query_id", block: int = QUERY_BLOCK, group: str | None = None, groups: str | None = None
) -> DataFrame:
    """``(query_id, chunk_id, score, pos)``: the top ``k`` for each of many query vectors, exactly.

    Any number of queries is one plan: they form blocks, chunks form tiles
    where they lie, each tile meets the blocks of its group and length, and a
    matrix product scores them. A task keeps about ``k`` rows a query before
    the shuffle. Blocks are broadcast up to ``BROADCAST_BYTES``; beyond, tiles
    and blocks are shuffled by block. Rows are narrow: join texts afterwards.
    With ``group``, a column of the chunks, and ``groups``, an array column of
    the queries, each query meets the groups that it names and has a top ``k``
    in each of them. Vectors that are null, zero, not finite or of another
    length have no cosine and are left out; a repeated query id gives one
    ranking over its rows.
    """
    id_kind, q_kind = chunks.schema[chunk_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    named = F.array_distinct(F.col(groups).cast("array<string>")) if groups else F.array(F.lit(""))
    wanted = queries.filter(F.size(vector) > 0).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"), F.explode(named).alias("g")).filter("g is not null")
    wanted = wanted.filter(F.forall("v", lambda x: x.isNotNull())).withColumn("dim", F.size("v"))
    narrow = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).cast("array<double>").alias("v"), F.col(group).cast("string").alias("g") if group else F.lit("").alias("g"))
    if group:
        narrow = narrow.filter("g is not null")
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0)) * 8).first()
    parts = max(1, -(-n // block))
    blocks = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).groupBy("g", "dim", "block").agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
    tiles = _tiles(narrow, id_kind)
    if size <= BROADCAST_BYTES:
        pairs = tiles.join(F.broadcast(blocks), ["g", "dim"])
    else:
        pairs = tiles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(blocks, ["g", "dim", "block"])

    def run(batches):
        found: list[pa.Table] = []
        bounds: dict = {}  # (group, length, block) -> the k-th score of each query so far
        held, most = 0, FOUND_ROWS

        def best() -> pa.Table:
            t = pa.concat_tables(found).sort_by([("query_id", "ascending"), ("g", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
            new = np.ones(len(t), bool)
            q, g = t.column("query_id").combine_chunks(), t.column("g").combine_chunks()
            if len(t) > 1:
                same = pc.and_(pc.fill_null(pc.equal(q[1:], q[:-1]), False), pc.equal(g[1:], g[:-1]))
                new[1:] = ~same.to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
            return t.filter(pa.array(np.arange(len(t)) - start < k))

        for batch in batches:
            for r in range(batch.num_rows):
                g, dim, ids, raw, place, asked = (batch.column(c)[r] for c in range(6))
                dim, ids = dim.as_py(), ids.values
                q, good = _unit_rows(asked.values.field("v"))
                names = asked.values.field("query_id").take(pa.array(good))
                tile = np.frombuffer(raw.as_buffer()).reshape(-1, dim).T
                low = bounds.setdefault((g.as_py(), dim, place.as_py()), np.full(len(q), -np.inf))
                step = max(1, SCORES // max(1, tile.shape[1]))
                for at in range(0, len(q), step):  # a few queries at a time: scores of a whole block take many times its size
                    s = q[at : at + step] @ tile
                    np.round(s, DECIMALS, out=s)
                    least = low[at : at + step]
                    if s.shape[1] >= k:  # what ties with the k-th stays, so that ids decide
                        np.maximum(least, np.partition(s, -k, axis=1)[:, -k], out=least)
                    i, j = np.nonzero(s >= least[:, None])
                    found.append(pa.table({"query_id": names.take(pa.array(i + at)), "chunk_id": ids.take(pa.array(j)), "score": s[i, j], "g": pa.repeat(g, len(i))}))
                    held += len(i)
                    if held > most:
                        found = [best()]
                        held = len(found[0])
                        most = max(FOUND_ROWS, 2 * held)  # never sorted again for a few rows
        if found:
            yield from best().to_batches()

    found = arrow_map(pairs.select("g", "dim", "ids", "raw", "block", "asked"), run, f"query_id {q_kind}, chunk_id {id_kind}, score double, g string")
    keys = ["query_id", "g"] if group else ["query_id"]
    out = ranked(found, keys, F.desc("score"), F.asc("chunk_id"), limit=k)
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def _exploded(rows: DataFrame, columns: Sequence[str], terms: Column) -> DataFrame:
    """``columns`` and ``term``, a row for each of ``terms``.

    The outer form, as the plain one gets a filter on the size of the list, which
    cuts every text once more, and before any other filter.
    """
    return rows.select(*columns, F.explode_outer(terms).alias("term")).filter("term is not null")


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", extra: Sequence[str] = (), only: DataFrame | None = None) -> DataFrame:
    """``(term, chunk_id, tf)`` and ``extra`` columns: the inverted index, to be written in order of ``term``.

    ``only``, a frame of distinct ``extra`` columns and ``term``, keeps the index
    to those before anything is shuffled by chunk.
    """
    own = spread(chunks.select(*extra, F.col(chunk_id).alias("chunk_id"), F.col(text).alias("_text")))
    exploded = _exploded(own, [*extra, "chunk_id"], X.terms("_text"))
    if only is not None:
        exploded = exploded.join(only, [*extra, "term"], "left_semi")
    return exploded.groupBy(*extra, "chunk_id", "term").agg(F.count("*").cast("int").alias("tf"))


def term_uses(chunks: DataFrame, text: str = "text", extra: Sequence[str] = ()) -> DataFrame:
    """``(term, chunks)`` and ``extra`` columns: in how many chunks each term occurs, summed up where the texts lie before any shuffle."""
    own = spread(chunks.select(*extra, F.col(text).alias("_text")))
    return _exploded(own, [*extra], F.array_distinct(X.terms("_text"))).groupBy(*extra, "term").agg(F.count("*").alias("chunks"))


def query_terms(queries: DataFrame, query: str = "query", query_id: str = "query_id", segmented: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """``(query_id, term, n_terms)`` with distinct terms; ``segmented`` names a column with terms of another segmenter, ``extra`` columns to keep."""
    terms = F.array_distinct(F.filter(F.col(segmented), lambda t: F.trim(t) != "") if segmented else X.terms(query))
    # The list and its size are made before it is exploded: else they are made anew for every term.
    own = queries.select(F.col(query_id).alias("query_id"), *extra, terms.alias("_terms"))
    return _exploded(own.withColumn("n_terms", F.size("_terms")), ["query_id", *extra, "n_terms"], F.col("_terms"))


def fulltext_topk(index: DataFrame, queries: DataFrame, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best chunks that hold every term of a query; ``index`` as ``postings`` gives it, ``queries`` as ``query_terms``.

    The score grows with the term frequencies and lies in [0, 1): the mean of
    tf / (tf + 1). ``keys`` are columns of both that must agree, with a ranking for
    each of their values. Rows of one query id are one query.
    """
    uses = index.groupBy(*keys, "term").agg(F.count("*").alias("chunks"))
    with_terms = lambda terms: index.join(terms, [*keys, "term"], "left_semi")
    return _every_term(uses, with_terms, lambda ids: index.join(ids, [*keys, "chunk_id"], "left_semi"), queries, k, keys)


def fulltext_topk_of(chunks: DataFrame, queries: DataFrame, k: int = 10, keys: Sequence[str] = (), text: str = "text") -> DataFrame:
    """``fulltext_topk`` over ``(keys, chunk_id, text)`` without a stored index: only the postings that it needs are made."""
    with_terms = lambda terms: postings(chunks, text=text, extra=keys, only=terms)
    of_chunks = lambda ids: postings(chunks.join(ids, [*keys, "chunk_id"], "left_semi"), text=text, extra=keys)
    return _every_term(term_uses(chunks, text, keys), with_terms, of_chunks, queries, k, keys)


def _every_term(uses: DataFrame, with_terms: Callable[[DataFrame], DataFrame], of_chunks: Callable[[DataFrame], DataFrame], queries: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """The best chunks by way of the rarest terms.

    A chunk with every term of a query has its rarest one: the chunks of that
    one meet the query, and only their postings are looked up. ``uses`` decides
    which term that is, and no result. No table of all terms in common exists.
    """
    asked = queries.select("query_id", *keys, "term").distinct()
    # A term that no chunk has is the rarest, so that its query meets none.
    rare = asked.join(uses, [*keys, "term"], "left").groupBy("query_id", *keys)
    rare = materialise(rare.agg(F.count("*").alias("n_terms"), F.min_by("term", F.struct(F.coalesce("chunks", F.lit(0)), "term")).alias("term")), "rarest-terms")
    few = F.broadcast if rare.count() <= BROADCAST_QUERIES else lambda df: df
    near = with_terms(few(rare.select(*keys, "term").distinct()))
    pairs = materialise(near.join(few(rare), [*keys, "term"]).select("query_id", *keys, "chunk_id", "n_terms"), "rarest-pairs")
    hits = of_chunks(pairs.select(*keys, "chunk_id").distinct()).join(pairs.join(asked, ["query_id", *keys]), [*keys, "chunk_id", "term"])
    scored = hits.groupBy("query_id", *keys, "chunk_id").agg(
        F.count("*").alias("found"), F.max("n_terms").alias("n_terms"), F.sum(F.col("tf") / (F.col("tf") + 1.0)).alias("s")
    )
    scored = scored.filter("found = n_terms").withColumn("score", F.round(F.col("s") / F.col("n_terms"), DECIMALS))
    out = scored.select("query_id", *keys, "chunk_id", "score").withColumn("source", F.lit("fulltext"))
    return ranked(out, ["query_id", *keys], F.desc("score"), F.asc("chunk_id"), limit=k)


def siblings(chunks: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """Chunks of the same dataset and title whose index lies within ``window`` of a hit's: (hit fields, sibling as struct).

    An equi-join on dataset, title and a stretch of ``2 * window + 1`` indices:
    a hit asks the two or three stretches that it touches, so that a common
    title is no hot key. It is not restricted to the hit's document.
    """
    width = 2 * window + 1
    right = chunks.select(F.col("dataset_id").alias("_d"), F.col("parent_title").alias("_t"), F.col("chunk_index").alias("_i"), F.struct(*chunks.columns).alias("sibling"))
    right = right.withColumn("_s", F.floor(F.col("_i") / width))
    low, high = F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window
    left = hits.withColumn("_at", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    same = (F.col("dataset_id") == F.col("_d")) & (F.col("parent_title") == F.col("_t")) & (F.col("_at") == F.col("_s")) & F.col("_i").between(low, high)
    return left.join(right, same).drop("_d", "_t", "_i", "_s", "_at")


def expand_parents(hits: DataFrame, chunks: DataFrame, window: int, decay: float = 0.5, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Hits with their siblings, each chunk once: first by hit, then by index.

    A hit keeps its score and fields; a sibling gets the hit's score times
    ``decay`` and has no document or breakdown. Images and hits without a title
    pass as they are. ``window`` 0 changes nothing.
    """
    if not 0 <= decay <= 1:
        raise ValueError("decay must lie between 0 and 1")
    if window <= 0:
        return hits
    plain = F.coalesce((F.trim("parent_title") == "") | (F.col("modality") == "image_caption"), F.lit(True))
    own = hits.withColumn("_at", F.col("chunk_index")).withColumn("_own", F.lit(0))
    near = siblings(chunks, hits.filter(~plain), window).filter("sibling.chunk_id <> chunk_id")
    fields = [c for c in chunks.columns if c in hits.columns and c not in ("document_id", *keys)]
    others = [c for c in hits.columns if c not in {*fields, *keys, "pos", "score", "document_id", "score_breakdown"}]
    gone = [F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("document_id", "score_breakdown") if c in hits.columns]
    near = near.select(*keys, "pos", (F.col("score") * decay).alias("score"), *[F.col(f"sibling.{c}").alias(c) for c in fields], *others, *gone, F.col("sibling.chunk_index").alias("_at"), F.lit(1).alias("_own"))
    all_rows = own.unionByName(near)
    first = ranked(all_rows, [*keys, "chunk_id"], F.asc("pos"), F.asc("_at"), F.asc("_own"), limit=1, name="_n")
    return ranked(first.withColumnRenamed("pos", "_pos"), keys, F.asc("_pos"), F.asc("_at"), F.asc("_own")).drop("_pos", "_at", "_own", "_n")


def cite(hits: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """1-based numbers in order, and names ``src-1``, ``src-2`` and so on."""
    return ranked(hits, keys, F.asc("pos"), name="cite_id").withColumn("source_name", F.concat(F.lit("src-"), F.col("cite_id").cast("string")))


def context_of(cited: DataFrame, keys: Sequence[str] = ("query_id",), content: str = "text") -> DataFrame:
    """``[1] first``, a blank line, ``[2] second``: one row for each query, in order of the citations."""
    rows = cited.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cite_id", F.coalesce(F.col(content), F.lit("")).alias("c")))).alias("l"))
    return rows.select(*keys, F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["cite_id"].cast("string"), F.lit("] "), x["c"])), "\n\n").alias("context"))
