"""Near-duplicate embeddings by PCA-ordered tiles (operator 8).

Vectors are rotated so that the leading dimensions hold most of the variance.
A grid over the first of them keeps apart what cannot be close; the vectors of
a cell form tiles, and tiles of neighbouring cells are compared. A comparison
accumulates the leading dimensions, bounds the rest of the product by the norms
of the suffixes, and stops where the cosine cannot reach the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, table
from lodestone.llm.components import connected_components, local_components, look_up
from lodestone.session import materialise

THRESHOLD = 0.95
#: Bytes of the vectors in a tile: 4,096 of 64 dimensions, fewer of more.
TILE_BYTES = 1 << 20
ROWS = 512
GRID_DIMS = 2
#: Leading dimensions after which the bound is taken again.
STOPS = (8, 16, 32)
#: Vectors on which the rotation is fitted; it decides the speed alone, never a link.
PCA_SAMPLE = 8192


def fit_rotation(vectors: DataFrame, dim: int, sample: int = PCA_SAMPLE) -> np.ndarray:
    """Principal axes of the unit vectors as columns, by falling variance, from a bounded sample."""
    rows = vectors.filter(F.size("vector") == dim).orderBy(F.xxhash64("uid")).limit(sample).select("vector").collect()
    x = np.array([r[0] for r in rows], np.float64).reshape(-1, dim)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(dim))[1][:, ::-1].copy()


def _unit(raw: bytes, dim: int, kind: str = "<f4") -> np.ndarray:
    x = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # so that tiny or huge components do not vanish or overflow
    return x / np.linalg.norm(x, axis=1)[:, None]


def compare(left: np.ndarray, right: np.ndarray, rotation: np.ndarray, threshold: float, stops: tuple[int, ...] = STOPS, rows: int = ROWS):
    """Blocks of (i, j) with cosine of ``left[i]`` and ``right[j]`` at or above ``threshold``, exactly.

    Products are accumulated over the leading dimensions up to each of
    ``stops``; there the rest is bounded by the norms of the suffixes, and only
    pairs that can still reach the threshold go on.
    """
    a, b = left @ rotation, right @ rotation
    stops = [s for s in stops if s < a.shape[1]] or [a.shape[1]]
    rest = [[np.sqrt((x[:, s:] ** 2).sum(1)) for s in stops] for x in (a, b)]
    slack = 1e-9
    for at in range(0, len(a), rows):
        x, own = a[at : at + rows], [r[at : at + rows] for r in rest[0]]
        part = x[:, : stops[0]] @ b[:, : stops[0]].T
        i, j = np.nonzero(part + own[0][:, None] * rest[1][0][None, :] >= threshold - slack)
        if len(i) > part.size // 64:  # many go on: the next product is cheaper as a whole
            cosine = (x @ b.T)[i, j]
        else:
            product = part[i, j]
            for k, (s, e) in enumerate(zip(stops, [*stops[1:], a.shape[1]], strict=True)):
                product += np.einsum("ij,ij->i", x[i, s:e], b[j, s:e])
                if k + 1 < len(stops):
                    go = product + own[k + 1][i] * rest[1][k + 1][j] >= threshold - slack
                    i, j, product = i[go], j[go], product[go]
            cosine = product
        near = np.abs(cosine - threshold) < slack
        if near.any():  # at the border the plain product decides
            cosine[near] = np.einsum("ij,ij->i", left[at + i[near]], right[j[near]])
        keep = cosine >= threshold
        yield at + i[keep], j[keep]


def link_tiles(pairs: DataFrame, rotations: dict[int, np.ndarray], threshold: float, kind: str = "<f4") -> DataFrame:
    """For each tile pair: (uid, links, root) of every vector with links there; ``links`` counts copies, ``root`` shares its component."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                dim, same = row["dim"], row["a"] == row["b"]
                ids = [np.frombuffer(row[f"{s}_ids"], "<i8") for s in "ab"]
                count = [np.frombuffer(row[f"{s}_n"], "<i8") for s in "ab"]
                left, right = _unit(row["a_raw"], dim, kind), _unit(row["b_raw"], dim, kind)
                n = len(ids[0])
                total = n if same else n + len(ids[1])
                links, edges = np.zeros(total, np.int64), [(np.empty(0, np.int64),) * 2]
                for i, j in compare(left, right, rotations.get(dim, np.eye(dim)), threshold):
                    if same:
                        i, j = i[i != j], j[i != j]
                        np.add.at(links, i, count[0][j])
                    else:
                        np.add.at(links, i, count[1][j])
                        np.add.at(links, j + n, count[0][i])
                        j = j + n
                    if len(i):
                        used, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
                        label = local_components(len(used), flat[: len(i)], flat[len(i) :])
                        edges.append((used, used[label]))
                a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
                label = local_components(total, a, b)
                linked = np.nonzero(links)[0]
                uid = ids[0] if same else np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([pa.array(uid[linked]), pa.array(links[linked]), pa.array(uid[label[linked]])], ["uid", "links", "root"])

    return arrow_map(pairs, run, "uid long, links long, root long")


def _shifts(axis: int):
    """One cell to three: moved by -1, 0 and 1 along ``axis``."""

    def moved(by: int):
        return lambda x, i: F.when(i == axis, x + by).otherwise(x)

    return lambda c: F.array(*[F.transform(c, moved(by)) for by in (-1, 0, 1)])


def _around(cell: str) -> Column:
    """The cell and its neighbours in every grid dimension; only itself where vectors have no cell."""
    near = F.array(F.col(cell))
    for d in range(GRID_DIMS):
        near = F.flatten(F.transform(near, _shifts(d)))
    return F.array_distinct(near)


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``key, n_links, component_id, kept``.

    ``n_links`` counts the other rows whose vectors have a cosine of at least
    ``threshold`` in double precision, copies included; ``component_id`` is
    the smallest ``key`` reachable by links; ``kept`` marks the row of that
    key. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing and stand alone. Vectors of different length
    never link. Rows with one key are separate vectors of that name; a null key
    is never a component's id. An empty table gives an empty one.

    Copies are collapsed first. A pair of tiles yields counts and a spanning
    forest, never all of its links, so a group of n near copies costs
    comparisons but not n * n rows. No group is held by one task: a hot cell
    is cut into tiles of about ``TILE_BYTES``.
    """
    spark = rows.sparkSession
    # Components keep their precision: floats as floats, all other numbers as doubles.
    item = "float" if rows.select(F.col(f"`{vector}`")).schema[0].dataType.simpleString() == "array<float>" else "double"
    kind, size = ("<f4", 4) if item == "float" else ("<f8", 8)
    own = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast(f"array<{item}>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.coalesce((F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    own = own.withColumn("vector", F.when(valid, F.transform("vector", lambda x: x + F.lit(0.0).cast(item))))  # -0.0 becomes 0.0
    distinct = own.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    distinct = materialise(distinct.withColumn("uid", F.monotonically_increasing_id()), "vectors")

    dims = [r[0] for r in distinct.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(16).collect()]
    rotations = {d: fit_rotation(distinct, d) for d in dims}
    width = float(np.sqrt(2 * (1 - threshold)) + 1e-6) if threshold < 1 else 1e-3

    def celled(batches):
        names = ["uid", "n", "dim", "cell", "raw"]
        for b in batches:
            out = []
            for uid, n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = np.array(v, kind).tobytes()
                lead = (_unit(raw, len(v), kind) @ rotations[len(v)][:, :GRID_DIMS])[0] if len(v) in rotations else ()
                out.append((uid, n, len(v), [int(np.floor(x / width)) for x in lead], raw))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    cells = arrow_map(distinct.select("uid", "n", "vector"), celled, "uid long, n long, dim int, cell array<int>, raw binary")
    cells = materialise(cells, "cells")
    sizes = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.col("dim") * size / TILE_BYTES).alias("parts"))
    tiles = cells.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("uid"), "parts"))
    tiles = tiles.groupBy("dim", "cell", "part").agg(F.collect_list(F.struct("uid", "n", "raw")).alias("v"))

    def packed(batches):
        names = ["tile", "dim", "cell", "ids", "n", "raw"]
        for b in batches:
            for k in range(b.num_rows):
                dim, cell, part, v = (b.column(c)[k].as_py() for c in range(4))
                ids, n = (np.array([x[c] for x in v], "<i8").tobytes() for c in ("uid", "n"))
                tile = f"{dim}:{','.join(map(str, cell))}:{part}"
                kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((tile, dim, cell, ids, n, b"".join(x["raw"] for x in v)), kinds, strict=True)], names)

    tiles = materialise(arrow_map(tiles, packed, "tile string, dim int, cell array<int>, ids binary, n binary, raw binary"), "tiles")
    a = tiles.select(F.col("tile").alias("a"), "dim", F.explode(_around("cell")).alias("cell"))
    b = tiles.select(F.col("tile").alias("b"), "dim", "cell")
    pairs = a.join(b, ["dim", "cell"]).filter("a <= b").select("a", "b", "dim")
    for side in "ab":
        pairs = pairs.join(tiles.select(F.col("tile").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("ids", "n", "raw")]), side)
    found = materialise(link_tiles(pairs, rotations, threshold, kind), "links")

    group = connected_components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")), "vectors")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    known = distinct.join(links, "uid", "left").join(group.withColumnRenamed("id", "uid"), "uid", "left")
    known = known.select("vector", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "uid").alias("component"))
    known = materialise(known, "vectors-known")
    known = look_up(known, known.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("vector", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = own.join(known, "vector", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` at a cosine of 0.95 or more."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
