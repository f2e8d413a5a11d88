"""Connected components over links that never leave the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise, release

#: Pointer jumps in a round: a chain of parents gets shorter by the power 2 ** JUMPS.
JUMPS = 2


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, component)`` of every vertex of ``edges(a, b)``; ``component`` is the smallest id reachable.

    Each round every vertex points to its smallest neighbour, pointers are
    followed a few times, and the edges between what is now one vertex vanish.
    Rounds are written to the shared folder, so a lost executor costs a task
    and not the run. Sums over a vertex are aggregated before the shuffle;
    joins send a hub's rows to no single task (``look_up``).
    Null ends and loops are dropped; no edge gives no row.
    """
    edges = materialise(
        edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{name}-edges",
    )
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("up")), f"{name}-parents")
        for _ in range(JUMPS):
            first = parent
            parent = look_up(parent, parent.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up"))
            parent = materialise(parent, f"{name}-parents")
            release(first)
        to = lambda c: parent.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
        ends = look_up(look_up(edges, to("a"), "a"), to("b"), "b", edges)
        ends = ends.filter("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct()
        last, edges = edges, materialise(ends, f"{name}-edges")
        release(last)
        if found is None:
            found = parent.select("id", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("id").alias("component"), "up")
            still = found.select("component").distinct().join(step, "component", "left").select("component", F.coalesce("up", "component").alias("up"))
            found = materialise(look_up(found, still, "component").select("id", F.col("up").alias("component")), f"{name}-found")
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found


#: A key is hot from this share of the rows on; so at most so many are.
HOT_KEYS = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, alike: DataFrame | None = None) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row for each ``key``: an inner join that no hot key holds up.

    Keys that hold more than one in ``HOT_KEYS`` of the rows, fewer than that
    many keys, meet a broadcast; all others meet in a shuffle. ``alike`` has
    the keys of ``rows`` where it is cheaper to count. Both are counted at
    once, so that a plan holds ``rows`` and ``table`` twice only where a key is
    hot; ``rows`` should have been written.
    """
    counts = (rows if alike is None else alike).groupBy(key).agg(F.count("*").alias("_n"))
    facts = counts.agg(F.sum("_n").alias("all"), F.max("_n").alias("most")).first()
    if not facts["most"] or facts["most"] <= 64 or facts["most"] * HOT_KEYS <= facts["all"]:
        return rows.join(table, key)
    found = counts.filter((F.col("_n") > 64) & (F.col("_n") * HOT_KEYS > facts["all"])).select(key).collect()
    hot = rows.sparkSession.createDataFrame(found, counts.select(key).schema)
    return rows.join(F.broadcast(table.join(F.broadcast(hot), key)), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` vertices by the edges ``(a, b)``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
