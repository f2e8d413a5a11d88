"""Findings of round 2."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import minhash_dedup, seating
from lodestone.llm.components import look_up
from lodestone.session import materialise


def test_registers_of_many_texts_at_once():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in (1, 2, 5, 6, 40, 300, 3000)] + ["a " * 700]
    bags = [minhash_dedup.Shingler()(t) for t in texts]
    assert bags[-1][1].tolist() == [696]
    together = minhash_dedup.bag_minhashes(bags)
    assert np.isfinite(together).all()
    for bag, row in zip(bags, together, strict=True):
        assert np.array_equal(row, minhash_dedup.bag_minhash(*bag))


def test_look_up_holds_its_rows_once_where_no_key_is_hot(spark):
    rows = materialise(spark.range(2000).withColumn("k", F.col("id") % 1900), "test-rows")
    table = spark.range(1900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    found = look_up(rows, table, "k")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan
    assert found.filter("x = k * 2").count() == 2000


def test_look_up_of_hot_and_null_keys(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 3000, F.lit(b"hot")).when(F.col("id") < 4000, F.col("id").cast("string").cast("binary")))
    rows = materialise(rows, "test-rows")
    table = rows.select("k").distinct().withColumn("x", F.length("k"))
    found = {r.x: r["count"] for r in look_up(rows, table, "k").groupBy("x").count().collect()}
    assert found == {3: 3000, 4: 1000}


@pytest.mark.parametrize("sweeps", [0, 1])
def test_every_customer_of_a_large_family_is_seated(monkeypatch, sweeps):
    """A family beyond the arrays' limit has as many tables as the same one in arrays."""
    customers, params, means = np.array([3000, 40]), seating.Params((0.7, 0.8, 0.8)), []
    for scan in (1 << 18, 50):
        monkeypatch.setattr(seating, "SCAN", scan)
        means.append(np.mean([seating.seat_root(customers, 1 / 4, 400, params, np.random.default_rng(k), sweeps) for k in range(20)], axis=0))
    assert np.abs(np.log(means[0] / means[1])).max() < 0.1


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_blocks_of_families_keep_every_customer(monkeypatch, width):
    """Blocks smaller than the number of families, with families of all widths in them."""
    rng = np.random.default_rng(5)
    family = np.sort(rng.integers(0, 60, 300))
    family = np.unique(family, return_inverse=True)[1]
    context, count = np.arange(300) % 7 + 7 * (family % 5), rng.integers(0, 30, 300)
    means = []
    for block in (1 << 13, 8):
        monkeypatch.setattr(seating, "BLOCK", block)
        monkeypatch.setattr(seating, "WIDTH", width)
        s = seating.Seating(family, context, count, np.arange(family.max() + 1) % 5, seating.Params(), np.random.default_rng(6))
        s.know_root(np.full(len(s.held), 9), np.full(len(s.held), 3), s.up_tables.copy(), (400, 90), 60)
        tables = []
        for k in range(40):
            s.sweep(enter=k == 0)
            owner = np.repeat(np.arange(300), s.tables)
            assert np.array_equal(np.bincount(owner, weights=s.sizes, minlength=300), count) and (s.sizes > 0).all()
            assert s.up_sizes.sum() == s.tables.sum() and len(s.up_sizes) == s.up_tables.sum()
            tables.append(s.tables.sum())
        means.append(np.mean(tables[10:]))
    assert abs(np.log(means[0] / means[1])) < 0.05
