"""Jobs that were once done in part only."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from lodestone.llm import embedding_dedup, minhash_dedup, mixing, pii, toxicity
from lodestone.llm.components import local_components
from lodestone.session import materialise


@pytest.mark.parametrize(
    "found",
    [
        "192 dot 168 dot 1 dot 1",
        "one dot two dot three dot four",
        "192 punkt 168 punkt one one dot 1",
        "10 [dot] zero [dot] zero [dot] one",
        "one nine two dot 168 dot 1 dot 1",
    ],
)
def test_spoken_dots_of_addresses(found):
    text = f"the host is {found}, ok"
    at = text.index(found)
    assert pii.find_spans(text) == ([], [("ip", at, at + len(found))])
    assert pii.redact(text) == "the host is <IP>, ok"


@pytest.mark.parametrize("text", ["300 dot 1 dot 1 dot 1", "from 1 point 5 to 3 point 2", "one dot two dot three"])
def test_spoken_dots_that_are_no_address(text):
    assert pii.find_spans(text) == ([], [])


def test_sequences_follow_the_mix(spark):
    """Later rows are longer, so later files are larger and a plain scan takes them first."""
    n = 400
    laid = spark.range(n).select(F.struct(F.col("id").alias("doc_id"), F.expr("repeat(sha2(cast(id as string), 256), cast(1 + id / 4 as int))").alias("text")).alias("row"), F.col("id").alias("position"))
    docs = materialise(mixing.in_order(laid, n), "test-laid")
    assert len(docs.inputFiles()) > 1
    by = {}
    for r in corpus_pipeline.pack_sequences(spark, docs, "").select("doc_id", "sequence_id").collect():
        by.setdefault(r.sequence_id >> 33, set()).add(r.doc_id)
    assert [i for p in sorted(by) for i in sorted(by[p])] == list(range(n)) and len(by) > 1
    assert corpus_pipeline.pack_sequences(spark, materialise(docs.limit(0), "test-laid"), "").count() == 0


@pytest.mark.parametrize("tile", [4, 16])
def test_large_groups_in_small_tiles(spark, monkeypatch, tile):
    """Near copies at all distances around the similarity, over many tiles, leaders of leaders and open groups: as brute force has it."""
    rng = random.Random(tile)
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    texts = []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(120)]
        for k in range(60):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10_000)}"
            texts.append(" ".join(words if k % 9 else base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    shingles = minhash_dedup.Shingler()
    bags = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(bags)) for j in range(i) if minhash_dedup.overlap(bags[i], bags[j]) >= 0.8]
    label = local_components(len(bags), *(np.array(x) for x in zip(*pairs, strict=True)))
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: (int(label[i]), bool(label[i] == i)) for i in range(len(texts))}
    assert len({c for c, _ in got.values()}) > 3


def test_null_and_repeated_keys_keep_their_texts(spark):
    """Rows of one key, or of none, are judged by their own texts."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(None, a), (None, b), (None, a + " tail"), (5, b), (5, a), (7, b + " tail")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == [("5", 5), ("5", 5), ("7", 5), ("None", 5), ("None", 5), ("None", 5)]


def test_toxicity_sample_is_bounded_by_keys(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "w" * 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels).count() <= 2


def test_doubles_are_compared_as_doubles(spark):
    """Two vectors that floats cannot tell from the border."""
    angle = math.acos(0.95)
    rows = [(1, [1.0, 0.0]), (2, [math.cos(angle - 1e-10), math.sin(angle - 1e-10)]), (3, [math.cos(angle + 1e-10), -math.sin(angle + 1e-10)])]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
