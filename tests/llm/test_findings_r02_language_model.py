"""Finding 2 of round 2 (op2_pitman_yor): fewer sorts of a bucket and a chunk, with the same orders."""

import numpy as np
import pytest

from lodestone.llm import pitman_yor


def test_orders_of_wide_columns_fit_one_number(monkeypatch):
    """Ids of 23 bits in three columns, of which a bucket has few in the first: no sort by columns one after another."""
    rng = np.random.default_rng(1)
    one = rng.choice(rng.integers(0, 1 << 23, 50), 4000)
    word, two = rng.choice(rng.integers(0, 1 << 23, 60), 4000), rng.integers((1 << 23) - 30, 1 << 23, 4000)
    right = np.lexsort((two, word, one))
    monkeypatch.setattr(np, "lexsort", None)
    assert np.array_equal(pitman_yor._order(one, word, two), right)


def test_orders_of_columns_that_fit_no_number():
    rng = np.random.default_rng(2)
    columns = [rng.choice(rng.integers(0, 1 << 40, 50), 1000) for _ in range(3)]
    assert np.array_equal(pitman_yor._order(*columns), np.lexsort(columns[::-1]))
    none = np.zeros(0, np.int64)
    assert len(pitman_yor._order(none, none, none)) == 0


@pytest.mark.parametrize("most", [1, 7, 1 << 40, (1 << 62) - 1])
@pytest.mark.parametrize("n", [0, 1, 1000])
def test_distinct_numbers_and_places(most, n):
    x = np.random.default_rng(3).integers(0, most, n)
    for got, right in zip(pitman_yor._distinct(x), np.unique(x, return_inverse=True), strict=True):
        assert np.array_equal(got, right)


def test_contexts_of_a_bucket_are_its_pairs_of_words():
    one, word, two = np.array([3, 3, 3, 9, 9, 9]), np.array([1, 1, 4, 1, 4, 4]), np.array([5, 7, 5, 5, 5, 7])
    new = pitman_yor._changes(one)
    row = {"bucket": 0, "one": pitman_yor.pack(np.diff(one, prepend=0)), "word": pitman_yor.pack(pitman_yor._steps(word, new)), "two": pitman_yor.pack(two), "count": pitman_yor.pack(np.ones(6, np.int64)), "split": pitman_yor.pack(one == 9)}
    bucket = pitman_yor.Bucket(row, 2)
    assert bucket.context.tolist() == [0, 1, 0, 2, 2, 3]
    assert bucket.split_low.tolist() == [2, 3] and bucket.split_mid.tolist() == [1]
