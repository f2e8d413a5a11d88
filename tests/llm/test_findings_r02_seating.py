"""Finding 1 of round 2 (op2_pitman_yor): seats are laid out once for all sweeps, texts are cut by column, with the same results."""

import gc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import pitman_yor, seating


def families(seed=5):
    rng = np.random.default_rng(seed)
    family = np.unique(np.sort(rng.integers(0, 60, 300)), return_inverse=True)[1]
    context, count = np.arange(300) % 7 + 7 * (family % 5), rng.integers(0, 30, 300)
    s = seating.Seating(family, context, count, np.arange(family.max() + 1) % 5, seating.Params(), np.random.default_rng(seed))
    s.know_root(np.full(len(s.held), 9), np.full(len(s.held), 3), s.up_tables.copy(), (400, 90), 60)
    return s


@pytest.mark.parametrize(("width", "scan"), [(1, 1 << 18), (1000, 1 << 18), (8, 60)])
def test_sweeps_go_on_where_the_last_one_left_the_seats(monkeypatch, width, scan):
    """Laid out once; a seating that is written down and read between the sweeps has the same tables."""
    monkeypatch.setattr(seating, "WIDTH", width)
    monkeypatch.setattr(seating, "SCAN", scan)
    laid, plain = [], seating._Laid.__init__
    monkeypatch.setattr(seating._Laid, "__init__", lambda self, *a: laid.append(1) or plain(self, *a))
    means = []
    for again in (False, True):
        s, tables = families(), []
        for k in range(60):
            s.sweep(enter=k == 0)
            if again:
                s.sizes, s.up_sizes = s.sizes.copy(), s.up_sizes.copy()
            tables.append((s.tables.sum(), s.up_tables.sum()))
        owner = np.repeat(np.arange(300), s.tables)
        assert np.array_equal(np.bincount(owner, weights=s.sizes, minlength=300), s.count) and (s.sizes > 0).all()
        assert np.array_equal(np.bincount(np.repeat(np.arange(len(s.held)), s.up_tables), weights=s.up_sizes, minlength=len(s.held)), s.up_customers)
        assert len(laid) == (61 if again else 1)
        means.append(np.mean(tables[10:], axis=0))
    assert np.abs(np.log(means[0] / means[1])).max() < 0.05


def test_a_seating_goes_without_the_garbage_collector():
    gc.disable()
    try:
        s = families()
        s.sweep(enter=True)
        s.sweep()
        gone = weakref.ref(s._laid)
        del s
        assert gone() is None
    finally:
        gc.enable()


TEXTS = [None, "", "  ", " a  B\tc\x0bd\x0ce\rf\n", "x\x1cy\x85z é É　k", "KK İ", "a", "\x00 \x1f", "\n\n"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_a_column_are_those_of_its_texts(kind):
    words, number = pitman_yor._words(pa.array(TEXTS, kind))
    right = [pitman_yor.tokens(x) for x in TEXTS]
    assert [w.encode() for w in words.to_pylist()] == sum(right, []) and number.tolist() == [len(x) for x in right]
    for few in (TEXTS[:3], []):
        words, number = pitman_yor._words(pa.array(few, kind))
        assert len(words) == 0 and number.tolist() == [0] * len(few)


def test_chunks_end_with_the_row_that_fills_them(spark):
    texts = [(k, " ".join(f"w{j % 5}" for j in range(n))) for k, n in enumerate([0, 9, 10, 3, 3, 3, 25, 0, 1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = pitman_yor._gather(docs, "doc_id", "text", pitman_yor.F.lit(False), 3, 10).filter("owner < 0").orderBy("chunk").collect()
    assert [r["keys"] for r in rows] == [[0, 1], [2], [3, 4, 5], [6], [7, 8]]
    assert [r["lengths"] for r in rows] == [[1, 10], [11], [4, 4, 4], [26], [1, 2]]
    assert [len(pitman_yor.unpack(r["a"])) for r in rows] == [sum(r["lengths"]) for r in rows]


@pytest.mark.parametrize("x", [[], [0], [5, 255], [256, 3], [1 << 16], [1 << 40, 2], [1 << 62, 0]])
def test_numbers_are_packed_byte_after_byte_of_all(x):
    x = np.array(x, np.int64)
    raw = pitman_yor.pack(x)
    planes = pa.decompress(raw[9:], raw[0] * len(x), "zstd", asbytes=True)
    assert planes == b"".join(bytes(int(y) >> 8 * k & 255 for y in x) for k in range(raw[0]))
    assert np.array_equal(pitman_yor.unpack(raw), x)
