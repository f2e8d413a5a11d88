"""The cache in search, proposed variants, token counts, retries and long texts."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.plans import ingest, ops, search, seams


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    warehouse = ingest.Warehouse(spark, f"file://{tmp_path_factory.mktemp('store')}")
    texts = spark.createDataFrame(
        [("a.txt", "The reset button is behind the small cover."), ("b.txt", "Batteries last for two years."), ("c.txt", "Keep the cover closed in rain.")], "filename string, text string"
    )
    texts = texts.select("*", F.lit(None).cast("string").alias("format_text"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("struct<code:string,message:string>").alias("error"))
    ingest.ingest_texts(warehouse, texts, "manual")
    return warehouse


def asked(spark, store):
    ids = [r.id for r in store.read("datasets").collect()]
    return spark.createDataFrame([("1", "reset button", ids), ("2", "batteries", ids)], "query_id string, query string, dataset_ids array<string>")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "cite_id", "chunk_id", "score", "text").collect())


def test_cache(spark, store):
    queries, chunks = asked(spark, store), store.read("chunks")
    cache = ops.Cache(store, "search")
    versions = store.read("datasets").select(F.col("id").alias("dataset_id"), F.lit(1).alias("version"))
    first = rows(search.search_cached(cache, chunks, queries, versions))
    assert first == rows(search.search(chunks, queries)) and cache.counts == {"hit": 0, "miss": 2, "unavailable": 0}
    assert rows(search.search_cached(cache, chunks, queries, versions)) == first and cache.counts["hit"] == 2
    search.search_cached(cache, chunks, queries, ops.invalidate(versions))
    assert cache.counts["miss"] == 4
    later = ops.Cache(store, "search", F.current_timestamp() + F.expr("interval 1 hour"))
    assert rows(search.search_cached(later, chunks, queries, versions)) == first and later.counts["miss"] == 2


def test_cache_that_is_away(spark, store):
    class Away:
        def version(self, name):
            raise OSError("no store")

    cache = ops.Cache(Away(), "search")
    versions = store.read("datasets").select(F.col("id").alias("dataset_id"), F.lit(1).alias("version"))
    queries = asked(spark, store)
    assert rows(search.search_cached(cache, store.read("chunks"), queries, versions)) == rows(search.search(store.read("chunks"), queries))
    assert cache.counts == {"hit": 0, "miss": 0, "unavailable": 2}


def test_variants_are_proposed(spark, store):
    seen = search.search(store.read("chunks"), asked(spark, store), provider=lambda q: [f"{q} cover", "rain"], pause=0.0)
    assert seen.filter("query_id = '2' and source = 'vector'").count() > 0
    seen = search.search(store.read("chunks"), asked(spark, store), provider=lambda q: 1 / 0, pause=0.0)
    assert rows(seen) == rows(search.search(store.read("chunks"), asked(spark, store)))


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([("The reset button",), ("",), (None,)], "text string")
    got = seams.count_tokens(docs, vocabulary=tokenizers.path("byte_bpe_50k.json")).collect()
    assert [r.tokens for r in got] == [3, 0, None]
    assert [r.tokens for r in seams.count_tokens(docs).collect()] == [4, 0, None]


def test_long_texts_keep_their_end(spark):
    docs = spark.createDataFrame([("x" * 30,)], "text string")
    got = seams.normalise_structure(docs, lambda t: f"# head\n{t}", "force", most=10, pause=0.0).first()
    assert got.text == "# head\n" + "x" * 30 and not got.degraded


def test_pauses(monkeypatch):
    slept = []
    monkeypatch.setattr(seams.time, "sleep", slept.append)
    for double in (False, True):
        with pytest.raises(ZeroDivisionError):
            seams.with_retries(lambda: 1 / 0, attempts=6, pause=1.0, double=double)
    assert slept == [1, 2, 3, 4, 5, 1, 2, 4, 8, 10]


def test_batches_of_queries(spark, monkeypatch):
    """Small tiles and blocks, broadcast or not, odd vectors: the same as by hand."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    rows = [(i, v.tolist(), "g") for i, v in enumerate(x)] + [(300, None, "g"), (301, [0.0] * 6, "g"), (302, [1.0], "g"), (303, [None] * 6, "g"), (304, x[5].tolist(), "h")]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, d string").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist(), ["g"]) for i in range(40)] + [(90, [0.0] * 6, ["g"]), (91, None, ["g"])], "query_id long, embedding array<double>, ds array<string>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in range(40):
        s = np.round(u @ u[q], retrieval.DECIMALS)
        for pos, i in enumerate(sorted(range(300), key=lambda i: (-s[i], i))[:4]):
            want[q, pos + 1] = (i, s[i])
    monkeypatch.setattr(retrieval, "TILE_ROWS", 32)
    for limit in (64 << 20, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", limit)
        got = retrieval.vector_topk_batch(chunks, asked, 4, block=7, group="d", groups="ds").collect()
        assert {(r.query_id, r.pos): (r.chunk_id, r.score) for r in got} == want


def test_token_budget_streams(spark):
    from lodestone.operators import filters

    hits = spark.createDataFrame([(k, p, c) for k in ("a", None) for p, c in ((1, 5), (2, 7), (3, 4), (4, None), (5, 1), (6, 1))], "query_id string, pos int, tokens int")
    got = filters.token_budget(hits, 10).collect()
    assert sorted((str(r.query_id), r.pos) for r in got) == sorted((k, p) for k in ("a", "None") for p in (1, 3, 4, 5))
