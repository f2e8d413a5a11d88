"""Small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from lodestone.llm import embedding_dedup, media, minhash_dedup, mixing, packing, pii, pitman_yor, quality, toxicity, url_filter
from lodestone.session import materialise

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, "one two three four five six seven eight nine ten eleven"),
    (2, "one two three four five six seven eight nine ten eleven"),
    (3, ""),
    (4, None),
    (None, "a text whose row has no id at all but some words"),
    (5, LONG),
    (6, LONG + " tail"),
    (7, "short"),
    (8, "short"),
    (9, "   \n\t "),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, id string, bucket string, score string, source string, n_chars long, row string, _kept_key string, kept string"
    return spark.createDataFrame([(i, t, "x", "y", "z", "s", 1, "r", "c", "k") for i, t in TEXTS], schema).repartition(3)


def rows_of(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_minhash(docs):
    got = rows_of(minhash_dedup.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(TEXTS)
    assert [r.component_id for r in got[2]] == [1, 1] and not got[2][0].kept and got[1][0].kept
    assert got[6][0].component_id == 5 and got[8][0].component_id == 7
    assert got[3][0].component_id == 3 and got[4][0].kept and got[9][0].kept
    assert got[None][0].component_id is None and not got[None][0].kept
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_stage(docs):
    kept = minhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "7", "9", "None"]


def test_language_model(docs, spark):
    got = rows_of(pitman_yor.score_documents(docs, held=docs.doc_id == 7))
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[3][0].n_tokens == 1 and got[4][0].n_tokens == 1 and got[1][0].n_tokens == 12
    assert all(r.score < 0 for x in got.values() for r in x)
    empty = docs.limit(0)
    assert pitman_yor.score_documents(empty).count() == 0
    nothing = pitman_yor.score_documents(docs, held=docs.text.isNull() | docs.text.isNotNull()).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in nothing)


def test_urls(spark):
    urls = ["http://a.example.com/en/7", "HTTPS://EXAMPLE.com/en/7?x=1", "http://com/en/", None, "no scheme", "http://net", "http://x.net#f", "http://..com/en/x", "http://example.com/en/7"]
    table = spark.createDataFrame([(i, u, "own", "old") for i, u in enumerate(urls)], "page_id long, url string, best string, host string")
    table = table.unionByName(table.filter("page_id = 0"))
    got = rows_of(url_filter.judge_urls(table, url_filter.rules_frame(spark, url_filter.RULES)), "page_id")
    assert len(got[0]) == 2 and {r.rule for r in got[0]} == {"example.com/en/7"} and got[0][0].verdict == "allow"
    assert (got[1][0].host, got[1][0].path, got[1][0].verdict) == ("example.com", "/en/7", "allow")
    assert got[2][0].rule == "com/en/" and got[2][0].verdict == "block"
    assert [(got[i][0].host, got[i][0].path, got[i][0].rule, got[i][0].verdict) for i in (3, 4)] == [("", "", None, "allow")] * 2
    assert got[5][0].path == "" and got[6][0].host == "x.net" and got[7][0].verdict == "block"
    assert url_filter.judge_urls(table.limit(0), url_filter.rules_frame(spark, url_filter.RULES)).count() == 0
    none = url_filter.judge_urls(table, url_filter.rules_frame(spark, []), default="block")
    assert {r.verdict for r in none.collect()} == {"block"}


def test_url_rules_clash(spark):
    rules = [("x.org", "/a", "allow"), ("x.org", "/a", "block"), (None, "/", "block"), ("", "/", "block"), ("y.org", None, "block")]
    urls = spark.createDataFrame([(1, "http://x.org/ab"), (2, "http://y.org/")], "page_id long, url string")
    got = rows_of(url_filter.judge_urls(urls, url_filter.rules_frame(spark, rules)), "page_id")
    assert got[1][0].verdict == "block" and got[2][0].rule == "y.org"


def test_mixing(docs):
    got = mixing.mix(docs, block_rows=2).collect()
    assert sorted(r.position for r in got) == list(range(len(TEXTS)))
    laid = mixing.in_order(mixing.mix(docs, block_rows=2), len(TEXTS))
    assert laid.columns == docs.columns and laid.count() == len(TEXTS)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_null_source_and_targets(spark):
    table = spark.createDataFrame([(i, None if i % 3 == 0 else "a" if i % 3 == 1 else "b") for i in range(300)], "doc_id long, source string")
    got = mixing.mix(table, targets={"a": 0.6, "b": 0.4}, block_rows=4, cycle=100).collect()
    assert sorted(r.position for r in got) == list(range(300))
    first = [r for r in got if r.slot < 20]
    share = {s: len({r.slot for r in first if r.row.source == s}) for s in ("a", "b", None)}
    assert abs(share["a"] - 12) <= 1 and abs(share["b"] - 8) <= 1 and share[None] <= 1


def test_mixing_many_sources(spark):
    """2,000 small sources and a hot one: any number of sources, and the hot one keeps its target in every prefix."""
    table = spark.range(20_000).selectExpr("id as doc_id", "case when id < 12000 then 'hot' else concat('s', id % 2000) end as source")
    targets = {"hot": 0.9} | {f"s{i}": 0.00005 for i in range(2000)}
    got = sorted(mixing.mix(table, targets=targets, block_rows=4).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(20_000))
    slots = {r.slot: r.row.source for r in got}
    hot = 0
    for t in range(min(3_000, max(slots))):
        assert abs(hot - 0.9 * t) < 1 + t / mixing.CYCLE
        hot += slots.get(t) == "hot"
    blocks = [r.block for r in got if r.row.source == "s7"]
    assert blocks == sorted(blocks)


@pytest.mark.parametrize("key", ["cast(null as bigint)", "7L"])
def test_mixing_one_key(spark, key):
    """Null or repeated keys do not put a source's rows into one part."""
    table = spark.range(20_000).selectExpr(f"{key} as doc_id", "'s' as source", "cast(id as string) as text")
    got = mixing.mix(table)
    assert got.agg({"position": "max"}).first()[0] == 19_999 and got.select("position").distinct().count() == 20_000


def test_lane_deviation(spark):
    """Every prefix of a cycle holds each lane to less than one block from its share."""
    shares = [700, 200, 50, 30, 20, 20, 3, 1]
    lanes = spark.createDataFrame(list(enumerate(shares)), "j long, q long")
    slots = {r.slot: r.j for r in mixing.cycle_schedule(lanes).collect()}
    done, d = [0] * len(shares), sum(shares)
    assert sorted(slots) == list(range(d))
    for t in range(d):
        done[slots[t]] += 1
        assert all(abs(n - q * (t + 1) / d) < 1 for n, q in zip(done, shares, strict=True))


def test_media(docs):
    got = rows_of(media.store_media(docs))
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[3][0].media == got[4][0].media and got[1][0].media == got[2][0].media == got[2][1].media
    for i, t in TEXTS:
        for r in got[i]:
            index = media.read_index(r.media)
            assert media.read_payload(r.media, index) in {media.pad((x or "").encode()) for k, x in TEXTS if k == i}
    assert media.store_media(docs.limit(0)).count() == 0


def test_media_digest(spark, docs):
    """Every column again from the stored bytes, and nulls for a null file."""
    got = rows_of(media.media_digest(media.store_media(docs)))
    for r in media.store_media(docs).collect():
        payload = media.read_payload(bytes(r.media), media.read_index(bytes(r.media)))
        want = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(r.media), hashlib.sha256(r.media).hexdigest())
        assert want in [(x.payload_bytes, x.payload_sha256, x.tail_crc32, x.media_bytes, x.media_sha256) for x in got[r.doc_id]]
    none = spark.createDataFrame([(1, None, "x")], "doc_id long, media binary, feature string")
    assert tuple(media.media_digest(none).first()) == (1, None, None, None, None, None, None)
    assert media.media_digest(none.limit(0)).count() == 0


def test_stages(spark, docs):
    """Each stage of the pipeline on the small table, and on an empty one."""
    labels = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            if name == "packing":
                table = materialise(table, "test-small")
            out = stage(spark, table, labels)
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns
            assert n == 0 if table is not docs and table.isEmpty() else n > 0


def test_packing(docs):
    got = packing.pack(docs, with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) > 0
            at += r.length
        assert at <= packing.LENGTH
    encode = packing.tokenizer()
    assert sum(r.length for r in by_doc[5]) == len(encode([LONG])[0]) + 1
    assert [list(r.ids) for r in by_doc[3] + by_doc[4]] == [[packing.END_ID]] * 2
    assert len(by_doc[2]) == 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_long_texts(spark):
    """Runs of one character that some tokenizers cannot take, and a key named like a column of the output."""
    long = {1: " " * 2_000_000, 2: "\n" * 2_000_000, 3: "a" * 2_000_000, 4: ("x" * 1_999 + " " * 1_999) * 50}
    table = spark.createDataFrame(list(long.items()), "start long, text string")
    got = packing.pack(table, key="start")
    assert got.columns == ["start", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sums = {}
    for r in got.collect():
        sums[r[0]] = sums.get(r[0], 0) + r.length
        assert sums[r[0]] <= r.doc_tokens
    whole = packing.tokenizer()
    assert sums == {k: len(whole([t])[0]) + 1 for k, t in long.items()}


def test_quality(docs):
    got = rows_of(quality.score(docs, quality.fit(docs)))
    assert sum(map(len, got.values())) == len(TEXTS)
    assert got[1][0].score == got[2][0].score and got[3][0].score == got[4][0].score == got[9][0].score
    empty = docs.limit(0)
    assert quality.score(empty, quality.fit(empty)).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [inf, 1.0]), (10, []), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (12, [-0.0, 3e38]), (13, [1e-40, 0.0])]
    table = spark.createDataFrame([(i, v, "u", "c") for i, v in vectors], "vec_id long, embedding array<float>, uid string, component string")
    got = rows_of(embedding_dedup.near_duplicates(table), "vec_id")
    assert [got[i][0].n_links for i in (1, 2, 3, 13)] == [4, 4, 4, 4] and got[3][0].component_id == 1
    assert [r.n_links for r in got[4]] == [2, 2] and got[12][0].component_id == 4
    for i in (5, 6, 7, 8, 9, 10, 11):
        assert (got[i][0].n_links, got[i][0].component_id, got[i][0].kept) == (0, i, True)
    assert got[None][0].component_id == 1 and not got[None][0].kept
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    got = rows_of(toxicity.score(docs, model))
    assert sum(map(len, got.values())) == len(TEXTS) and all(0 <= r.score <= 1 for x in got.values() for r in x)
    assert got[3][0].score == got[4][0].score
    nothing = toxicity.fit(toxicity.training_rows(docs.limit(0), labels))
    assert toxicity.keep_clean(docs, nothing).count() == len(TEXTS)
    assert toxicity.keep_clean(docs, nothing).columns == docs.columns


def test_pii(docs):
    got = rows_of(pii.detect(docs))
    assert sum(map(len, got.values())) == len(TEXTS) and all(r.spans == [] for r in got[3] + got[4])
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns and clean.filter("text is null").count() == 1
    assert pii.detect(docs.limit(0)).count() == 0
