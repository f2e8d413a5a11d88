"""The methods against brute force, round trips and held-out rows."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import embedding_dedup, media, minhash_dedup, packing, pii, pitman_yor, quality, seating, toxicity
from lodestone.llm.components import connected_components, local_components

SF = "/root/testdata/sf0.001"


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    wrong = []
    for top in (1, 4, 30) * 20:
        h = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        a = rng.integers(0, top + 1, len(h))
        b = np.where(rng.random(len(h)) < 0.7, a, rng.integers(0, top + 1, len(h)))
        x, y = (h[a > 0], a[a > 0]), (h[b > 0], b[b > 0])
        wrong.append((minhash_dedup.bag_minhash(*x) == minhash_dedup.bag_minhash(*y)).mean() - minhash_dedup.overlap(x, y))
    assert abs(np.mean(wrong)) < 0.015 and np.std(wrong) < 0.06


def _classes(texts):
    shingles = minhash_dedup.Shingler()
    bags = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(bags)
    a, b = zip(*[(x, y) for x in range(len(ids)) for y in range(x) if minhash_dedup.overlap(bags[ids[x]], bags[ids[y]]) >= 0.8], strict=True)
    label = local_components(len(ids), np.array(a), np.array(b))
    return {i: ids[label[k]] for k, i in enumerate(ids)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(25)]
    texts = {}
    for i in range(700):  # group 0 is a large group of near copies at all distances
        b = list(base[0 if i % 3 == 0 else rng.randrange(25)])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            b[rng.randrange(len(b))] = rng.choice(words)
        texts[i] = " ".join(b)
    old, minhash_dedup.TILE = minhash_dedup.TILE, 32
    try:
        got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    finally:
        minhash_dedup.TILE = old
    assert {r.doc_id: r.component_id for r in got} == _classes(texts)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    good = [(a, b) for a, b in edges if a is not None and a != b]
    label = local_components(500, np.array([a for a, _ in good]), np.array([b for _, b in good]))
    assert got == {i: int(label[i]) for e in good for i in e}


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 16)) * rng.choice([0.0, 0.1, 0.22], 500)[:, None]
    x = x.astype(np.float32)
    old, embedding_dedup.TILE_BYTES = embedding_dedup.TILE_BYTES, 40 * 16 * 4
    try:
        got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    finally:
        embedding_dedup.TILE_BYTES = old
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = local_components(500, *np.nonzero(near))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(near[i].sum()), int(label[i])) for i in range(500)}


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in _EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in _PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "b-", "1", "23", "4", "+", " ", "-", "(", ")", "0", "255", "é", "x@y.", "9.9", "4111 1111 1111 1111", "＠", " at ", " dot ", "five ", "[at]", "O", "l", "​"]), max_size=25).map("".join))
def test_pii_base_and_offsets(t):
    base, every = pii.find_spans(t)
    assert base == _plain(t) and set(base) <= set(every)
    assert all(0 <= a < b <= len(t) for _, a, b in every)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("john.doe at mail dot example dot com", "email", "john.doe at mail dot example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call +1 (555) five five five one two three four ok", "phone", "+1 (555) five five five one two three four"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("ip one nine two dot 168 dot 1 dot 1.", "ip", "one nine two dot 168 dot 1 dot 1"),
        ("a​b@exam​ple.com", "email", "a​b@exam​ple.com"),
    ],
)
def test_pii_disguises(text, kind, found):
    assert (kind, text.index(found), text.index(found) + len(found)) in pii.find_spans(text)[1]


def test_pii_leaves_prose_alone():
    assert pii.find_spans("Meet me at example.com at nine. One of the three dots, point five.")[1] == []
    assert pii.redact("write to a.b@c.de or call +49 (30) 1234-5678!") == "write to <EMAIL> or call <PHONE>!"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=20_000))
def test_media_round_trip(data):
    payload = media.pad(data)
    stored = media.write_media(payload)
    index = media.read_index(stored)
    assert media.read_payload(stored, index) == payload and index["codec"] == "raw "
    assert index["duration"] == index["ticks"] == len(payload) and sum(n for _, n in index["samples"]) == len(payload)
    assert [k for k, _ in index["keyframes"]] == [a for a, _ in index["samples"]][:: media.KEYFRAME_EVERY]


def test_media_refuses_broken_boxes():
    with pytest.raises(ValueError):
        list(media.walk(struct.pack(">I4s", 100, b"moov")))


def test_packer_keeps_every_id():
    rng = random.Random(4)
    packer, out, docs = packing.Packer(64, 4), [], []
    for k in range(400):
        ids = np.array([rng.randrange(1000) for _ in range(rng.choice([1, 5, 20, 63, 64, 65, 200]))], "<u4")
        docs.append(ids)
        out += packer.add(k, ids)
        assert len(packer.windows) <= 4
    out += packer.finish()
    for k, ids in enumerate(docs):
        assert np.concatenate([p[2] for p in sorted((p for p in out if p[0] == k), key=lambda p: p[1])]).tolist() == ids.tolist()
    used = {}
    for p in out:
        assert used.get(p[4], 0) == p[5]
        used[p[4]] = p[5] + len(p[2])
    assert max(used.values()) <= 64 and sum(used.values()) / (64 * len(used)) > 0.85


def test_packer_against_a_slow_one():
    """Best fit, the fullest out, leftovers merged: by plain search over the open windows."""
    rng, length, most = random.Random(8), 32, 5
    docs = [np.array([rng.randrange(1000) for _ in range(rng.choice([1, 2, 7, 15, 31, 32, 33, 90]))], "<u4") for _ in range(300)]
    slow, open_, opened = [], [], 0

    def room(w):
        return length - sum(len(p[2]) for p in w[1])

    for k, ids in enumerate(docs):
        cuts = [(at, ids[at : at + length]) for at in range(0, len(ids), length)]
        for at, piece in cuts:
            if len(piece) == length:
                slow.append([(k, at, piece)])
                continue
            fits = [w for w in open_ if room(w) >= len(piece)]
            if fits:
                w = min(fits, key=lambda w: (room(w), w[0]))
            else:
                if len(open_) == most:
                    out = min(open_, key=lambda w: (room(w), w[0]))
                    open_.remove(out)
                    slow.append(out[1])
                w, opened = (opened, []), opened + 1
                open_.append(w)
            w[1].append((k, at, piece))
            if not room(w):
                open_.remove(w)
                slow.append(w[1])
    packer, got = packing.Packer(length, most), []
    for k, ids in enumerate(docs):
        got += packer.add(k, ids)
    closed = packer.sequences
    assert closed == len(slow)
    at = {}
    for k, start, ids, total, sequence, offset in got:
        at.setdefault(sequence, []).append((k, start, ids.tolist()))
        assert total == len(docs[k])
    assert [at[i] for i in range(closed)] == [[(k, s, p.tolist()) for k, s, p in w] for w in slow]
    rest = list(packer.finish())
    left = [x for w in sorted(open_, key=lambda w: (room(w), w[0])) for p in w[1] for x in p[2].tolist()]
    assert [x for p in rest for x in p[2].tolist()] == left
    assert len({p[4] for p in rest}) == -(-len(left) // length)


def test_piece_checksums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {}
    for r in packing.pack(docs, with_ids=True).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        ids.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for pieces in ids.values():
        assert sum(len(p[1]) for p in pieces) == pieces[0][2]


def test_tokenizers_agree(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|> here", "a b　c", "naïve café", "日本語 text", "​ x", "a  \n\n b", "don't I'LL", "\x1c\x85 x", "ﬁ ½ ٣"]
    assert packing.tokenizer()(texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_language_model_counts_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in pitman_yor.score_documents(docs, held=pitman_yor.held_out(docs.doc_id), chunk_tokens=5_000).collect()}
    rows = {r.doc_id: pitman_yor.tokens(r.text) + [None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    count = {}
    for i, words in rows.items():
        for w in words if not held[i] else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, words in rows.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (held[i], len(words), n)
        assert got[i].n_known == sum(w in count for w in words)
        assert got[i].base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    unseen = [i for i in rows if held[i]]
    assert sum(got[i].score for i in unseen) > sum(got[i].base_score for i in unseen)


def plain_sampler(triples, params, vocabulary, sweeps, rng):
    """One machine, one customer at a time through the three levels; probabilities of all triples, averaged."""
    (d0, d1, d2), (s0, s1, s2) = params.discount, params.strength
    seats, of = {}, [{}, {}, {}]  # sizes of tables by (level, context, word); [customers, tables] by context

    def total(level, ctx):
        return of[level].setdefault(ctx, [0, 0])

    def p(level, two, one, w):
        if level < 0:
            return 1 / vocabulary
        ctx = ((), (one,), (two, one))[level]
        d, s = params.discount[level], params.strength[level]
        own, (c, t) = seats.get((level, ctx, w), []), total(level, ctx)
        return (sum(own) - d * len(own) + (s + d * t) * p(level - 1, two, one, w)) / (s + c)

    def add(level, two, one, w):
        if level < 0:
            return
        ctx = ((), (one,), (two, one))[level]
        d, s = params.discount[level], params.strength[level]
        own, all_ = seats.setdefault((level, ctx, w), []), total(level, ctx)
        new = (s + d * all_[1]) * p(level - 1, two, one, w)
        r = rng.random() * (new + sum(own) - d * len(own))
        all_[0] += 1
        if r < new or not own:
            own.append(1)
            all_[1] += 1
            add(level - 1, two, one, w)
            return
        r -= new
        for k, n in enumerate(own):
            r -= n - d
            if r < 0 or k == len(own) - 1:
                own[k] += 1
                return

    def remove(level, two, one, w):
        if level < 0:
            return
        ctx = ((), (one,), (two, one))[level]
        own, all_ = seats[level, ctx, w], total(level, ctx)
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        all_[0] -= 1
        if not own[k]:
            own.pop(k)
            all_[1] -= 1
            remove(level - 1, two, one, w)

    for x in triples:
        add(2, *x)
    out = dict.fromkeys(triples, 0.0)
    for k in range(sweeps):
        for x in triples:
            remove(2, *x)
            add(2, *x)
        if k >= sweeps // 4:
            for x in out:
                out[x] += p(2, *x) / (sweeps - sweeps // 4)
    return out


def test_seating_against_a_plain_sampler():
    rng, params = random.Random(2), seating.Params((0.4, 0.6, 0.7), (1.0, 1.5, 2.0))
    triples = [(rng.randrange(3), rng.randrange(3), min(int(rng.expovariate(0.7)), 5)) for _ in range(150)]
    want = plain_sampler(triples, params, 7, 600, rng)
    keys = sorted(want, key=lambda x: (x[1], x[2], x[0]))
    count = np.array([triples.count(k) for k in keys])
    one, word, two = (np.array([k[n] for k in keys]) for n in (1, 2, 0))
    family = pitman_yor._changes(one, word)
    index = np.cumsum(family) - 1
    context = np.unique(one * 3 + two, return_inverse=True)[1]
    for width, scan in ((1, 1 << 18), (1000, 1 << 18), (1000, 5)):
        seating.WIDTH, seating.SCAN = width, scan
        try:
            s = seating.Seating(index, context, count, np.unique(one[family], return_inverse=True)[1], params, np.random.default_rng(4))
            words, at = np.unique(word[family], return_inverse=True)
            got, n = np.zeros(len(keys)), 500
            for k in range(n):
                root = np.bincount(at, weights=s.up_tables).astype(np.int64)
                tables = seating.seat_root(root, 1 / 7, len(words), params, np.random.default_rng(k), 1)
                s.know_root(root[at], tables[at], s.up_tables.copy(), (int(root.sum()), int(tables.sum())), 7)
                s.sweep(enter=k == 0)
                assert s.sizes.sum() == count.sum() and s.up_sizes.sum() == s.tables.sum() and len(s.up_sizes) == s.up_tables.sum()
                if k >= n // 5:
                    got += s.predictive() / (n - n // 5)
        finally:
            seating.WIDTH, seating.SCAN = 48, 1 << 18
        ratio = got / np.array([want[k] for k in keys])
        assert abs(np.log(ratio)).max() < 0.15 and abs(np.log(ratio).mean()) < 0.03


def test_predictive_sums_to_one():
    """Over all words of a seen context, and the unknown one."""
    rng, words = np.random.default_rng(0), 40
    one, word, two = (x.ravel() for x in np.meshgrid([0, 3], np.arange(words), [0, 5], indexing="ij"))
    count = np.where(rng.random(len(one)) < 0.3, rng.integers(1, 20, len(one)), 0)
    row = {"bucket": 0, "one": pitman_yor.pack(np.diff(one, prepend=0)), "word": pitman_yor.pack(pitman_yor._steps(word, pitman_yor._changes(one))), "two": pitman_yor.pack(two), "count": pitman_yor.pack(count), "split": pitman_yor.pack(one == 3)}
    bucket, params = pitman_yor.Bucket(row, 3), seating.Params((0.5, 0.6, 0.7), (1.0, 1.0, 1.0))
    assert np.array_equal(bucket.count, count) and np.array_equal(bucket.words[bucket.root_of][bucket.family], word)
    s = bucket.seating(params, np.random.default_rng(1))
    replies = []
    for number, owner, kind, a, b, c in bucket.messages(s):
        assert number == 0 and len(pitman_yor.unpack(b)) == len(pitman_yor.unpack(c))
        if kind == pitman_yor._ROOT:
            c = pitman_yor.pack((pitman_yor.unpack(b) > 0).astype(int))
        replies.append({"kind": kind, "owner": owner, "b": b, "c": c})
    root = np.bincount(bucket.root_of, weights=s.up_tables)
    total = int(root.sum()), int((root > 0).sum())
    bucket.listen(s, replies, total, words + 1)
    assert not any(x.any() for x in (*s.extra_low, *s.extra_mid))  # all parts of the dealt-out restaurants are here
    for k in range(3):
        s.sweep(enter=k == 0)
    root = np.bincount(bucket.root_of, weights=s.up_tables, minlength=words).astype(np.int64)
    s.know_root(root[bucket.root_of], np.minimum(root, 1)[bucket.root_of], s.up_tables.copy(), (int(root.sum()), int((root > 0).sum())), words + 1)
    p = s.predictive()
    for ctx in range(4):
        t0 = (params.strength[0] + params.discount[0] * s.root[1]) / (words + 1) / (params.strength[0] + s.root[0])
        mid = bucket.middle[bucket.family[bucket.context == ctx][0]]
        t1 = (params.strength[1] + params.discount[1] * s.mid_tables[mid]) * t0 / (params.strength[1] + s.mid_customers[mid])
        t2 = (params.strength[2] + params.discount[2] * s.low_tables[ctx]) * t1 / (params.strength[2] + s.low_customers[ctx])
        assert p[bucket.context == ctx].sum() + t2 == pytest.approx(1)


def test_packed_numbers():
    for x in ([], [0], [255, 256], [1 << 16, 3], [(1 << 40) + 5, 0, 7]):
        assert pitman_yor.unpack(pitman_yor.pack(np.array(x, np.int64))).tolist() == x
    x, new = np.array([3, 5, 9, 2, 2, 8]), np.array([1, 0, 0, 1, 0, 0], bool)
    assert np.array_equal(pitman_yor._sums(pitman_yor._steps(x, new), new), x)


def test_scores_do_not_depend_on_chunks(spark):
    """Dealt into many chunks, buckets and parts of hot words, the counts agree and the scores nearly so."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = pitman_yor.held_out(docs.doc_id)
    a = {r.doc_id: r for r in pitman_yor.score_documents(docs, held=held).collect()}
    b = {r.doc_id: r for r in pitman_yor.score_documents(docs.repartition(3), held=held, chunk_tokens=2_000, bucket_tokens=3_000, hot_tokens=200).collect()}
    assert all(a[i].base_score == pytest.approx(b[i].base_score) and a[i].n_known == b[i].n_known for i in a)
    assert sum(r.score for r in a.values()) == pytest.approx(sum(r.score for r in b.values()), rel=0.03)


def test_quality_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = quality.score(docs, quality.fit(docs)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    assert right / len(got) > 0.95


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    held = labels.filter(toxicity.held_out(labels.doc_id)).select("doc_id", "toxic")
    got = toxicity.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").collect()
    hits = [r.score >= 0.3 for r in got if r.toxic == 1]
    false = [r.score >= 0.3 for r in got if r.toxic == 0]
    assert sum(hits) / len(hits) > 0.85 and sum(false) / len(false) < 0.02


def test_toxicity_folds_and_exceptions():
    model = toxicity.ToxicityModel({"idiot": 5.0, "moron*": 4.0}, ["idiot savant"], (-3.0, 1.0, 1.0))
    found = model.automaton()
    hit = lambda t: model.features(t, found)[0] > 0
    assert hit("you 1d10t!") and hit("YOU IDІOT.") and hit("ídiot") and hit("moronic") and not hit("an idiot savant plays") and not hit("idiotic")
