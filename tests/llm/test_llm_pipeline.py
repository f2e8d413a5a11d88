"""The registered queries, and the pipeline against a brute-force version of each stage."""

import hashlib
import math

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import minhash_dedup, mixing, packing, pii, registry, toxicity
from lodestone.llm.components import local_components
from lodestone.session import materialise

SF = "/root/testdata/sf0.001"


def test_names():
    assert {n.split("_")[0] for n in registry.QUERIES} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, in file order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs))
    return {name: (df.columns, [r.asDict() for r in df.collect()], df) for name, df in out}


def ids(rows):
    return [r["doc_id"] for r in rows]


def test_columns(stages):
    for name in ("toxicity", "near_duplicates", "pii", "mixing"):
        assert stages[name][0] == stages["documents"][0]


def test_toxicity_stage(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    found = model.automaton()
    kept = {r["doc_id"] for r in stages["documents"][1] if model.probability(model.features(r["text"], found)) < toxicity.THRESHOLD}
    assert set(ids(stages["toxicity"][1])) == kept


def test_near_duplicate_stage(stages):
    rows = sorted(stages["toxicity"][1], key=lambda r: r["doc_id"])
    shingles = minhash_dedup.Shingler()
    bags = [shingles(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if minhash_dedup.overlap(bags[i], bags[j]) >= 0.8]
    label = local_components(len(rows), *(np.array(x, int) for x in (zip(*pairs, strict=True) if pairs else ((), ()))))
    assert sorted(ids(stages["near_duplicates"][1])) == [r["doc_id"] for i, r in enumerate(rows) if label[i] == i]


def test_pii_stage(stages):
    before = {r["doc_id"]: r for r in stages["near_duplicates"][1]}
    for r in stages["pii"][1]:
        old = before[r["doc_id"]]
        new = pii.redact(old["text"])
        assert r == {**old, "text": new, "n_chars": old["n_chars"] if new == old["text"] else len(new)}
    assert len(before) == len(stages["pii"][1])


def brute_mix(rows, columns):
    """The order of the ids by slots that are filled one after the other; every source has a lane here."""
    by, weight = {}, {}
    for r in rows:
        text = "|".join("" if r[c] is None else str(r[c]) for c in ["doc_id", *(c for c in columns if c != "doc_id")])
        by.setdefault(r["source"], []).append((hashlib.md5(text.encode()).hexdigest(), r["doc_id"]))
    digest = lambda s: hashlib.md5(("0" if s is None else "1" + s).encode()).hexdigest()
    names = sorted(by, key=digest)
    for s in names:
        by[s] = [i for _, i in sorted(by[s])]
        weight[s] = max(1, round(math.sqrt(len(by[s])) * 1024))
    total = sum(weight.values())
    assert all(w * mixing.OWN_LANE >= total for w in weight.values())
    q = [mixing.CYCLE * weight[s] // total for s in names]
    left = sorted(range(len(names)), key=lambda j: (-(mixing.CYCLE * weight[names[j]] % total), j))
    for j in left[: mixing.CYCLE - sum(q)]:
        q[j] += 1
    d, done, order, t = sum(q), [0] * len(names), [], 0
    size = mixing.BLOCK_ROWS
    while len(order) < len(rows):
        ready = [(-(-(done[i] + 1) * d // q[i]), i) for i in range(len(names)) if done[i] * d // q[i] <= t]
        if ready:
            _, i = min(ready)
            order += by[names[i]][done[i] * size : (done[i] + 1) * size]
            done[i] += 1
        t += 1
    return order


def test_mixing_stage(stages):
    assert ids(stages["mixing"][2].orderBy("doc_id").collect()) == sorted(ids(stages["pii"][1]))
    parts = stages["mixing"][2].inputFiles()
    spark = stages["mixing"][2].sparkSession
    order = [r.doc_id for f in sorted(parts) for r in spark.read.parquet(f).collect()]
    assert order == brute_mix(stages["pii"][1], stages["pii"][0])


def test_packing_stage(stages):
    texts = {r["doc_id"]: r["text"] for r in stages["mixing"][1]}
    encode = packing.tokenizer()
    pieces, sequences = {}, {}
    for r in stages["packing"][1]:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        got = [x for r in sorted(pieces[i], key=lambda r: r["start"]) for x in r["ids"]]
        assert got == [*encode([t or ""])[0], packing.END_ID]
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"][1])


def test_query_columns(spark):
    want = {
        "op2_pitman_yor": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op3_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op5_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op8_embedding_near_dup": ["vec_id", "n_links", "component_id", "kept"],
        "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op10_pii_spans": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }
    for name, columns in want.items():
        assert registry.QUERIES[name](spark, SF).columns[: len(columns)] == columns
