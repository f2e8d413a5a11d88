"""Near-duplicate documents by BagMinHash (operator 1).

A text is the multiset of its five-word shingles. BagMinHash gives each
shingle Poisson processes over a hierarchy of weight intervals; the first point
to reach a register is its value, and two registers agree with the weighted
Jaccard similarity as probability. Bands of registers propose groups, the
registers order and bound the pairs in them, and the exact multiset overlap
decides every link.

A group is cut into tiles; each tile keeps a spanning forest of its likely
pairs and hands on a leader for each of its trees, and the leaders of a group
form tiles again. So a group of near copies of any size costs rows in
proportion to its size. Only what the forests leave apart is compared pair by
pair, and the largest class of a group only with what lies outside it.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, table
from lodestone.llm.components import HOT_KEYS, connected_components, look_up
from lodestone.session import materialise, spread

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
BANDS, BAND_ROWS = 24, 5
#: A pair at the threshold falls below this share of equal registers once in 200,000.
LEAST_EQUAL = 0.64
#: Vertices and shingles in a tile of a group, about.
TILE = 256
TILE_SHINGLES = 200_000
#: Shingles whose registers are found together, about.
STEP_SHINGLES = 32_768

_U = np.uint64
_GOLDEN, _M1, _M2, _BASE = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x100000001B3)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class Shingler:
    """Texts to sorted shingle hashes and their counts; a word's hash costs less than its place in a table."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased words between white space; a text of fewer words than a shingle is one shingle, an empty one has none."""
        words = (text or "").lower().split()
        if not words:
            return np.empty(0, _U), np.empty(0, np.int64)
        h = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words)))
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, min(len(h), self.size), _U)
        for i in range(min(len(h), self.size)):
            out *= _BASE
            out += h[i : i + n]
        out = np.sort(_mix(out))
        at = np.flatnonzero(out[1:] != out[:-1]) + 1
        if len(at) == n - 1:
            return out, np.ones(n, np.int64)
        at = np.concatenate([[0], at])
        return out[at], np.diff(at, append=n)


def bag_minhash(hashes: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """``m`` registers (arrival times) of a multiset with at least one element.

    The weights are whole numbers. The process of a weight is the sum of those
    of the intervals below it: (0, 1], (1, 2], (2, 4], (4, 8] and so on, each
    twice the sum of what lies below, as if the process over all weights had
    been split in halves again and again. The process of an interval has its
    width as rate and marks each point with a place in the interval; an
    element of weight w takes the points up to w. A point depends on element,
    interval and index alone, so that equal points compare equal.
    """
    return bag_minhashes([(hashes, counts)], m)[0]


def bag_minhashes(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """``bag_minhash`` of each of some multisets, a row each, in steps that all of them take together."""
    seeds, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    home = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    low, width = np.zeros(len(seeds)), np.ones(len(seeds))
    level, bound, more = 1, 1, np.flatnonzero(weight > 1)
    parts = [(seeds, low, width, weight, home)]
    while len(more):
        parts.append((_mix(seeds[more] + np.full(1, level, _U) * _GOLDEN), np.full(len(more), float(bound)), np.full(len(more), float(bound)), weight[more], home[more]))
        level, bound = level + 1, bound * 2
        more = more[weight[more] > bound]
    if len(parts) > 1:
        seeds, low, width, weight, home = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, k = np.zeros(len(seeds)), 0
    registers = np.full(len(bags) * m, np.inf)
    while len(seeds):
        step = max(1, min(64, 8192 // len(seeds))) if k else 1
        z = _mix(seeds[:, None] + np.arange(k + 1, k + step + 1, dtype=_U)[None, :] * _GOLDEN)
        gaps = -np.log(((z >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        gaps[:, 0] += time
        arrival = np.cumsum(gaps, axis=1) if step > 1 else gaps
        z = _mix(z ^ _M2)
        place = low[:, None] + (z >> _U(11)).astype(np.float64) * 2.0**-53 * width[:, None]
        taken = place < weight[:, None]
        at = home[:, None] * m + (z % _U(m)).astype(np.int64)
        np.minimum.at(registers, at[taken], arrival[taken])
        time, k = arrival[:, -1], k + step
        active = np.flatnonzero(time < registers.reshape(-1, m).max(axis=1)[home])
        seeds, low, width, weight, home, time = (x[active] for x in (seeds, low, width, weight, home, time))
    return registers.reshape(-1, m)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, exactly."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0).sum())
    return both / (total - both)


def content_key(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    return hashlib.blake2b(bag[0].tobytes() + bag[1].tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, key: str, text: str, m: int = REGISTERS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """``id, text_hash, content, n, bands, sig`` of every row; ``content`` and the rest are null for a text without words."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "text_hash", "content", "n", "bands", "sig"]

    def run(batches):
        shingles = Shingler()
        powers = (_GOLDEN * (np.arange(1, bands * rows + 1, dtype=_U) * _U(2) + _U(1))).reshape(bands, rows)
        for b in batches:
            out = [(None,) * 4] * b.num_rows
            bags, size = {}, 0
            for i, t in enumerate(b.column(2).to_pylist()):
                bag = shingles(t)
                if len(bag[0]):
                    bags[i], size = bag, size + len(bag[0])
                if bags and (size >= STEP_SHINGLES or i == b.num_rows - 1):
                    values = _mix(bag_minhashes(list(bags.values()), m).view(_U))
                    keys = _mix((values[:, : bands * rows].reshape(-1, bands, rows) * powers).sum(axis=2, dtype=_U)).view(np.int64)
                    low = (values & _U(255)).astype(np.uint8)
                    for x, (at, bag) in enumerate(bags.items()):
                        out[at] = content_key(bag), int(bag[1].sum()), keys[x], low[x].tobytes()
                    bags, size = {}, 0
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    source = spread(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")))
    return arrow_map(source.select("id", F.xxhash64("text").alias("text_hash"), "text"), run, f"id {kind}, text_hash long, content binary, n long, bands array<long>, sig binary")


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal registers of every row of ``a`` with every row of ``b``."""
    return np.stack([(x[None, :] == b).sum(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)), int)


def _candidates(unit: dict, least: float, threshold: float, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) of a unit that may reach the threshold, likeliest first, with their number of equal registers.

    Of a unit with two parts of a large group, only pairs across the parts count.
    """
    sig = np.frombuffer(b"".join(unit["sig"]), np.uint8).reshape(-1, m)
    n, part = np.array(unit["n"]), np.array(unit["part"])
    same = _equal(sig, sig)
    ok = (same >= least * m) & (np.minimum.outer(n, n) >= threshold * np.maximum.outer(n, n))
    if part.min() != part.max():
        ok &= part[:, None] != part[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    order = np.argsort(-same[i, j], kind="stable")
    return i[order], j[order], same[i, j][order]


class _Groups:
    def __init__(self, labels):
        self.up = {x: x for x in labels}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forests(units: DataFrame, m: int, least: float, threshold: float) -> DataFrame:
    """For each unit ``(value, rows)`` a spanning forest of its candidate pairs, likeliest pairs first, ``(value, a, b)``, and each tree's smallest vertex as ``(value, a, null)``."""

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                rows = batch.column(1)[k].as_py()
                unit = {c: [x[c] for x in rows] for c in ("uid", "n", "part", "sig")}
                value, uid = batch.column(0)[k].as_py(), unit["uid"]
                groups = _Groups(uid)
                i, j, _ = _candidates(unit, least, threshold, m)
                out += [(value, uid[a], uid[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True) if groups.join(uid[a], uid[b])]
                out += [(value, x, None) for x in uid if groups.root(x) == x]
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["value", "a", "b"])

    return arrow_map(units.select("value", "rows"), run, "value long, a long, b long")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b, a_text, b_text)`` whose multisets overlap enough."""

    def run(batches):
        shingles, kept = Shingler(), OrderedDict()

        def bag(uid, text):
            if uid not in kept:
                kept[uid] = shingles(text)
                if len(kept) > 256:
                    kept.popitem(last=False)
            return kept[uid]

        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            ok = [overlap(bag(x, s), bag(y, t)) >= threshold for x, y, s, t in zip(a, b, ta, tb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(pairs.select("a", "b", "a_text", "b_text"), run, "a long, b long")


def _open_pairs(units: DataFrame, m: int, least: float, threshold: float) -> DataFrame:
    """``(unit, band, uid)`` of the vertices with a candidate pair across components."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(2)[k].as_py()
                unit = {c: [x[c] for x in rows] for c in ("uid", "n", "part", "sig", "component")}
                component = np.array(unit["component"])
                i, j, _ = _candidates(unit, least, threshold, m)
                apart = component[i] != component[j]
                found = [unit["uid"][x] for x in np.unique(np.concatenate([i[apart], j[apart]])).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(found), pa.string()), pa.array([batch.column(1)[k].as_py()] * len(found), pa.int32()), pa.array(found, pa.int64())], ["unit", "band", "uid"])

    return arrow_map(units.select("unit", "band", "rows"), run, "unit string, band int, uid long")


def _rest(units: DataFrame, m: int, least: float, threshold: float) -> DataFrame:
    """Links between components that the forests did not find: every candidate pair across components is compared.

    A pair is compared in the unit of its first common band alone; a link found
    joins its components, so that no more pairs between them are needed.
    """

    def run(batches):
        shingles = Shingler()
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column(1)[k].as_py()
                unit = {c: [x[c] for x in rows] for c in ("uid", "n", "part", "sig", "component", "bands", "text")}
                band, bands = batch.column(0)[k].as_py(), np.array(unit["bands"])
                groups, bags, links = _Groups(unit["component"]), {}, []
                i, j, _ = _candidates(unit, least, threshold, m)
                first = np.argmax(bands[i] == bands[j], axis=1) == band if len(i) else np.empty(0, bool)
                for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                    ca, cb = unit["component"][a], unit["component"][b]
                    if groups.root(ca) == groups.root(cb):
                        continue
                    for x in (a, b):
                        if x not in bags:
                            bags[x] = shingles(unit["text"][x])
                    if overlap(bags[a], bags[b]) >= threshold and groups.join(ca, cb):
                        links.append((ca, cb))
                cols = list(zip(*links, strict=True)) if links else [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return arrow_map(units.select("band", "rows"), run, "a long, b long")


def _equal_registers(a: Column, b: Column, m: int) -> Column:
    """Number of equal bytes of two signatures held as binary."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(m)), F.lit(0), lambda n, i: n + F.when(F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)), 1).otherwise(0))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``key, component_id, kept``.

    Texts whose five-word shingles (as multisets) have a weighted Jaccard
    similarity of at least ``threshold`` are linked; ``component_id`` is the
    smallest ``key`` that links reach and ``kept`` marks its row. Words are
    lower-cased and split at white space; a text of fewer than five words is
    one shingle, so it links with its copies. Null and empty texts have no
    shingles and each stands alone. Equal texts are one vertex, however many
    rows they have. Rows that share a key and differ in text are judged by
    their own text; a null key never names a component with other keys. An
    empty table gives an empty one.

    Candidate groups may have any size: see above. A group whose n members lie
    below the similarity, and so stay apart, costs n * n / 2 comparisons of
    registers, on tiles: those pairs exist, and none is given up.
    """
    m, least = REGISTERS, LEAST_EQUAL
    own = materialise(signatures(docs, key, text), "signatures")
    row = F.struct("id", "text_hash")
    first = F.coalesce(F.min(F.when(F.col("id").isNotNull(), row)), F.min(row))
    vertices = own.filter("content is not null").groupBy("content").agg(first.alias("o"), F.first(F.struct("n", "bands", "sig")).alias("v"))
    vertices = materialise(vertices.select("content", "o.id", "o.text_hash", "v.*", F.monotonically_increasing_id().alias("uid")), "vertices")

    spread = vertices.select("uid", "n", F.posexplode("bands").alias("band", "value")).withColumn("value", F.col("value").bitwiseXOR(F.xxhash64("band")))
    groups = spread.groupBy("value").agg(F.count("*").alias("size"), F.min("uid").alias("a"), F.max("uid").alias("b"), F.sum("n").alias("n"), F.first("band").alias("band")).filter("size > 1")
    parts = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("n") / TILE_SHINGLES), F.lit(1)).cast("int")
    groups = materialise(groups.withColumn("parts", F.when(F.col("size") > 2, parts).otherwise(1)), "groups")

    side = lambda s: vertices.select(F.col("uid").alias(s), F.col("n").alias(f"{s}_n"), F.col("sig").alias(f"{s}_sig"))
    twos = groups.filter("size = 2").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    twos = twos.filter(F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n"))
    twos = twos.filter(_equal_registers(F.col("a_sig"), F.col("b_sig"), m) >= least * m).select(F.lit(None).cast("long").alias("value"), "a", "b")

    tile = F.pmod(F.xxhash64("uid", F.lit(7)), "parts").cast("int")
    row = F.struct("uid", "n", F.lit(0).alias("part"), "sig")
    large = groups.filter("size > 2")
    # Values of the largest groups, at most bands * HOT_KEYS, are broadcast; the others meet their vertices in a shuffle.
    known, total = large.select("value", "parts", "size"), vertices.agg(F.count("*").alias("total"))
    hot = F.broadcast(known.join(F.broadcast(total)).filter(f"size > 64 and size * {HOT_KEYS} > total").select("value", "parts"))
    rows = spread.select("uid", "value")
    members = rows.join(hot, "value").unionByName(rows.join(hot.select("value"), "value", "left_anti").join(known.select("value", "parts"), "value"))
    members = materialise(members.withColumn("part", tile), "members")
    level, tried = members.select("value", "uid", "part"), []
    while True:
        units = level.join(vertices.select("uid", "n", "sig"), "uid").groupBy("value", "part").agg(F.collect_list(row).alias("rows"))
        forest = materialise(_forests(units, m, least, threshold), "forest")
        tried.append(forest.filter("b is not null"))
        # Leaders of groups of more than one tile, as long as a tile or more of them is gone.
        leaders = forest.filter("b is null").join(large.filter("parts > 1").select("value"), "value").select("value", F.col("a").alias("uid"))
        before = level.groupBy("value").agg(F.countDistinct("part").alias("tiles"), F.count("*").alias("were")).filter("tiles > 1")
        sizes = leaders.groupBy("value").agg(F.count("*").alias("size")).join(before, "value").filter(f"size > 1 and size <= were - least({TILE}, were div 8)")
        level = leaders.join(sizes.select("value", F.ceil(F.col("size") / TILE).cast("int").alias("parts")), "value")
        level = materialise(level.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(8 + len(tried))), "parts").cast("int")).select("value", "uid", "part"), "leaders")
        if level.isEmpty():
            break
    tried = reduce(DataFrame.unionByName, tried, twos)
    tried = materialise(tried, "candidates")

    # Texts of the vertices in question: of a row with the vertex's key and its hash of the text.
    asked = tried.select(F.col("a").alias("uid")).unionByName(tried.select(F.col("b").alias("uid"))).distinct()
    texts = materialise(_texts(docs, key, text, asked.join(vertices.select("uid", "id", "text_hash"), "uid")), "texts")
    pairs = tried.select("a", "b").distinct()
    for s in "ab":
        pairs = pairs.join(texts.select(F.col("uid").alias(s), F.col("text").alias(f"{s}_text")), s)
    found = connected_components(_verified(pairs, threshold), "near")
    found = materialise(vertices.select("uid").join(found.withColumnRenamed("id", "uid"), "uid", "left").select("uid", F.coalesce("component", "uid").alias("component")), "near-first")

    # Groups that hold more than one component: small ones as they are, of large ones the largest component against the others, and these against each other.
    held = members.join(found, "uid")
    counts = held.groupBy("value", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("value").agg(F.max_by("component", F.struct("c", F.col("component"))).alias("main"), F.max("c").alias("inside"), F.count("*").alias("kinds")).filter("kinds > 1")
    main = main.join(large.select("value", "size", "band", "parts"), "value")
    main = main.withColumn("out_parts", F.ceil((F.col("size") - F.col("inside")) * F.col("parts") / F.col("size")).cast("int"))
    main = materialise(main, "main")
    held = look_up(held.drop("parts", "part"), main, "value", members)
    out_part = F.pmod(F.xxhash64("uid", F.lit(7)), "out_parts").cast("int")
    inner = F.col("component") == F.col("main")
    of = F.when(F.col("parts") == 1, F.lit(0)).when(inner, -1 - F.pmod(F.xxhash64("uid", F.lit(7)), "parts").cast("int")).otherwise(out_part)
    held = held.withColumn("of", of)
    others = F.sequence(F.lit(0), F.col("out_parts") - 1)
    meet = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(inner, others).otherwise(F.concat(F.sequence(-F.col("parts"), F.lit(-1)), others))
    held = held.withColumn("with", F.explode(meet))
    unit = F.concat_ws(":", "value", F.least("of", "with"), F.greatest("of", "with"))
    units = materialise(held.select(unit.alias("unit"), "band", "uid", "component", F.col("of").alias("part")), "open-units")
    seen = units.join(vertices.select("uid", "n", "sig"), "uid").groupBy("unit", "band").agg(F.collect_list(F.struct("uid", "n", "part", "sig", "component")).alias("rows"))
    flagged = materialise(_open_pairs(seen, m, least, threshold), "open-pairs")
    missing = flagged.select("uid").distinct().join(texts, "uid", "left_anti").join(vertices.select("uid", "id", "text_hash"), "uid")
    texts = texts.unionByName(_texts(docs, key, text, missing))
    rest = flagged.join(units.select("unit", "uid", "component", "part"), ["unit", "uid"]).join(vertices.select("uid", "n", "sig", "bands"), "uid").join(texts, "uid")
    rest = rest.groupBy("unit", "band").agg(F.collect_list(F.struct("uid", "n", "part", "sig", "component", "bands", "text")).alias("rows"))
    further = connected_components(_rest(rest, m, least, threshold), "near-rest")
    step = found.select("component").distinct().join(further.select(F.col("id").alias("component"), F.col("component").alias("last")), "component", "left")
    found = look_up(found, step.select("component", F.coalesce("last", "component").alias("last")), "component").select("uid", F.col("last").alias("component"))

    known = materialise(vertices.select("content", "id", "uid").join(found, "uid"), "near-known")
    known = look_up(known, known.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("content", "component_id")
    # Copies of one text may be a third of all rows.
    known = materialise(known, "near-classes")
    out = own.filter("content is not null").select("id", "content")
    out = look_up(out, known, "content").select("id", "component_id").unionByName(own.filter("content is null").select("id", F.col("id").alias("component_id")))
    out = out.select(F.col("id").alias(key), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, columns as they were, without near copies of a row with a smaller ``key``.

    Null and empty texts stay. Where rows share a key but not a text, each is
    judged by its class; they stay if one of them does. Rows with a null key
    form classes like others, and stay unless a keyed row shares their class.
    """
    found = near_duplicates(docs, key, text, threshold)
    own = found.filter(F.col("kept") | F.col("component_id").isNull()).select(F.col(key).alias("_kept_key")).distinct()
    return docs.join(own, docs[key].eqNullSafe(own["_kept_key"]), "left_semi")


def _texts(docs: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """``uid`` and ``text`` of the vertices ``(uid, id, text_hash)``, from one row each with that key and that hash of its text."""
    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("text")).withColumn("_hash", F.xxhash64("text"))
    found = rows.join(asked, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash")))
    return found.groupBy("uid").agg(F.first("text").alias("text"))


def op1_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
