"""Language-model scores by a hierarchical Pitman-Yor process (operator 2).

A restaurant stands for a context: the two words before, the word before, none.
Restaurants of two words share the parent of their nearer word, all of these
share the root, and the root draws from a uniform base over the words of the
training texts and one unknown. Seatings are sampled by Gibbs: customers leave
and sit down again one by one (``seating``). Discounts and strengths are
sampled between rounds, and predictive probabilities are averaged over the last
sweeps.

The work is dealt out twice. Words get dense ids, frequent ones low, from the
owner of their hash. Then the restaurants of a previous word lie in one bucket,
so that their totals and parents are at hand; a previous word with more than
``HOT_TOKENS`` uses is dealt out over buckets by the word that follows. What
buckets share, the root's dishes and the totals of dealt-out restaurants, is
summed by owners once a round, and stands still while a round sweeps.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, table
from lodestone.llm.seating import Params, Seating, seat_root
from lodestone.session import materialise, release, spread

#: Tokens that a chunk of documents holds, and training tokens of a bucket of restaurants, about.
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
#: Uses of a previous word in one bucket at most.
HOT_TOKENS = 250_000
#: Sweeps of the two rounds after all have sat down; those of the last round are averaged.
SWEEPS = (0, 2)
STRENGTH = 1.0

_END = 0x5EED0E2D
_U = np.uint64
#: Kinds of what buckets share: dishes of the root, restaurants of one word, restaurants of two.
_ROOT, _ONE, _TWO = range(3)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between the bytes 0x20 and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 in as many bytes as the largest needs, byte after byte of all: that compresses well."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << 8 * w)
    x, planes = x.astype(f"<u{width}"), np.empty((width, len(x)), np.uint8)
    for k in range(width):
        planes[k] = x >> 8 * k if k else x
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = planes[-1].astype(np.int64)
    for k in range(width - 2, -1, -1):
        out <<= 8
        out |= planes[k]
    return out


def _steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What ascends between the marks of ``new``, as differences; ``_sums`` undoes it."""
    d = np.diff(x, prepend=0)
    d[new] = x[new]
    return d


def _sums(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    s, at = np.cumsum(d), np.nonzero(new)[0]
    return s - np.repeat(s[at] - d[at], np.diff(at, append=len(d)))


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks among the distinct values, by a table of all numbers up to the largest."""
    found = np.zeros(int(x.max(initial=0)) + 1, bool)
    found[x] = True
    return (np.cumsum(found) - 1)[x]


def _order(one: np.ndarray, word: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The order by three columns; as one number, where they fit, runs that are sorted already are merged."""
    columns = [one, word, two]
    for k in range(4):
        bits = [int(x.max(initial=0)).bit_length() for x in columns]
        if sum(bits) < 64:
            return np.argsort((columns[0] << bits[1] | columns[1]) << bits[2] | columns[2], kind="stable")
        if k < 3 and bits[k] < 27:  # a bucket has few of the previous words; a table has 2 ** 26 places at most
            columns[k] = _dense(columns[k])
    return np.lexsort((two, word, one))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers from 0, ascending, and where each of ``x`` is among them; sorted together with their places, where both fit."""
    bits = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + bits > 63:
        return np.unique(x, return_inverse=True)
    both = np.sort(x << bits | np.arange(len(x)))
    value = both >> bits
    new = _changes(value)
    where = np.empty(len(x), np.int64)
    where[both & ((1 << bits) - 1)] = np.cumsum(new.astype(np.int64)) - 1
    return value[new], where


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _fields(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "longs": pa.list_(pa.int64()), "doubles": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def _ddl(text: str) -> str:
    return text.replace("longs", "array<long>").replace("doubles", "array<double>")


# Documents to chunks ---------------------------------------------------------


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of a column: the words of all rows one after another, and how many each row has."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    words = pc.ascii_split_whitespace(text)
    number = np.where(pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), 0, pc.list_value_length(words).to_numpy(zero_copy_only=False))
    words = pc.list_flatten(words)
    return (words.filter(pc.greater(pc.binary_length(words), 0)) if number.sum() < len(words) else words), number.astype(np.int64)


class _Chunk:
    """Documents as indices into the chunk's own words, frequent ones first."""

    def __init__(self):
        self.keys, self.held, self.lengths, self.words, self.size = [], [], [], [], 0

    def add(self, keys: list, held: list[bool], words: pa.Array, number: np.ndarray) -> None:
        self.keys += keys
        self.held += held
        self.lengths.append(number + 1)
        self.words.append(words)
        self.size += len(words) + len(number)

    def _index(self) -> tuple[np.ndarray, list[bytes]]:
        """Of each token the place of its word, and all words; place 0 is the end's."""
        found = pa.chunked_array(self.words).combine_chunks().dictionary_encode()
        self.lengths = np.concatenate(self.lengths)
        word, ends = np.zeros(self.size, np.int32), np.zeros(self.size, bool)
        ends[np.cumsum(self.lengths) - 1] = True
        word[~ends] = found.indices.to_numpy() + 1
        return word, found.dictionary.cast(pa.large_binary() if pa.types.is_large_string(found.dictionary.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()  # 0.01 s for 200,000 words, to_pylist takes 0.2

    def rows(self, chunk: int, owners: int):
        """(chunk, owner, keys, held, lengths, a, b, c): the documents with owner -1, then the words of each owner."""
        word, words = self._index()
        order = np.argsort(-np.bincount(word), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes = np.fromiter(chain([_END], map(xxhash.xxh3_64_intdigest, words)), _U, 1 + len(words))
        word, hashes = rank[word], hashes[order]
        train = np.repeat(~np.array(self.held, bool), self.lengths)
        count = np.bincount(word[train], minlength=len(order))
        yield chunk, -1, self.keys, self.held, self.lengths, pack(word), pack(rank[:1]), None
        owner = (hashes % _U(owners)).astype(np.int64)
        for k in range(owners):
            at = np.nonzero(owner == k)[0]
            if len(at):
                yield chunk, k, None, None, None, hashes[at].tobytes(), pack(count[at]), pack(np.diff(at, prepend=0))


def _gather(docs: DataFrame, key: str, text: str, held: Column, owners: int, chunk_tokens: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        chunk, number, schema = _Chunk(), TaskContext.get().partitionId() << 24, None
        for b in batches:
            schema = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("keys", pa.list_(b.schema.field(0).type)), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
            keys, held, (words, words_in) = b.column(0).to_pylist(), b.column(1).to_pylist(), _words(b.column(2))
            at, size, row = np.concatenate([[0], np.cumsum(words_in)]), np.cumsum(words_in + 1), 0
            while row < len(keys):  # a chunk ends with the row that fills it
                end = min(len(keys), 1 + int(np.searchsorted(size, chunk_tokens - chunk.size + (size[row - 1] if row else 0))))
                chunk.add(keys[row:end], held[row:end], words.slice(at[row], at[end] - at[row]), words_in[row:end])
                row = end
                if chunk.size >= chunk_tokens:
                    yield _batch(schema, list(chunk.rows(number, owners)))
                    chunk, number = _Chunk(), number + 1
        if chunk.size:
            yield _batch(schema, list(chunk.rows(number, owners)))

    return arrow_map(docs.select(F.col(key).alias("id"), held.alias("held"), F.col(text).alias("text")), run, f"chunk long, owner int, keys array<{kind}>, held array<boolean>, lengths array<int>, a binary, b binary, c binary")


_WORDS = "chunk long, place binary, ids binary, uses binary, n long, v long"


def _word_ids(words: DataFrame, owners: int) -> DataFrame:
    """For each chunk and owner the ids of its words and their uses in training; ids rise as uses fall."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("chunk").to_pylist()
        h = np.concatenate([np.frombuffer(r["a"], _U) for r in rows])
        count = np.concatenate([unpack(r["b"]) for r in rows])
        _, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, weights=count).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        ids, uses, out, begin = rank[at] * owners + rows[0]["owner"], total[at], [], 0
        for k, r in enumerate(rows):
            end = begin + len(r["a"]) // 8
            out.append((r["chunk"], r["c"], pack(ids[begin:end]), pack(uses[begin:end]), 0 if k else int(total.sum()), 0 if k else int((total > 0).sum())))
            begin = end
        return pa.Table.from_batches([_batch(_fields(_WORDS), out)])

    return words.select("chunk", "owner", "a", "b", "c").groupBy("owner").applyInArrow(run, _WORDS)


class _Triples:
    """The distinct (previous word, word, word before) of a chunk in the order of buckets, and where each token's is."""

    def __init__(self, docs: dict, words: list[dict], buckets: int, hot: int):
        word, end = unpack(docs["a"]), int(unpack(docs["b"])[0])
        self.lengths, held = np.array(docs["lengths"], np.int64), np.array(docs["held"], bool)
        at = np.concatenate([np.cumsum(unpack(w["place"])) for w in words])
        ids, uses = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        ids[at] = np.concatenate([unpack(w["ids"]) for w in words])
        uses[at] = np.concatenate([unpack(w["uses"]) for w in words])
        self.starts, self.uses = np.cumsum(self.lengths) - self.lengths, uses[word]
        order = np.argsort(ids)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids, word_uses, word, n = ids[order], uses[order], rank[word], len(order)
        one = np.concatenate([[0], word[:-1]])
        two = np.concatenate([[0, 0], word[:-2]])[: len(word)]
        one[self.starts] = two[self.starts] = rank[end]
        second = self.starts[self.lengths > 1] + 1
        two[second] = rank[end]
        pair, inverse = _distinct(one * n + word)
        w1, w = pair // n, pair % n
        parts, mixed = 1 + word_uses // hot, _mix(ids)
        bucket, dealt = (_mix(mixed) % _U(buckets)).astype(np.int64)[w1], np.nonzero((parts > 1)[w1])[0]
        bucket[dealt] = (_mix(mixed[w1[dealt]] + _U(1) + mixed[w[dealt]] % parts[w1[dealt]].astype(_U)) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # small numbers are dealt, not compared
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        triple, self.token = _distinct(rank[inverse] * n + two)
        self.size, self._found = len(triple), (held, ids, order, triple, n, w1, w, parts, bucket, buckets)

    def rows(self, chunk: int):
        held, ids, order, triple, n, w1, w, parts, bucket, buckets = self._found
        counts = np.bincount(self.token[np.repeat(~held, self.lengths)], minlength=len(triple))
        pair, before = np.divmod(triple, n)
        at = order[pair]
        previous = w1[at]
        ones, words, twos, split = ids[previous], ids[w[at]], ids[before], (parts > 1)[previous]
        cuts = np.searchsorted(bucket[at], np.arange(buckets + 1))
        for k in np.nonzero(np.diff(cuts))[0].tolist():
            own = slice(int(cuts[k]), int(cuts[k + 1]))
            one, word, two = ones[own], words[own], twos[own]
            yield chunk, k, own.start, pack(np.diff(one, prepend=0)), pack(_steps(word, _changes(one))), pack(two), pack(counts[own]), pack(split[own])


_SENT = "chunk long, bucket int, first long, one binary, word binary, two binary, count binary, split binary"


def _triples(docs: DataFrame, words: DataFrame, buckets: int, hot: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.to_pylist()
        return pa.Table.from_batches([_batch(_fields(_SENT), list(_Triples(d, words, buckets, hot).rows(d["chunk"]))) for d in left.to_pylist()], _fields(_SENT))

    docs = docs.select("chunk", "held", "lengths", "a", "b")
    return docs.groupBy("chunk").cogroup(words.select("chunk", "place", "ids", "uses").groupBy("chunk")).applyInArrow(run, _SENT)


# Restaurants -----------------------------------------------------------------

_BUCKET = "bucket int, one binary, word binary, two binary, count binary, split binary, chunks longs, firsts longs, sizes longs, at binary"


def _merge(sent: DataFrame) -> DataFrame:
    """One row for each bucket: its dishes, and where each chunk's are among them."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("chunk").to_pylist()
        parts = []
        for r in rows:
            one = np.cumsum(unpack(r["one"]))
            parts.append((one, _sums(unpack(r["word"]), _changes(one)), unpack(r["two"]), unpack(r["count"]), unpack(r["split"])))
        one, word, two, count, split = (np.concatenate(x) for x in zip(*parts, strict=True))
        sizes = [len(p[0]) for p in parts]
        del parts
        order = _order(one, word, two)
        new = _changes(one[order], word[order], two[order])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        total = np.bincount(at, weights=count).astype(np.int64)
        kept = order[new]
        one, word, two = one[kept], word[kept], two[kept]
        start = np.zeros(len(at), bool)
        start[np.cumsum(sizes) - sizes] = True
        row = (rows[0]["bucket"], pack(np.diff(one, prepend=0)), pack(_steps(word, _changes(one))), pack(two), pack(total), pack(split[kept]), [r["chunk"] for r in rows], [r["first"] for r in rows], sizes, pack(_steps(at, start)))
        return pa.Table.from_batches([_batch(_fields(_BUCKET), [row])])

    return sent.groupBy("bucket").applyInArrow(run, _ddl(_BUCKET))


class Bucket:
    """The dishes of a bucket: families by (previous word, word), and what it shares with others."""

    def __init__(self, row: dict, owners: int):
        self.number, self.owners = row["bucket"], owners
        one = np.cumsum(unpack(row["one"]))
        word, two, self.count, split = _sums(unpack(row["word"]), _changes(one)), unpack(row["two"]), unpack(row["count"]), unpack(row["split"]).astype(bool)
        family = _changes(one, word)
        self.family = np.cumsum(family) - 1
        one_f, word_f, split_f = one[family], word[family], split[family]
        self.middle = np.cumsum(_changes(one_f)) - 1
        context, self.context = _distinct((np.cumsum(_changes(one)) - 1) << int(two.max(initial=0)).bit_length() | two)
        some = np.empty(len(context), np.int64)  # a dish of each
        some[self.context] = np.arange(len(two))
        first = np.nonzero(_changes(one_f))[0]
        self.words, self.root_of = _distinct(word_f)
        self.split_mid, self.split_low = np.nonzero(split_f[first])[0], np.nonzero(split[some])[0]
        far = some[self.split_low]
        keys = (self.words.astype(_U), one_f[first][self.split_mid].astype(_U), _mix(_mix(one[far]) + two[far].astype(_U)))
        self.shared = [self._dealt(k) for k in keys]

    def _dealt(self, keys: np.ndarray):
        """(order, keys in it, where each owner's begin)."""
        owner = (_mix(keys) % _U(self.owners)).astype(np.int64)
        order = np.lexsort((keys, owner))
        return order, keys[order], np.searchsorted(owner[order], np.arange(self.owners + 1))

    def seating(self, params: Params, rng) -> Seating:
        return Seating(self.family, self.context, self.count, self.middle, params, rng)

    def _own(self, s: Seating):
        """Customers and tables of what is shared, of this bucket alone."""
        low = [np.bincount(self.context, weights=x, minlength=len(s.extra_low[0])).astype(np.int64) for x in (s.count, s.tables)]
        mid = [np.bincount(self.middle, weights=x, minlength=len(s.extra_mid[0])).astype(np.int64) for x in (s.up_customers, s.up_tables)]
        root = np.bincount(self.root_of, weights=s.up_tables, minlength=len(self.words)).astype(np.int64)
        return (root, np.zeros_like(root)), tuple(x[self.split_mid] for x in mid), tuple(x[self.split_low] for x in low)

    def messages(self, s: Seating):
        for kind, (x, y) in enumerate(self._own(s)):
            order, keys, cuts = self.shared[kind]
            for k in np.nonzero(np.diff(cuts))[0].tolist():
                own = slice(int(cuts[k]), int(cuts[k + 1]))
                raw = pack(np.diff(keys[own].astype(np.int64), prepend=0)) if kind == _ROOT else keys[own].tobytes()
                yield self.number, k, kind, raw, pack(x[order[own]]), pack(y[order[own]])

    def listen(self, s: Seating, replies: list[dict], root: tuple[int, int], vocabulary: int) -> None:
        """Takes in what the owners have summed up; ``s`` is as it was when the bucket spoke."""
        own = self._own(s)
        found = []
        for kind, (x, _) in enumerate(own):
            order, _, cuts = self.shared[kind]
            out = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for r in (r for r in replies if r["kind"] == kind):
                at = order[cuts[r["owner"]] : cuts[r["owner"] + 1]]
                out[0][at], out[1][at] = unpack(r["b"]), unpack(r["c"])
            found.append(out)
        s.know_root(found[_ROOT][0][self.root_of], found[_ROOT][1][self.root_of], s.up_tables.copy(), root, vocabulary)
        for extra, kind, where in ((s.extra_mid, _ONE, self.split_mid), (s.extra_low, _TWO, self.split_low)):
            for k in range(2):
                extra[k][where] = found[kind][k] - own[kind][k]
        s.low_customers = np.bincount(self.context, weights=s.count, minlength=len(s.extra_low[0])).astype(np.int64) + s.extra_low[0]

    def evidence(self, s: Seating) -> list[float]:
        """What discounts and strengths of the lowest and the middle level are sampled from: of restaurants that are dealt out, the tables alone."""
        s._totals()
        out = []
        for level, customers, tables, sizes, split in ((2, s.low_customers, s.low_tables, s.sizes, self.split_low), (1, s.mid_customers, s.mid_tables, s.up_sizes, self.split_mid)):
            whole = np.ones(len(tables), bool)
            whole[split] = False
            more = sizes[sizes > 1] - 1
            j = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
            z = int((s.rng.random(len(j)) < (j - 1) / (j - s.params.discount[level])).sum())
            out += [*_evidence(customers[whole], tables[whole], s.params, level, s.rng), float(len(j) - z)]
        return out


def _evidence(customers: np.ndarray, tables: np.ndarray, params: Params, level: int, rng) -> list[float]:
    """Auxiliary variables of whole restaurants: of new tables those for the strength and those for the discount, and the sum of logarithms."""
    d, theta = params.discount[level], params.strength[level]
    c, t = customers[tables > 1], tables[tables > 1]
    i = np.arange(int((t - 1).sum())) - np.repeat(np.cumsum(t - 1) - (t - 1), t - 1) + 1
    y = int((rng.random(len(i)) < theta / (theta + d * i)).sum())
    return [float(y), float(len(i) - y), float(np.log(rng.beta(theta + 1, c - 1)).sum())]


_SHARE = "bucket int, owner int, kind int, a binary, b binary, c binary"


def _answers(messages: DataFrame, params: Params, tables: int, vocabulary: int, sweeps: int, seed: int) -> DataFrame:
    """Owners sum up what buckets share, seat the root's dishes, and answer each bucket in the order it asked."""
    out = f"{_SHARE}, root_c long, root_t long, facts doubles"

    def run(group: pa.Table) -> pa.Table:
        rows, done = sorted(group.to_pylist(), key=lambda r: (r["kind"], r["bucket"])), []
        for kind in range(3):
            own = [r for r in rows if r["kind"] == kind]
            if not own:
                continue
            keys = [np.cumsum(unpack(r["a"])) if kind == _ROOT else np.frombuffer(r["a"], _U) for r in own]
            _, at = _distinct(np.concatenate(keys)) if kind == _ROOT else np.unique(np.concatenate(keys), return_inverse=True)
            x, y = (np.bincount(at, weights=np.concatenate([unpack(r[c]) for r in own])).astype(np.int64) for c in "bc")
            rng, facts = np.random.default_rng((own[0]["owner"], kind, seed)), [0.0] * 8
            if kind == _ROOT:
                y = seat_root(x, 1.0 / vocabulary, tables, params, rng, sweeps)
            else:
                at_ = 0 if kind == _TWO else 4
                facts[at_ : at_ + 3] = _evidence(x, y, params, 2 if kind == _TWO else 1, rng)
            begin = 0
            for k, (r, of) in enumerate(zip(own, keys, strict=True)):
                mine = at[begin : begin + len(of)]
                begin += len(of)
                first = kind == _ROOT and not k
                done.append((r["bucket"], r["owner"], kind, None, pack(x[mine]), pack(y[mine]), int(x.sum()) if first else 0, int(y.sum()) if first else 0, None if k else facts))
        return pa.Table.from_batches([_batch(_fields(out), done)])

    return messages.groupBy("owner").applyInArrow(run, _ddl(out))


def _first_words(dishes: DataFrame, owners: int) -> DataFrame:
    """What buckets share while every dish sits at one table; with owner -1 the dishes of each level that have one and two customers."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                bucket = Bucket(r, owners)
                s = bucket.seating(Params(), None)
                root = np.bincount(bucket.root_of, weights=s.up_tables, minlength=len(bucket.words))
                facts = [float((c == x).sum()) for c in (root, s.up_customers, s.count) for x in (1, 2)]
                yield _batch(_fields(f"{_SHARE}, facts doubles"), [*((*m, None) for m in bucket.messages(s)), (bucket.number, -1, -1, None, None, None, facts)])

    return arrow_map(dishes, run, _ddl(f"{_SHARE}, facts doubles"))


def _sums_of(spoken: DataFrame) -> dict[int, float]:
    """The buckets' facts, summed up: a row for each of a few."""
    rows = spoken.filter("facts is not null").select(F.posexplode("facts").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    return {r["k"]: r["x"] for r in rows}


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None, sweeps: tuple[int, int] = SWEEPS, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row.

    Rows where ``held`` holds are scored and not learned from. A null or empty
    text is its end token alone. Rows are independent: repeated ones, and rows
    that share a key, count and are scored each by itself; a null key stays
    null. A text of any length is one row of a chunk, which is then larger
    than ``chunk_tokens``. Other columns are not read, whatever their names.
    Without any training row every token is unknown and probabilities come
    from the uniform base. An empty table gives an empty one.
    """
    held = F.lit(False) if held is None else held
    spark, parts = docs.sparkSession, max(2, docs.select(key, text).rdd.getNumPartitions())
    word_owners = max(8, parts)
    gathered = materialise(_gather(docs, key, text, held, word_owners, chunk_tokens), "lm-tokens", "chunk", 4 * parts)
    texts = gathered.filter("owner < 0")
    words = materialise(_word_ids(gathered.filter("owner >= 0"), word_owners), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    number, vocabulary = max(16, -(-n // bucket_tokens)), v + 1
    owners = max(4, number // 4)

    buckets = materialise(_merge(_triples(texts, words, number, hot_tokens)), "lm-restaurants", "bucket", int(spark.conf.get("spark.sql.shuffle.partitions")))
    dishes = buckets.select("bucket", "one", "word", "two", "count", "split")
    heard = [c.split()[0] for c in _SHARE.split(", ")]
    spoken = materialise(_first_words(dishes, owners), "lm-first")
    facts = _sums_of(spoken)
    ones, twos = ([facts.get(2 * level + x, 0.0) for level in range(3)] for x in (0, 1))
    first = Params(tuple(min(0.95, max(0.05, a / max(1.0, a + 2 * b))) for a, b in zip(ones, twos, strict=True)), (STRENGTH,) * 3)
    answers = materialise(_answers(spoken.filter("owner >= 0").select(*heard), first, v, vocabulary, 0, 0), "lm-answers")
    release(spoken)
    root = tuple(answers.agg(F.coalesce(F.sum("root_c"), F.lit(0)), F.coalesce(F.sum("root_t"), F.lit(0))).first())
    told = f"{_SHARE}, d binary, facts doubles"

    def sit(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            bucket = Bucket(r, owners)
            s = bucket.seating(first, np.random.default_rng((bucket.number, 1)))
            bucket.listen(s, right.to_pylist(), root, vocabulary)
            for k in range(1 + sweeps[0]):
                s.sweep(enter=k == 0)
            out = [(*m, None, None) for m in bucket.messages(s)]
            out.append((bucket.number, -1, -1, pack(s.tables), pack(s.sizes), pack(s.up_tables), pack(s.up_sizes), bucket.evidence(s)))
        return pa.Table.from_batches([_batch(_fields(told), out)])

    seated = materialise(dishes.groupBy("bucket").cogroup(answers.select("bucket", "owner", "kind", "b", "c").groupBy("bucket")).applyInArrow(sit, _ddl(told)), "lm-seats")
    release(answers)
    answers = materialise(_answers(seated.filter("owner >= 0").select(*heard), first, root[1], vocabulary, 1, 1), "lm-answers")
    last = _sample(first, _sums_of(seated.select("facts").unionByName(answers.select("facts"))), np.random.default_rng(n))
    again = tuple(answers.agg(F.coalesce(F.sum("root_c"), F.lit(0)), F.coalesce(F.sum("root_t"), F.lit(0))).first())
    known = seated.filter("owner < 0").select("bucket", "owner", "kind", "a", "b", "c", "d").unionByName(answers.select("bucket", "owner", "kind", "a", "b", "c", F.lit(None).cast("binary").alias("d")))
    replied = "chunk long, first long, p binary"

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            bucket, rows = Bucket(r, owners), right.to_pylist()
            s = bucket.seating(last, np.random.default_rng((bucket.number, 2)))
            seats = next(x for x in rows if x["owner"] < 0)
            s.tables, s.sizes, s.up_tables, s.up_sizes = (unpack(seats[c]) for c in "abcd")
            s.up_customers = np.bincount(s.family, weights=s.tables, minlength=len(s.up_tables)).astype(np.int64)
            bucket.listen(s, [x for x in rows if x["owner"] >= 0], again, vocabulary)
            p = np.zeros(len(s.count))
            for _ in range(sweeps[1]):
                s.sweep()
                p += s.predictive()
            p = np.log10((p if sweeps[1] else s.predictive()) / max(1, sweeps[1])).astype("<f4").view("<u4").astype(np.int64)
            start = np.zeros(sum(r["sizes"]), bool)
            start[np.cumsum(r["sizes"]) - r["sizes"]] = True
            at, begin = _sums(unpack(r["at"]), start), 0
            for chunk, place, size in zip(r["chunks"], r["firsts"], r["sizes"], strict=True):
                out.append((chunk, place, pack(p[at[begin : begin + size]])))
                begin += size
        return pa.Table.from_batches([_batch(_fields(replied), out)])

    replies = buckets.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(predict, replied)
    known = words.select("chunk", "place", "ids", "uses", F.lit(None).cast("long").alias("first"), F.lit(None).cast("binary").alias("p"))
    known = known.unionByName(replies.select("chunk", *(F.lit(None).cast("binary").alias(c) for c in ("place", "ids", "uses")), "first", "p"))
    kind = docs.schema[key].dataType.simpleString()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("id", left.schema.field("keys").type.value_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        out = []
        for d in left.to_pylist():
            rows = right.to_pylist()
            t = _Triples(d, [r for r in rows if r["p"] is None], number, hot_tokens)
            p = np.empty(t.size, "<f4")
            for r in rows:
                if r["p"] is not None:
                    own = unpack(r["p"]).astype("<u4").view("<f4")
                    p[r["first"] : r["first"] + len(own)] = own
            base = np.log10((t.uses + 0.5) / (n + 0.5 * (v + 1)))
            sums = (np.add.reduceat(x, t.starts) for x in ((t.uses > 0).astype(np.int64), base, p[t.token].astype(np.float64)))
            cols = [d["keys"], d["held"], t.lengths, *sums]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema))
        return pa.Table.from_batches(out, schema)

    texts = texts.select("chunk", "keys", "held", "lengths", "a", "b")
    out = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(scored, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )


def _sample(params: Params, facts: dict[int, float], rng) -> Params:
    """Discounts and strengths of the two lower levels given the seatings; those of the root stay."""
    out = [(params.discount[0], params.strength[0])]
    for at in (4, 0):  # the middle level, the lowest
        y, no_y, log_x, no_z = (facts.get(at + k, 0.0) for k in range(4))
        out.append((min(0.99, max(0.01, rng.beta(1 + no_y, 1 + no_z))), max(1e-3, rng.gamma(1 + y, 1 / (1 - log_x)))))
    return Params(*(tuple(x) for x in zip(*out, strict=True)))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those that are not held out."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score_documents(docs, held=held_out(F.col("doc_id")))
