"""Media columns in ISO base media files (operator 5).

Bytes are stored losslessly as samples of a one-track file: nested boxes
describe the samples, their chunks, times and keyframes. Reading walks the
boxes and decodes the sample tables; codec, duration and keyframe byte ranges
come from there, with no look at the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, table
from lodestone.session import spread

UNIT = 64
SAMPLE_BYTES = 1024
SAMPLES_PER_CHUNK = 8
KEYFRAME_EVERY = 8
TIMESCALE = 8000
CODEC = b"raw "

_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_media(payload: bytes, sample_bytes: int = SAMPLE_BYTES, per_chunk: int = SAMPLES_PER_CHUNK, keyframe_every: int = KEYFRAME_EVERY) -> bytes:
    """A file of one audio track of 8-bit samples that holds ``payload``, grouped into access units of ``sample_bytes``."""
    n = -(-len(payload) // sample_bytes)
    last = len(payload) - (n - 1) * sample_bytes if n else 0
    sizes = [sample_bytes] * (n - 1) + [last] * (n > 0)
    chunks = -(-n // per_chunk)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        runs = [(sample_bytes, n - 1), (last, 1)] if n > 1 and last != sample_bytes else [(last, n)] if n else []
        stts = _full(b"stts", 0, struct.pack(">I", len(runs)), *(struct.pack(">2I", count, delta) for delta, count in runs))
        keys = range(1, n + 1, keyframe_every)
        stss = _full(b"stss", 0, struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys))
        maps = []
        if chunks:
            tail = n - (chunks - 1) * per_chunk
            maps = [(1, per_chunk, 1)] if tail == per_chunk else [(1, tail, 1)] if chunks == 1 else [(1, per_chunk, 1), (chunks, tail, 1)]
        stsc = _full(b"stsc", 0, struct.pack(">I", len(maps)), *(struct.pack(">3I", *m) for m in maps))
        stsz = _full(b"stsz", 0, struct.pack(">2I", 0, n), struct.pack(f">{n}I", *sizes))
        co64 = _full(b"co64", 0, struct.pack(">I", chunks), struct.pack(f">{chunks}Q", *(first + i * per_chunk * sample_bytes for i in range(chunks))))
        entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">2H2HI", 1, 8, 0, 0, TIMESCALE << 16))
        stsd = _full(b"stsd", 0, struct.pack(">I", 1), entry)
        length = len(payload)
        mdhd = _full(b"mdhd", 0x01000000, struct.pack(">2QIQ2H", 0, 0, TIMESCALE, length, 0x55C4, 0))
        hdlr = _full(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"sound\0")
        dinf = _box(b"dinf", _full(b"dref", 0, struct.pack(">I", 1), _full(b"url ", 1)))
        minf = _box(b"minf", _full(b"smhd", 0, bytes(4)), dinf, _box(b"stbl", stsd, stts, stss, stsc, stsz, co64))
        tkhd = _full(b"tkhd", 0x01000003, struct.pack(">2Q2IQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">4H", 0, 0, 0x100, 0), _MATRIX, bytes(8))
        mvhd = _full(b"mvhd", 0x01000000, struct.pack(">2QIQ", 0, 0, TIMESCALE, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0)) + 16  # offsets have a fixed width, so the size doesn't depend on them
    return b"".join([ftyp, moov(head), struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)), payload])


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, parents first. A size beyond its parent raises ``ValueError``."""
    stack = [((), start, len(data) if end is None else end)]
    while stack:
        path, at, stop = stack.pop()
        if at + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = stop - at
        if size < body - at or at + size > stop:
            raise ValueError(f"box {kind!r} at {at} has a wrong size")
        stack.append((path, at + size, stop))
        here = (*path, kind)
        yield here, body, at + size
        if kind in _CONTAINERS:
            stack.append((here, body, at + size))


def read_index(data: bytes) -> dict:
    """Codec, timescale, duration and (offset, size) of each sample and keyframe of the first track, from its tables alone."""
    boxes: dict[tuple[bytes, ...], tuple[int, int]] = {}
    for path, a, b in walk(data):
        boxes.setdefault(path, (a, b))
    stbl = (b"moov", b"trak", b"mdia", b"minf", b"stbl")

    def ints(name: bytes, width: int, code: str = "I", skip: int = 4) -> list[tuple[int, ...]]:
        if (*stbl, name) not in boxes:
            return []
        a = boxes[*stbl, name][0] + skip
        count = struct.unpack_from(">I", data, a)[0]
        return list(struct.iter_unpack(f">{width}{code}", data[a + 4 : a + 4 + count * width * struct.calcsize(">" + code)]))

    a = boxes[b"moov", b"trak", b"mdia", b"mdhd"][0]
    version = data[a]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if version else struct.unpack_from(">2I", data, a + 12)
    a = boxes[*stbl, b"stsd"][0]
    codec = data[a + 12 : a + 16].decode("latin-1")
    a = boxes[*stbl, b"stsz"][0]
    fixed, count = struct.unpack_from(">2I", data, a + 4)
    sizes = [fixed] * count if fixed else [s for (s,) in struct.iter_unpack(">I", data[a + 12 : a + 12 + 4 * count])]
    chunks = [c for (c,) in (ints(b"co64", 1, "Q") or ints(b"stco", 1))]
    runs = ints(b"stsc", 3)
    samples, i = [], 0
    for k, (first, per, _) in enumerate(runs):
        until = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
        for c in range(first - 1, until - 1):
            at = chunks[c]
            for size in sizes[i : i + per]:
                samples.append((at, size))
                at += size
            i += per
    sync = [s - 1 for (s,) in ints(b"stss", 1)] if (*stbl, b"stss") in boxes else range(len(samples))
    times = ints(b"stts", 2)
    return {"codec": codec, "timescale": timescale, "duration": duration, "samples": samples, "keyframes": [samples[s] for s in sync], "ticks": sum(n * d for n, d in times)}


def read_payload(data: bytes, index: dict) -> bytes:
    return b"".join(data[a : a + n] for a, n in index["samples"])


def features(index: dict) -> dict:
    return {"codec": index["codec"], "duration_s": index["duration"] / index["timescale"], "n_samples": len(index["samples"]), "keyframes": [{"offset": a, "length": n} for a, n in index["keyframes"]]}


_KEYFRAMES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, the file as ``media``, and ``codec, duration_s, n_samples, keyframes`` read from it.

    A null or empty text is stored as 64 zero bytes; equal texts give equal
    files. Rows are independent, so repeated ones repeat.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                files = [write_media(pad((t or "").encode())) for t in part.column(1).to_pylist()]
                found = [features(read_index(f)) for f in files]
                cols = [pa.array(files, pa.binary()), pa.array([f["codec"] for f in found], pa.string()), pa.array([f["duration_s"] for f in found], pa.float64()), pa.array([f["n_samples"] for f in found], pa.int64()), pa.array([f["keyframes"] for f in found], _KEYFRAMES)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "media", "codec", "duration_s", "n_samples", "keyframes"])

    schema = f"id {kind}, media binary, codec string, duration_s double, n_samples long, keyframes array<struct<offset:long,length:long>>"
    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, schema).withColumnRenamed("id", key)


def media_digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads each stored file back and digests its payload: one row per input row.

    Where ``media`` is null all other columns are null. Rows are independent,
    repeated ones repeat, files of any size are read whole, and an empty table
    gives an empty one. A file that is no such container is an error. Columns
    besides ``key`` and ``media`` are not read.
    """
    kind = media.schema[key].dataType.simpleString()
    names = ["id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                if data is None:
                    rows.append((None,) * 6)
                    continue
                index = read_index(data)
                payload = read_payload(data, index)
                ranges = ",".join(f"{a}+{n}" for a, n in index["keyframes"])
                feature = f"codec={index['codec'].strip()};timescale={index['timescale']};duration={index['duration']};samples={len(index['samples'])};keyframes={len(index['keyframes'])};ranges_crc32={zlib.crc32(ranges.encode())}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    schema = f"id {kind}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(media.select(F.col(key).alias("id"), "media"), run, schema).withColumnRenamed("id", key)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an ISO media file, read back and digested; ``n_bytes`` is its length in UTF-8 before padding."""
    docs = spread(table(spark, sf_dir, "documents").select(F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).alias("key"), "text"))
    found = media_digest(store_media(docs, "key"), "key")
    return found.select("key.doc_id", "key.n_bytes", *[c for c in found.columns if c != "key"])
