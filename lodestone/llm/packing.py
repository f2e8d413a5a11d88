"""Bounded-space online packing of token sequences (operator 6).

Each partition keeps a fixed number of open windows. A piece goes to the
window that it fills best; where none has room, the fullest window is emitted
and a new one opened. At the end of the partition the windows still open are
merged: their pieces are re-cut into full sequences, of which the last alone
may be short.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, table
from lodestone.session import spread

LENGTH = 1024
OPEN_WINDOWS = 256
END_ID = 0

#: Characters on which the two tokenizer libraries were tested to agree: ASCII text and Latin letters.
_COMMON = re.compile("[\t\n\r -~¡-ɏ]*")
#: Runs of white space that take the faster library time that grows with their square, and at last fail there.
_LONG_BLANK = re.compile(r"(?<!\s)\s{2000}")
_BLANKS = re.compile("[\t\n\r ]{2}")


@lru_cache(maxsize=1)
def tokenizer(name: str = "byte_bpe_50k") -> Callable[[list[str]], list[list[int]]]:
    """Token ids as ``tokenizers`` gives them with ``{name}.json``.

    The rank file of the same vocabulary gives the same ids four times faster
    for plain Latin text; all other texts, those that contain the special
    token's string, and those with very long runs of white space go through
    ``tokenizers`` itself. Where no two white-space characters meet, the
    pattern's look-ahead decides nothing, and the same pattern without it is
    faster. A process loads a vocabulary once.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = tuple(t.content for t in whole.get_added_tokens_decoder().values())
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    slower = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    faster = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN.replace(r"\s+(?!\S)|\s+", r"\s+"), mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encoded(text: str) -> list[int]:
        if _COMMON.fullmatch(text) and not any(s in text for s in special):
            if not _BLANKS.search(text):
                return faster(text)
            if not _LONG_BLANK.search(text):
                return slower(text)
        return whole.encode(text, add_special_tokens=False).ids

    def encode(texts: list[str]) -> list[list[int]]:
        return [encoded(t) for t in texts]

    return encode


class Packer:
    """Packs pieces of (key, start, ids, total) into windows of ``length``; rows come out as sequences close."""

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN_WINDOWS):
        self.length, self.most = length, open_windows
        self.rooms: list[tuple[int, int]] = []  # (room left, window), ascending
        self.windows: dict[int, list] = {}
        self.opened = self.sequences = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        full = total - total % self.length
        for at in range(0, full, self.length):
            yield from self._emit([(key, at, ids[at : at + self.length], total)])
        if full < total:
            yield from self._place((key, full, ids[full:], total))

    def _place(self, piece: tuple) -> Iterator[tuple]:
        size = len(piece[2])
        k = bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, w = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.most:
                yield from self._emit(self.windows.pop(self.rooms.pop(0)[1]))
            room, w, self.opened = self.length, self.opened, self.opened + 1
            self.windows[w] = []
        self.windows[w].append(piece)
        if room == size:
            yield from self._emit(self.windows.pop(w))
        else:
            insort(self.rooms, (room - size, w))

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total in pieces:
            yield key, start, ids, total, self.sequences, offset
            offset += len(ids)
        self.sequences += 1

    def finish(self) -> Iterator[tuple]:
        """Merges what is open: the fullest windows first; at most one short sequence remains."""
        room, pieces = self.length, []
        for _, w in self.rooms:
            for key, start, ids, total in self.windows[w]:
                while len(ids):
                    head, ids = ids[:room], ids[room:]
                    pieces.append((key, start, head, total))
                    start, room = start + len(head), room - len(head)
                    if not room:
                        yield from self._emit(pieces)
                        room, pieces = self.length, []
        if pieces:
            yield from self._emit(pieces)
        self.rooms, self.windows = [], {}


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, open_windows: int = OPEN_WINDOWS, with_ids: bool = False, encode: Callable[[], Callable] = tokenizer) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A document is its token ids, then ``END_ID``: a null or empty text is that
    id alone, equal texts and repeated rows are packed each by itself. Only
    documents longer than a window, and pieces left open at a partition's end,
    are cut. A sequence is padded to ``length`` by its reader. Memory holds
    the open windows and the batch at hand; a text may have any length and any
    run of white space. Rows that share a key are told apart by ``start`` no
    further; other columns are not read, and ``key`` may have the name of one
    of the output's. Partitions are packed apart from each other, and
    ``sequence_id`` holds the partition in its upper bits, so a task that is
    run again gives the same rows. An empty table gives no row.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields = ["_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        packer, ids_of, part = Packer(length, open_windows), encode(), TaskContext.get().partitionId() << 33

        def rows(found, key_type):
            found = list(found)
            keys, starts, ids, totals, seqs, offsets = zip(*found, strict=True)
            cols = [pa.array(keys, key_type), pa.array(starts, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array((zlib.crc32(i.tobytes()) for i in ids), pa.int64()), pa.array(totals, pa.int64()), pa.array((part + s for s in seqs), pa.int64()), pa.array(offsets, pa.int64())]
            if with_ids:
                cols.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, fields)

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            texts = [t or "" for t in b.column(1).to_pylist()]
            done = []
            for k, ids in zip(b.column(0).to_pylist(), ids_of(texts), strict=True):
                done += packer.add(k, np.array([*ids, END_ID], "<u4"))
            if done:
                yield rows(done, key_type)
        if done := list(packer.finish()):
            yield rows(done, key_type)

    schema = f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), run, schema).toDF(key, *fields[1:])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens."""
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
