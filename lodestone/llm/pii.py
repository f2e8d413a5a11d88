"""Personal data behind disguises (operator 10): offset-preserving deobfuscation.

Plain identifiers are found in the text as it stands. A copy of the text is
then normalised by transducers (homoglyphs and foreign digits to ASCII, spelled
digits, "at"/"dot" disguises, invisible characters), the same detectors run
on the copy, and what they find is mapped back to source characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, table
from lodestone.session import spread

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")  # from the first digit of a run: a search skips to digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search of the pattern would, walking from each ``@`` so that long runs stay linear."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, (last := found.end())
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Identifiers written plainly, by kind in the order of ``KINDS``, then by start; ends are exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: Letters of other scripts that look like ASCII ones (fixed values).
HOMOGLYPHS = dict(zip("аеорсухіјѕԁɡһԛԝАВЕКМНОРСТХЅІЈαοινρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ∙․＠﹫", "aeopcyxijsdghqwABEKMHOPCTXSIJaoivpABEZHIKMNOPTYX..@@", strict=True))


class _Fold(dict):
    """One character to one character: look-alikes, full-width forms and decimal digits of any script to ASCII."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        to = HOMOGLYPHS.get(c)
        if to is None and cp > 127:
            digit = unicodedata.decimal(c, None)
            plain = unicodedata.normalize("NFKC", c)
            to = str(digit) if digit is not None else plain if len(plain) == 1 and plain.isascii() and plain.isprintable() else c
        self[cp] = to = to or c
        return to


_FOLD = _Fold()

#: Spelled digits of the corpus languages (fixed values).
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DOTWORD = "dot|punkt|point|punto"
_ATWORD = "at|arroba|arobase|ät"
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_WORD})|[0-9]++)(?:(?:[ \-.,]{{1,2}}| (?:{_DOTWORD}) )(?:(?:{_WORD})(?!\w)|[0-9]++))+(?!\w)", re.I)
_TOKEN = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.I)
_SPELLED_DOT = re.compile(rf" (?:{_DOTWORD}) ", re.I)
_OCTET = rf"(?:[0-9]++|(?<!\w)(?:{_WORD})(?:[ \-](?:{_WORD})){{0,2}}(?!\w))"
_GAP = rf"(?:\s{{1,2}}(?:{_DOTWORD})\s{{1,2}}|\s{{0,2}}[\[({{<]\s{{0,2}}(?:{_DOTWORD}|\.)\s{{0,2}}[\])}}>]\s{{0,2}}|\.)"
_SPOKEN_IP = re.compile(rf"(?<![0-9]){_OCTET}(?:{_GAP}{_OCTET}){{3,}}", re.I)
_SPOKEN_PARTS = re.compile(rf"(?P<dot>{_GAP})|(?P<word>{_WORD})|(?P<sep>[ \-])", re.I)
_DOT_DIGIT = re.compile(rf"(?:{_DOTWORD})[\])}}>\s]\s{{0,2}}(?:[0-9]|(?:{_WORD})(?!\w))", re.I)
_PLUS = re.compile(r"(?<!\w)(?:plus|más)[ ]{1,2}(?=[0-9(])", re.I)
_AT = re.compile(rf"\s{{0,2}}[\[({{<]\s{{0,2}}(?:{_ATWORD}|@)\s{{0,2}}[\])}}>]\s{{0,2}}", re.I)
_DOT = re.compile(rf"\s{{0,2}}[\[({{<]\s{{0,2}}(?:{_DOTWORD}|\.)\s{{0,2}}[\])}}>]\s{{0,2}}", re.I)
_PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9])\s{{1,2}}(?:{_ATWORD})\s{{1,2}}(?=[A-Za-z0-9-]{{1,63}}(?:\s{{1,2}}(?:{_DOTWORD})\s{{1,2}}|\s{{0,2}}[\[(]\s?(?:{_DOTWORD}|\.)\s?[\])]\s{{0,2}})[A-Za-z])", re.I)
_PLAIN_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s{{1,2}}(?:{_DOTWORD})\s{{1,2}}(?=[A-Za-z0-9])", re.I)
_CHAIN = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:\s{{1,2}}(?:{_DOTWORD})\s{{1,2}}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}@[A-Za-z0-9-]{{1,63}}(?:(?:\s{{1,2}}(?:{_DOTWORD})\s{{1,2}}|\.)[A-Za-z0-9-]{{1,63}}){{1,6}}", re.I)
_HIDDEN = re.compile("[­​-‏⁠﻿]+")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s{1,2}@\s{1,2}(?=[A-Za-z0-9-]{1,63}\s{0,2}\.)|(?<=[A-Za-z0-9])\s{1,2}@(?=[A-Za-z0-9-]{1,63}\.)|(?<=[A-Za-z0-9])@\s{1,2}(?=[A-Za-z0-9-]{1,63}\.)")
_GLYPH_DIGITS = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OolI](?:[ ().-]{0,2}[0-9OolI]){7,24}(?![A-Za-z0-9])")
# What a lower-cased text is searched for: each begins with few characters, so that a search skips the others.
_BRACKETED = re.compile(rf"[\[({{<]\s{{0,2}}(?:{_ATWORD}|{_DOTWORD}|@|\.)\s{{0,2}}[\])}}>]")
_SPACED_DOT = re.compile(rf"\s(?:{_DOTWORD})\s")
_LOOSE_AT = re.compile(r"\s@|@\s")
_PLUS_WORD = re.compile(r"(?<!\w)(?:plus|más) ")
_GLYPH_AFTER = re.compile(r"[0-9][ ().-]{0,2}[oli]")
_GLYPH_BEFORE = re.compile(r"[oli][ ().-]{0,2}[0-9]")
_SPELL_TRIGGER = re.compile(rf"(?<!\w)(?:{_WORD})[ \-.,]{{1,2}}(?:{_WORD}|[0-9])|[0-9][ \-.,]{{1,2}}(?:{_WORD})(?!\w)")


def _lower(text: str) -> str:
    """Lower case; the letters i that only ``re.I`` takes for one become one."""
    return (text if text.isascii() else text.replace("İ", "i").replace("ı", "i")).lower()


def _triggered(low: str) -> bool:
    """Whether a lower-cased text has a sign of a disguise other than spelled numbers."""
    return bool(
        _BRACKETED.search(low)
        or (any(w in low for w in _DOTWORD.split("|")) and _SPACED_DOT.search(low))
        or ("@" in low and _LOOSE_AT.search(low))
        or (("plus " in low or "más " in low) and _PLUS_WORD.search(low))
        or _GLYPH_AFTER.search(low)
        or _GLYPH_BEFORE.search(low)
        or (not low.isascii() and _HIDDEN.search(low))
    )


class _Mapped:
    """A text under edits, with the source span of every character."""

    def __init__(self, text: str):
        self.text, self.starts, self.sources = text, [0], [0]  # pieces: where each begins here, and in the source
        self.ends = {}  # begin of an edited piece -> end of its source span

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """``edits``: ascending, apart from each other: (start, end, replacement) in the present text."""
        if not edits:
            return
        pieces, out, at, here = [], [], 0, 0
        for a, b, to in edits:
            if a > at:
                pieces.append((here, at, a, None))
                out.append(self.text[at:a])
                here += a - at
            pieces.append((here, a, b, to))
            out.append(to)
            here += len(to)
            at = b
        pieces.append((here, at, len(self.text), None))
        out.append(self.text[at:])
        starts, sources, ends = [], [], {}
        for here, a, b, to in pieces:
            if to is not None:
                if to:
                    starts.append(here)
                    sources.append(self.source(a)[0])
                    ends[here] = (self.source(b - 1)[1], len(to))
                continue
            if a == b:
                continue
            i = bisect_right(self.starts, a) - 1
            while i < len(self.starts) and self.starts[i] < b:
                begin = max(a, self.starts[i])
                starts.append(here + begin - a)
                if self.starts[i] in self.ends:
                    sources.append(self.sources[i])
                    end, n = self.ends[self.starts[i]]
                    ends[here + begin - a] = (end, n - (begin - self.starts[i]))
                else:
                    sources.append(self.sources[i] + begin - self.starts[i])
                i += 1
        self.text, self.starts, self.sources, self.ends = "".join(out), starts, sources, ends

    def source(self, i: int) -> tuple[int, int]:
        """The source span of one character."""
        k = bisect_right(self.starts, i) - 1
        if self.starts[k] in self.ends:
            return self.sources[k], self.ends[self.starts[k]][0]
        at = self.sources[k] + i - self.starts[k]
        return at, at + 1


def _glyph_digits(m: re.Match) -> list[tuple[int, int, str]]:
    """Letters that stand for digits, one by one: only where every group has a digit and digits are half of it all."""
    groups = [g for g in re.split(r"[ ().+-]+", m[0]) if g]
    letters = sum(c.isalpha() for c in m[0])
    if letters > sum(map(len, groups)) // 2 or not all(any(c.isdigit() for c in g) for g in groups):
        return []
    return [(m.start() + i, m.start() + i + 1, "0" if c in "Oo" else "1") for i, c in enumerate(m[0]) if c.isalpha()]


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """A run with three digit words or more: words become digits, spaced dots dots, and what else stands between goes."""
    if len(_TOKEN.findall(m[0])) < 3:
        return []
    parts = re.compile(rf" (?P<dot>{_DOTWORD}) |(?P<word>{_WORD})|(?P<sep>[ \-,]+)", re.I)
    to = {"dot": lambda _: ".", "word": lambda w: DIGIT_WORDS[w.lower()], "sep": lambda _: ""}
    return [(m.start() + p.start(), m.start() + p.end(), to[p.lastgroup](p[0])) for p in parts.finditer(m[0])]


def _spoken_ip(m: re.Match) -> list[tuple[int, int, str]]:
    """Four numbers or more, in digits or digit words, between dots of which one at least is spoken: a dotted number."""
    if not re.search(_DOTWORD, m[0], re.I):
        return []
    to = {"dot": lambda _: ".", "word": lambda w: DIGIT_WORDS[w.lower()], "sep": lambda _: ""}
    return [(m.start() + p.start(), m.start() + p.end(), to[p.lastgroup](p[0])) for p in _SPOKEN_PARTS.finditer(m[0])]


def _edits(pattern: re.Pattern, text: str, to) -> list[tuple[int, int, str]]:
    if callable(to):
        return [e for m in pattern.finditer(text) for e in to(m)]
    return [(m.start(), m.end(), to) for m in pattern.finditer(text)]


def hidden_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What only the normalised text shows, in source characters; a span equal to or inside a base one of its kind is left out."""
    plain = text if text.isascii() else text.translate(_FOLD)
    low = _lower(plain)
    spelled = _SPELL_TRIGGER.search(low)
    if plain == text and not spelled and not _triggered(low):
        return []
    view = _Mapped(plain)
    view.edit(_edits(_HIDDEN, view.text, ""))
    if _DOT_DIGIT.search(view.text):
        view.edit(_edits(_SPOKEN_IP, view.text, _spoken_ip))
    if spelled or _SPELL_TRIGGER.search(_lower(view.text)):
        view.edit(_edits(_SPELLED, view.text, _spelled))
    view.edit(_edits(_PLUS, view.text, "+"))
    view.edit(_edits(_GLYPH_DIGITS, view.text, _glyph_digits))
    view.edit(_edits(_AT, view.text, "@"))
    view.edit(_edits(_DOT, view.text, "."))
    view.edit(_edits(_PLAIN_AT, view.text, "@"))
    view.edit(_edits(_SPACED_AT, view.text, "@"))
    if "@" in view.text:  # spaced dots count only inside an address
        view.edit([(c.start() + d.start(), c.start() + d.end(), ".") for c in _CHAIN.finditer(view.text) for d in _PLAIN_DOT.finditer(c[0])])
    if view.text == text:
        return []
    out = []
    for kind, a, b in base_spans(view.text):
        span = (kind, view.source(a)[0], view.source(b - 1)[1])
        if not any(k == kind and s <= span[1] and span[2] <= e for k, s, e in base):
            out.append(span)
    return out


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as in ``KINDS``, then by start. Null counts as an empty text."""
    text = text or ""
    base = base_spans(text)
    every = sorted({*base, *hidden_spans(text, base)}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, every


def redact(text: str | None) -> str | None:
    """Every found span becomes ``<KIND>``; overlapping ones merge under the first one's kind. Null stays null."""
    spans = sorted(find_spans(text)[1], key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    merged: list[list] = []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``base`` and ``spans`` (arrays of kind, start, end in code points).

    Null and empty texts have no span; whole texts of any length are read, rows
    are judged one by one, repeated ones alike, and an empty table gives an
    empty one. Other columns are not read. Plain identifiers have no bound but
    their kind's own. What the disguises undo is bounded, so that a text costs
    time in proportion to its length: a spoken address has at most four parts
    before its at sign and seven after it, of 64 and 63 characters, as mail
    allows; digits under look-alikes come in runs of 8 to 25; spelled numbers
    count from three digit words on (in addresses of hosts from one on); and
    at most two blanks stand around a spoken at or dot.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    kind = docs.schema[key].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [find_spans(t) for t in b.column(1).to_pylist()]
            cols = [[[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], item), pa.array(cols[1], item)], ["id", "base", "spans"])

    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", key)


def redact_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same columns with personal data replaced; ``n_chars``, if there, follows the new text.

    Rows with nothing to replace keep text and length as they were; nulls stay null.
    """
    names = docs.columns
    at, size = names.index(text), names.index(n_chars) if n_chars in names else None

    def run(batches):
        for b in batches:
            old = b.column(at).to_pylist()
            new = [redact(t) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if size is not None:
                cols[size] = pa.array([n if a == t else len(t) for a, t, n in zip(old, new, b.column(size).to_pylist(), strict=True)], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(docs, run, docs.schema)


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document. ``n_*`` and ``base_sha256`` are of the plain spans, ``spans`` and ``all_*`` of all.

    An empty or null text has no span: its counts are 0 and ``spans`` is empty.
    """
    found = detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda c, kind: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{k}") for k in KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), *[count("spans", k).alias(f"all_{k}") for k in KINDS]
    )
