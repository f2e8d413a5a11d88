"""Text of paged documents: edges, repeated lines, page numbers, visual lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.session import arrow_map, spread

REPEATED_LENGTH = 30
REPEATED_TIMES = 3
_PAGE_NUMBER = r"(?i)^(?:\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|page\s+\d+)\s*$"
_SENTENCE_END = r"[。.!?！？]\s*\z"
_BULLET = r"^\s*(?:[-*]|\d+\.)\s+"
#: The same for Python, of stripped lines; digits and blanks are those of ASCII, as in the expressions.
_LINE_END = re.compile(r"\r\n|\r|\n")
_NUMBER = re.compile(r"\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|page\s+\d+", re.IGNORECASE | re.ASCII)
_BULLET_LINE = re.compile(r"(?:[-*]|\d+\.)\s+", re.ASCII)


def trimmed_lines(page: Column | str) -> Column:
    """Lines of a page without the blank ones at both ends."""
    lines = F.split(page, r"\r\n|\r|\n")
    shown = F.filter(F.transform(lines, lambda x, i: F.when(F.length(X.trim_unicode(x)) > 0, i + 1)), lambda i: i.isNotNull())
    first, last = F.array_min(shown), F.array_max(shown)
    return F.when(F.size(shown) == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.coalesce(first, F.lit(1)), F.coalesce(last - first + 1, F.lit(0))))


def page_lines(docs: DataFrame, key: str, pages: str) -> DataFrame:
    """``(key, page, line_no, line)`` of all trimmed pages; lines are stripped."""
    rows = docs.select(key, F.posexplode(pages).alias("page", "p"))
    return rows.select(key, "page", F.posexplode(trimmed_lines("p")).alias("line_no", "line")).withColumn("line", X.trim_unicode("line"))


def repeated_lines(lines: DataFrame, key: str, length: int = REPEATED_LENGTH, times: int = REPEATED_TIMES) -> DataFrame:
    """Short lines that a document has ``times`` times or more, on whichever pages."""
    short = lines.filter((F.length("line") > 0) & (F.length("line") <= length))
    return short.groupBy(key, "line").agg(F.count("*").alias("times")).filter(F.col("times") >= times)


def drop_noise(lines: DataFrame, key: str, drop_page_numbers: bool = True) -> DataFrame:
    out = lines.join(repeated_lines(lines, key).select(key, "line"), [key, "line"], "left_anti")
    return out.filter(~F.col("line").rlike(_PAGE_NUMBER)) if drop_page_numbers else out


def merge_visual(lines: Column) -> Column:
    """A line continues the one before, unless that ends a sentence; blank lines and bullets stand alone."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def step(s: Column, line: Column) -> Column:
        alone = (line == "") | line.rlike(_BULLET)
        last = F.element_at(s["out"], -1)
        joins = s["open"] & ~F.coalesce(F.try_element_at(s["out"], F.lit(-1)), F.lit("")).rlike(_SENTENCE_END)
        grown = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), line)))
        return (
            F.when(alone, F.struct(F.concat(s["out"], F.array(line)).alias("out"), F.lit(False).alias("open")))
            .when(joins, F.struct(grown.alias("out"), F.lit(True).alias("open")))
            .otherwise(F.struct(F.concat(s["out"], F.array(line)).alias("out"), F.lit(True).alias("open")))
        )

    return F.aggregate(lines, start, step)["out"]


def cleaned(pages: Iterable[str | None], merge: bool = True, drop_page_numbers: bool = True) -> str:
    """The text of one document's pages, as the expressions above have it."""
    found = []
    for page in pages:
        lines = [x.strip() for x in _LINE_END.split(page)] if page is not None else []
        shown = [i for i, x in enumerate(lines) if x]
        found.append(lines[shown[0] : shown[-1] + 1] if shown else [])
    seen = Counter(x for lines in found for x in lines if x and len(x) <= REPEATED_LENGTH)
    texts = []
    for lines in found:
        kept = [x for x in lines if seen[x] < REPEATED_TIMES and not (drop_page_numbers and _NUMBER.fullmatch(x))]
        if merge:
            kept = _merged(kept)
        if kept:
            texts.append("\n".join(kept))
    body = "\n\n".join(texts)
    return body + "\n" if body and not body.endswith("\n") else body


def _merged(lines: list[str]) -> list[str]:
    """``merge_visual`` of stripped lines, each joined once."""
    out: list[list[str]] = []
    goes_on = False
    for line in lines:
        alone = not line or bool(_BULLET_LINE.match(line))
        if goes_on and not alone and out[-1][-1][-1] not in "。.!?！？":
            out[-1].append(line)
        else:
            out.append([line])
        goes_on = not alone
    return [" ".join(x) for x in out]


def document_text(docs: DataFrame, key: str = "doc_id", pages: str = "pages", merge: bool = True, drop_page_numbers: bool = True) -> DataFrame:
    """``(key, text)``: cleaned pages with a blank line between them and one line end last; empty without any line.

    A row is a document, and all its pages are in it: rows are cleaned where they
    lie, with no shuffle.
    """

    def run(batches):
        for b in batches:
            texts = [cleaned(p or (), merge, drop_page_numbers) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(spread(docs.select(F.col(key).alias("key"), pages)), run, f"key {kind}, text string").withColumnRenamed("key", key)
