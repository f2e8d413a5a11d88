"""Text expressions: normalisation, lengths, titles, terms. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin, digits and the underscore of any script; CJK ideographs are handled apart.
WORD = r"(?U)\w+"
CJK = r"[一-鿿]"
#: A CJK ideograph as the normaliser sees it.
_IDEOGRAPH = r"[一-龥]"
_BASE64_IMAGE = r"(?i)!\[[^\]]*\]\(data:[^;]+;base64,[A-Za-z0-9+/=]+\)"


def valid_length(text: Column | str) -> Column:
    """Characters that are not white space of any script."""
    return F.length(F.regexp_replace(text, r"(?U)[\s　]+", ""))


def trim_unicode(text: Column | str) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalise(text: Column | str) -> Column:
    """Blanks between ideographs go, line ends become ``\\n``, long gaps two of them, control characters spaces.

    A pair of ideographs shares none with the next, so of ``a b c`` the second
    blank stays.
    """
    text = F.regexp_replace(text, rf"({_IDEOGRAPH})[ \t　]+({_IDEOGRAPH})", "$1$2")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return trim_unicode(F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f]", " "))


def space_ideograph_punctuation(text: Column | str) -> Column:
    """A space after ASCII punctuation between ideographs."""
    return F.regexp_replace(text, rf"({CJK})([!?,;.])({CJK})", "$1$2 $3")


def presplit(text: Column | str) -> Column:
    """Segments at blank lines and punctuation before a non-blank; delimiters are segments, blank ones are dropped."""
    marked = F.regexp_replace(text, r"(?U)(\n\n|[。！？；，]|[!?,;.])(?=\S)", "\u0000$1\u0000")
    return F.filter(F.split(marked, "\u0000"), lambda s: F.length(trim_unicode(s)) > 0)


def strip_base64_images(markdown: Column | str) -> Column:
    return F.regexp_replace(markdown, _BASE64_IMAGE, "")


def heading_title(text: Column) -> Column:
    """First Markdown heading of level 1 to 5, else the first ``h1`` with its blanks collapsed, else null."""
    markdown = trim_unicode(F.regexp_extract(text, r"(?m)^#{1,5}\s+(.+)$", 1))
    html = trim_unicode(F.regexp_replace(F.regexp_extract(text, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(markdown, F.lit("")), F.nullif(html, F.lit("")))


def title(text: Column, filename: Column) -> Column:
    return F.coalesce(heading_title(text), filename)


def heading_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^#{1,5}\s+\S+"))


def terms(text: Column | str) -> Column:
    """Search terms in order: lower-case words, and of ideographs each one and each pair. A stand-in for a segmenter."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")
    has_ideograph = lambda w: w.rlike(CJK)
    singles = lambda w: F.regexp_extract_all(w, F.lit(rf"{CJK}|[^一-鿿]+"), F.lit(0))
    pairs = lambda w: F.filter(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2))), lambda p: p.rlike(rf"^{CJK}{{2}}$")
    )
    cut = F.flatten(F.transform(words, lambda w: F.when(has_ideograph(w), F.concat(singles(w), pairs(w))).otherwise(F.array(w))))
    whole = F.col(text) if isinstance(text, str) else text
    return F.when(whole.rlike(CJK), cut).otherwise(words)  # most texts need the words alone


def heuristic_tokens(text: Column | str) -> Column:
    """Distinct lower-case word runs without ideographs, and each ideograph by itself."""
    low = F.lower(text)
    runs = F.filter(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: ~w.rlike(CJK))
    return F.array_distinct(F.concat(runs, F.regexp_extract_all(low, F.lit(CJK), F.lit(0))))


def claims(text: Column | str) -> Column:
    """Token sets of the non-blank sentences of a text; sentences without a token are left out."""
    parts = F.filter(F.split(text, r"[.!?。！？\n]+"), lambda s: F.length(trim_unicode(s)) > 0)
    return F.filter(F.transform(parts, heuristic_tokens), lambda t: F.size(t) > 0)


def variant_key(text: Column | str) -> Column:
    """Equal for texts that differ in case and punctuation alone."""
    return F.lower(F.regexp_replace(text, r"(?U)[^\w]+", ""))


def windows(text: Column, size: int) -> Column:
    """Contiguous windows of ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))


def estimated_tokens(text: Column | str) -> Column:
    """A deterministic stand-in for a tokenizer: one for each ideograph, and one for four other characters."""
    ideographs = F.regexp_count(text, F.lit(CJK))
    return (ideographs + F.ceil((F.length(text) - ideographs) / 4)).cast("int")


def is_markdown_table(text: Column) -> Column:
    """A header between pipes, a separator row, and pipes around every further row that is not blank."""
    lines = F.split(text, "\n")
    head, line = F.trim(F.get(lines, F.lit(0))), F.trim(F.get(lines, F.lit(1)))
    rest = F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))
    framed = F.forall(rest, lambda r: (F.trim(r) == "") | r.rlike(r"^\s*\|.*\|\s*$"))
    return F.coalesce((F.size(lines) > 1) & head.startswith("|") & head.endswith("|") & line.rlike(r"^(\|[\s:]*-+[\s:]*)+\|$") & framed, F.lit(False))


def is_code_block(text: Column) -> Column:
    return trim_unicode(text).rlike(r"(?s)^(?:```.*?```|~~~.*?~~~)$")
