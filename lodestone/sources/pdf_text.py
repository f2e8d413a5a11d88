"""Page texts of one file to a text, for readers that run file by file; tables of pages use ``operators.pdf_lines``."""

from __future__ import annotations

import re
from collections import Counter
from itertools import dropwhile

SHORT, TIMES = 30, 3
_NUMBER = re.compile(r"\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|page\s+\d+", re.IGNORECASE)
_BULLET = re.compile(r"\s*(?:[-*]|\d+\.)\s+")
_END = re.compile(r"[。.!?！？]\s*$")


def trimmed(page: str) -> list[str]:
    blank = lambda line: not line
    lines = list(dropwhile(blank, (x.strip() for x in page.splitlines())))
    return list(dropwhile(blank, reversed(lines)))[::-1]


def visual(lines: list[str]) -> list[str]:
    """Lines that go on become one; blank ones, bullets and ends of sentences part them."""
    out: list[str] = []
    open_line = False
    for line in lines:
        alone = not line or bool(_BULLET.match(line))
        if open_line and not alone and not _END.search(out[-1]):
            out[-1] += f" {line}"
        else:
            out.append(line)
        open_line = not alone
    return out


def clean_pages(pages: list[str]) -> str:
    found = [trimmed(p) for p in pages]
    seen = Counter(x for lines in found for x in lines if x and len(x) <= SHORT)
    texts = []
    for lines in found:
        kept = visual([x for x in lines if seen[x] < TIMES and not _NUMBER.fullmatch(x)])
        if kept:
            texts.append("\n".join(kept))
    body = "\n\n".join(texts)
    return body + "\n" if body and not body.endswith("\n") else body
