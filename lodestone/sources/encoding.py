"""Bytes to text. Decoding never fails."""

from __future__ import annotations

import re

#: Encodings to try after UTF-8, and names that a caller may ask for.
FALLBACKS = ("gb18030", "gbk", "big5", "cp936", "cp1252", "latin-1")
ASKED = {"ascii": "ascii", "utf-8": "utf-8", "utf16le": "utf-16-le", "utf-16le": "utf-16-le", "ucs2": "utf-16-le", "ucs-2": "utf-16-le", "latin1": "latin-1", "binary": "latin-1"}
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
_BASE64_IMAGE = re.compile(r"!\[[^\]]*\]\(data:[^;]+;base64,[A-Za-z0-9+/=]+\)", re.IGNORECASE)


def detect(data: bytes) -> str:
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    for name in ("utf-8", *FALLBACKS):
        try:
            data.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return "utf-8"


def resolve(data: bytes, asked: str | None) -> str:
    """The asked encoding, but a guess where that is UTF-8 or none."""
    name = (asked or "").strip().lower().replace("_", "-")
    name = "utf-8" if name in ("", "utf8") else name
    return detect(data) if name == "utf-8" else name


def decode(data: bytes, asked: str | None = "utf-8") -> str:
    name = resolve(data, asked)
    if name == "ascii" and not data.isascii():
        name = "utf-8"
    for attempt in (ASKED.get(name, name), detect(data)):
        try:
            return data.decode(attempt).removeprefix("\ufeff")
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def read_text(data: bytes, asked: str | None = "utf-8") -> str:
    """Decoded text without Base64 images of Markdown."""
    return _BASE64_IMAGE.sub("", decode(data, asked))
