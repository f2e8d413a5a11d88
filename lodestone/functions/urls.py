"""URL and format expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types and the formats that readers exist for.
CONTENT_TYPES = {
    "text/plain": "txt",
    "text/markdown": "md",
    "text/html": "html",
    "application/xhtml+xml": "html",
    "text/csv": "csv",
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}
FORMATS = ("txt", "md", "html", "htm", "pdf", "docx", "pptx", "csv", "xlsx")
IMAGE_TYPES = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/svg+xml": "svg"}



def format_of_content_type(content_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair]), F.lower(F.trim(F.substring_index(content_type, ";", 1))))


def format_of_body(body: Column) -> Column:
    """By the first characters of a body: PDF or HTML, else null."""
    head = F.lower(F.ltrim(F.regexp_replace(F.substring(body, 1, 512), r"^\s+", "")))
    html = head.startswith("<!doctype html") | head.startswith("<html") | (head.startswith("<?xml") & F.contains(head, F.lit("<html")))
    return F.when(F.regexp_replace(F.substring(body, 1, 512), r"^\s+", "").startswith("%PDF"), "pdf").when(html, "html")


def format_of_path(url: Column) -> Column:
    """The suffix of the last path segment, if a reader knows it."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.when(suffix.isin(*FORMATS), suffix)


def infer_format(url: Column, content_type: Column, body: Column) -> Column:
    """Content type, then the body, then the path, then plain text."""
    return F.coalesce(format_of_content_type(content_type), format_of_body(body), format_of_path(url), F.lit("txt"))


def filename_of(url: Column) -> Column:
    """Authority and path, or the url itself without either."""
    name = F.concat(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    return F.coalesce(F.nullif(name, F.lit("")), url)


def image_extension(mime: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in IMAGE_TYPES.items() for x in pair]), F.lower(mime)), F.lit("bin"))
