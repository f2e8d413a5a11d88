"""Texts, pages and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.operators import chunking, pdf_lines
from lodestone.plans import seams
from lodestone.plans.catalogue_search import _read
from lodestone.sources import readers


def _docs(spark, sf_dir):
    return _read(spark, sf_dir, "documents")


def valid_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.valid_length("text").alias("n"))


def text_normalise(spark, sf_dir):
    """Texts with carriage returns, long gaps and control characters put in."""
    rough = F.concat(F.lit(" \t"), F.regexp_replace("text", r"\n", "\r\n\n\n"), F.lit("\u0007."))
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalise(rough).cast("binary")).alias("digest"))


def presplit(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(X.presplit("text")).alias("pieces"))


def md_base64_strip(spark, sf_dir):
    rough = F.concat("text", F.lit("![a b](data:image/png;base64,iVBORw0+/=)"), "text", F.lit("![x](http://y)"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.strip_base64_images(rough).cast("binary")).alias("digest"))


def title_extract(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", X.title(F.col("html"), U.filename_of(F.col("url"))).alias("title"))


def heading_count(spark, sf_dir):
    rough = F.regexp_replace("text", r"\n", "\n# ")
    return _docs(spark, sf_dir).select("doc_id", X.heading_count(rough).alias("headings"))


def sliding_window_chunks(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.windows(F.col("text"), 1000)).alias("chunk_index", "w"))
    return rows.select("doc_id", "chunk_index", F.length("w").alias("size"), F.md5(F.col("w").cast("binary")).alias("digest"))


def estimated_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.estimated_tokens("text").alias("tokens"))


def url_format_infer(spark, sf_dir):
    kind = F.when(F.col("page_id") % 4 == 0, "text/plain; charset=utf-8").when(F.col("page_id") % 4 == 1, "application/unknown")
    body = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.lit("plain"))
    pages = _read(spark, sf_dir, "pages")
    return pages.select("page_id", U.infer_format(F.col("url"), kind, body).alias("format"))


def filename_from_url(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", U.filename_of(F.col("url")).alias("filename"))


def _pages(spark, sf_dir):
    """Documents as pages, cut at full stops before a line end."""
    return _docs(spark, sf_dir).select("doc_id", F.split("text", r"\.\n").alias("pages"))


def pdf_repeated_lines(spark, sf_dir):
    lines = pdf_lines.page_lines(_pages(spark, sf_dir), "doc_id", "pages")
    return pdf_lines.repeated_lines(lines, "doc_id")


def visual_line_merge(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", pdf_lines.merge_visual(F.transform(F.split("text", "\n"), lambda line: F.trim(line))).alias("l"))
    return rows.select("doc_id", F.posexplode("l").alias("line_no", "line"))


def pdf_text(spark, sf_dir):
    return pdf_lines.document_text(_pages(spark, sf_dir)).select("doc_id", F.length("text").alias("n"))


def markdown_tables(spark, sf_dir):
    table = F.concat(F.lit("|a|b|\n|---|:-:|\n|"), F.regexp_replace("text", r"\s+", " "), F.lit("|"), F.when(F.col("doc_id") % 2 == 0, F.lit("x|")).otherwise(F.lit("x")))
    return _docs(spark, sf_dir).select("doc_id", X.is_markdown_table(table).alias("is_table"), X.is_code_block(F.concat(F.lit("```\n"), "text", F.lit("\n``` "))).alias("is_code"))


def chunk_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return chunking.chunk_documents(docs).select("doc_id", "chunk_index", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def html_to_markdown(spark, sf_dir):
    pages = readers.read_pages(_read(spark, sf_dir, "pages").select("url", "html"))
    return pages.select("url", "extension", "mime", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


def read_encodings(spark, sf_dir):
    """Texts written in four encodings and read back."""
    docs = _docs(spark, sf_dir)
    name = F.when(F.col("doc_id") % 4 == 0, "utf-16").otherwise("utf-8")
    files = docs.select(F.concat(F.lit("/x/"), "doc_id", F.lit(".txt")).alias("path"), F.when(name == "utf-16", F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return readers.read_files(files).select("filename", F.md5(F.col("text").cast("binary")).alias("digest"))


def embed_texts(spark, sf_dir):
    rows = seams.embed(_docs(spark, sf_dir).select("doc_id", "text"), seams.HashEmbedder(16))
    return rows.select("doc_id", F.size("embedding").alias("dim"), "embed_error")


QUERIES = {f.__name__: f for f in (
    valid_length, text_normalise, presplit, md_base64_strip, title_extract, heading_count, sliding_window_chunks, estimated_tokens, url_format_infer, filename_from_url, pdf_repeated_lines, visual_line_merge, pdf_text, markdown_tables, chunk_documents,
    html_to_markdown, read_encodings, embed_texts,
)}

_FILENAME = r"coalesce(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) || regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ''), url)"
_LINES = r"""raw as (select doc_id, unnest(string_split_regex(text, '\.\n')) as p, generate_subscripts(string_split_regex(text, '\.\n'), 1) as page from documents),
  lines as (select doc_id, page, trim(unnest(string_split(p, chr(10)))) as line from raw)"""

ORACLE_SQL = {
    "valid_length": r"select doc_id, length(regexp_replace(text, '\s+', '', 'g'))::int as n from documents",
    "text_normalise": r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(' ' || chr(9) || replace(text, chr(10), chr(10) || chr(10) || chr(10)) || chr(7) || '.', chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g'), '^\s+|\s+$', '', 'g')) as digest from documents""",
    "md_base64_strip": "select doc_id, md5(text || text || '![x](http://y)') as digest from documents",
    "title_extract": rf"""select page_id, coalesce(nullif(trim(regexp_extract(html, '(?m)^#{{1,5}}\s+(.+)$', 1)), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g')), ''), {_FILENAME}) as title from pages""",
    "heading_count": r"select doc_id, len(regexp_extract_all(replace(text, chr(10), chr(10) || '# '), '(?m)^#{1,5}\s+\S+'))::int as headings from documents",
    "sliding_window_chunks": """select doc_id, i::int as chunk_index, length(substr(text, i * 1000 + 1, 1000))::int as size, md5(substr(text, i * 1000 + 1, 1000)) as digest
        from (select doc_id, text, unnest(range(0, greatest(1, ((length(text) + 999) // 1000)::bigint))) as i from documents)""",
    "estimated_tokens": "select doc_id, ceil(length(text) / 4.0)::int as tokens from documents",
    "url_format_infer": r"""with p as (select page_id, url, case when page_id % 3 = 0 then lower(ltrim(html)) else 'plain' end as head, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\.([^./]*)$', 1)) as suffix from pages)
        select page_id, case when page_id % 4 = 0 then 'txt' when head like '<!doctype html%' or head like '<html%' then 'html' when suffix in ('txt', 'md', 'html', 'htm', 'pdf', 'docx', 'pptx', 'csv', 'xlsx') then suffix else 'txt' end as format from p""",
    "filename_from_url": f"select page_id, {_FILENAME} as filename from pages",
    "pdf_repeated_lines": f"with {_LINES} select doc_id, line, count(*) as times from lines where length(line) between 1 and 30 group by 1, 2 having count(*) >= 3",
    "visual_line_merge": r"""with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
        f as (select *, line = '' or regexp_matches(line, '^\s*(?:[-*]|\d+\.)\s+') as alone from l),
        g as (select *, case when alone or lag(alone, 1, true) over w or regexp_matches(lag(line) over w, '[。.!?！？]\s*$') then 1 else 0 end as starts from f window w as (partition by doc_id order by i)),
        h as (select *, sum(starts) over (partition by doc_id order by i) as grp from g)
        select doc_id, (grp - 1)::int as line_no, string_agg(line, ' ' order by i) as line from h group by doc_id, grp""",
    "markdown_tables": "select doc_id, doc_id % 2 = 0 as is_table, true as is_code from documents",
    "read_encodings": "select doc_id || '.txt' as filename, md5(text) as digest from documents",
    "embed_texts": "select doc_id, 16 as dim, null::varchar as embed_error from documents",
}
