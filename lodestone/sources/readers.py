"""Files to text: discovery, dispatch by extension, Arrow-batched reading with errors as a column."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.errors import EngineError
from lodestone.session import arrow_map, spread
from lodestone.sources import encoding, office, pdf_text
from lodestone.sources.html import html_to_markdown

MAX_BYTES = 100 * 1024 * 1024
#: Pages that are read before their texts are handed on.
PAGES = 64
_OFFICE = "application/vnd.openxmlformats-officedocument."
#: (text, format_text, mime, page_count) of a file's bytes.
Result = tuple[str, str | None, str, int | None]


def _text(data: bytes, asked: str) -> Result:
    return encoding.read_text(data, asked), None, "text/plain", None


def _html(data: bytes, asked: str) -> Result:
    return html_to_markdown(encoding.read_text(data, asked)), None, "text/html", None


def _csv(data: bytes, asked: str) -> Result:
    text = encoding.read_text(data, asked)
    return text, office.csv_table(text), "text/csv", None


def _xlsx(data: bytes, asked: str) -> Result:
    text, shown = office.read_xlsx(data)
    return text, shown, _OFFICE + "spreadsheetml.sheet", None


def _docx(data: bytes, asked: str) -> Result:
    return office.read_docx(data), None, _OFFICE + "wordprocessingml.document", None


def _pptx(data: bytes, asked: str) -> Result:
    return office.read_pptx(data), None, _OFFICE + "presentationml.presentation", None


def _pdf(data: bytes, asked: str) -> Result:
    raise EngineError(errors.READER_UNSUPPORTED, "register a PDF reader: none is installed")


#: Readers by extension; ``register`` adds others, a PDF reader for one.
READERS: dict[str, Callable[[bytes, str], Result]] = {"txt": _text, "md": _text, "html": _html, "htm": _html, "csv": _csv, "xlsx": _xlsx, "docx": _docx, "pptx": _pptx, "pdf": _pdf}


def register(extension: str, reader: Callable[[bytes, str], Result]) -> None:
    READERS[extension.lower().lstrip(".")] = reader


def read_bytes(data: bytes, extension: str, asked: str = "utf-8", readers: dict | None = None) -> Result:
    reader = (READERS if readers is None else readers).get(extension.lower().lstrip("."))
    if reader is None:
        raise EngineError(errors.READER_UNSUPPORTED, f"no reader for {extension!r}")
    try:
        return reader(data, asked)
    except EngineError:
        raise
    except Exception as e:  # a reader may fail in any way on a broken file; the row says so
        raise EngineError(errors.READER_PARSE, f"{type(e).__name__}: {e}") from e


def eligible(path: Column, length: Column, most: int = MAX_BYTES) -> Column:
    """Files that are not hidden, not caches and not too large."""
    name = F.substring_index(path, "/", -1)
    return ~name.startswith(".") & ~F.contains(path, F.lit("/__pycache__/")) & (length <= most)


def list_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """``(path, length, content, eligible)`` of files and folders, and warnings for paths that are missing.

    Folders are searched to any depth. ``content`` is read only where a later
    step uses it, so filters on path and length come first. A path counts once.
    """
    warnings, found = [], []
    for p in dict.fromkeys(paths):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            found.append(p)
        else:
            warnings.append(f"{p}: not found")
    if not found:
        return spark.createDataFrame([], "path string, length long, content binary, eligible boolean"), warnings
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found)
    return df.select("path", "length", "content", eligible(F.col("path"), F.col("length")).alias("eligible")), warnings


def read_files(files: DataFrame, asked: str = "utf-8", readers: dict | None = None) -> DataFrame:
    """``path, filename, extension, text, format_text, mime, page_count, error``: a file that fails has an error and no text."""
    table = dict(READERS if readers is None else readers)
    name = F.substring_index("path", "/", -1)
    suffix = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))
    source = files.select("path", name.alias("filename"), suffix.alias("extension"), "content")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # one file at a time: contents may be large
                row = b.slice(k, 1)
                error, result = None, (None, None, None, None)
                try:
                    result = read_bytes(row.column(3)[0].as_py() or b"", row.column(2)[0].as_py(), asked, table)
                except EngineError as e:
                    error = {"code": e.code, "message": e.message}
                cols = [pa.array([result[0]], pa.string()), pa.array([result[1]], pa.string()), pa.array([result[2]], pa.string()), pa.array([result[3]], pa.int32()), pa.array([error], pa.struct([("code", pa.string()), ("message", pa.string())]))]
                yield pa.RecordBatch.from_arrays([*row.columns[:3], *cols], ["path", "filename", "extension", "text", "format_text", "mime", "page_count", "error"])

    return source.mapInArrow(run, "path string, filename string, extension string, text string, format_text string, mime string, page_count int, error struct<code:string,message:string>")


def read_pages(pages: DataFrame, url: str = "url", body: str = "html", content_type: str | None = None) -> DataFrame:
    """Fetched pages as files: format from content type, body or path; the name is authority and path.

    Fetching itself is left to the caller, who brings the bodies.
    """
    from lodestone.functions import urls as U

    kind = U.infer_format(F.col(url), F.col(content_type) if content_type else F.lit(None).cast("string"), F.col(body).cast("string"))
    files = pages.select(F.concat(F.lit("x/page."), kind).alias("path"), F.col(body).cast("binary").alias("content"), F.col(url).alias("_url"))
    table = dict(READERS)
    source = files.select("_url", F.substring_index("path", ".", -1).alias("extension"), "content")

    def run(batches):
        for b in (whole.slice(at, PAGES) for whole in batches for at in range(0, whole.num_rows, PAGES)):
            rows = []
            for ext, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    rows.append((*read_bytes(data or b"", ext, "utf-8", table)[:3], None))
                except EngineError as e:
                    rows.append((None, None, None, {"code": e.code, "message": e.message}))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.string()] * 3 + [pa.struct([("code", pa.string()), ("message", pa.string())])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["url", "extension", "text", "format_text", "mime", "error"])

    out = arrow_map(spread(source), run, "url string, extension string, text string, format_text string, mime string, error struct<code:string,message:string>")
    return out.withColumn("filename", U.filename_of(F.col("url")))


def read_file(path: str, asked: str = "utf-8") -> dict:
    """One local file: text, format_text, mime, page_count, filename. Errors carry a code."""
    name = os.path.basename(path)
    try:
        with open(path, "rb") as f:
            data = f.read()
    except FileNotFoundError as e:
        raise EngineError(errors.READER_NOT_FOUND, path) from e
    except PermissionError as e:
        raise EngineError(errors.READER_PERMISSION, path) from e
    except OSError as e:
        raise EngineError(errors.READER_PARSE, f"{path}: {e}") from e
    text, shown, mime, pages = read_bytes(data, os.path.splitext(name)[1], asked)
    return {"text": text, "format_text": shown, "mime": mime, "page_count": pages, "filename": name}


#: url to (content type or None, body); raises what it likes.
Fetcher = Callable[[str], tuple[str | None, bytes]]
MAX_PAGE_BYTES = 1_000_000_000


def fetch_pages(urls: DataFrame, fetcher: Fetcher, url: str = "url", most: int = MAX_PAGE_BYTES, parts: int | None = None) -> DataFrame:
    """``url, content_type, body, error`` of pages that ``fetcher`` gets on the executors; ``parts`` bounds how many work at once."""
    source = urls.select(F.col(url).alias("url"))
    source = source.repartition(parts) if parts else source

    def run(batches):
        for b in batches:
            for u in b.column(0).to_pylist():
                kind, body, error = None, None, None
                try:
                    kind, body = fetcher(u)
                    if len(body) > most:
                        body, error = None, {"code": errors.READER_TOO_LARGE, "message": u}
                except Exception as e:  # a page that cannot be had is a row with an error
                    error = {"code": errors.READER_PARSE, "message": f"{u}: {e}"}
                cols = [pa.array([u], pa.string()), pa.array([kind], pa.string()), pa.array([body], pa.binary()), pa.array([error], pa.struct([("code", pa.string()), ("message", pa.string())]))]
                yield pa.RecordBatch.from_arrays(cols, ["url", "content_type", "body", "error"])

    return source.mapInArrow(run, "url string, content_type string, body binary, error struct<code:string,message:string>")


def register_pdf(pages_of: Callable[[bytes], list[str]], nfkc: bool = False) -> None:
    """Installs a PDF reader from a function that gives the texts of the pages; they are cleaned as ``operators.pdf_lines`` does."""

    def reader(data: bytes, asked: str) -> Result:
        pages = pages_of(data)
        text = pdf_text.clean_pages(pages)
        return unicodedata.normalize("NFKC", text) if nfkc else text, None, "application/pdf", len(pages)

    register("pdf", reader)


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a JSON-lines file; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
