"""Spreadsheets, presentations and word files from their XML parts, and CSV."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from lodestone.errors import READER_PARSE, EngineError

#: Fixed value: stands between the tables of two sheets.
SHEET_SIGN = "-----CUSTOM-SPLIT-SIGN-----"


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise EngineError(READER_PARSE, f"not a package: {e}") from e


def _xml(package: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(package.read(name))
    except (KeyError, ElementTree.ParseError) as e:
        raise EngineError(READER_PARSE, f"{name}: {e}") from e


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _all(element: ElementTree.Element, name: str):
    return (x for x in element.iter() if _local(x) == name)


def table_row(cells: list[str], width: int) -> str:
    cells = [*cells[:width], *[""] * (width - len(cells))]
    return "| " + " | ".join(c.replace("\n", "\\n") for c in cells) + " |"


def csv_table(text: str) -> str | None:
    """A Markdown table as wide as the header; blank rows are skipped; none without a header."""
    try:
        rows = [r for r in csv.reader(io.StringIO(text)) if r and r != [""]]
    except csv.Error as e:
        raise EngineError(READER_PARSE, str(e)) from e
    if not rows:
        return None
    width = len(rows[0])
    return "\n".join([table_row(rows[0], width), table_row(["---"] * width, width), *(table_row(r, width) for r in rows[1:])])


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _all(cell, "t"))
    value = next((v.text or "" for v in cell if _local(v) == "v"), "")
    if kind == "s" and value:
        return shared[int(value)]
    if kind == "b":
        return str(value == "1")
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", value):
        return value.split(".")[0]
    return value


def read_xlsx(data: bytes) -> tuple[str, str | None]:
    """(CSV of all sheets, Markdown tables of those with two rows or more). Computed values; hidden sheets too."""
    with _open(data) as package:
        names = package.namelist()
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(_xml(package, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in _all(_xml(package, "xl/_rels/workbook.xml.rels"), "Relationship")}
        plain, shown = [], []
        for sheet in _all(_xml(package, "xl/workbook.xml"), "sheet"):
            target = next((targets[v] for k, v in sheet.attrib.items() if k.endswith("}id") and v in targets), "")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            if path not in names:
                continue
            rows = []
            for row in _all(_xml(package, path), "row"):
                cells: dict[int, str] = {}
                for at, c in enumerate(x for x in row if _local(x) == "c"):
                    cells[_column(c.get("r", "")) if c.get("r") else at] = _cell(c, shared)
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            width = max(map(len, rows), default=0)
            rows = [[*r, *[""] * (width - len(r))] for r in rows if any(r)]
            if rows:
                plain.append("\n".join(",".join(r) for r in rows))
            if len(rows) > 1:
                shown.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "|".join(["---"] * width) + "|", *(table_row(r, width) for r in rows[1:])]))
        return "\n".join(plain), SHEET_SIGN.join(shown) if shown else None


def read_pptx(data: bytes) -> str:
    """Paragraphs of slides and notes, by the number in the part's name; a package without a slide is refused."""
    with _open(data) as package:
        parts = [n for n in package.namelist() if re.fullmatch(r"ppt/(slides|notesSlides)/[^/]+\.xml", n)]
        if not any(n.startswith("ppt/slides/") for n in parts):
            raise EngineError(READER_PARSE, "no slide")
        number = lambda n: int(next(iter(re.findall(r"\d+", n)), 0))
        out = []
        for name in sorted(parts, key=lambda n: (number(n), n)):
            for p in _all(_xml(package, name), "p"):
                runs = [t.text or "" for t in _all(p, "t")]
                if runs:
                    out.append("".join(runs))
        return "\n".join(out)


def _paragraph(p: ElementTree.Element, relations: dict[str, str]) -> str:
    out = []

    def walk(x: ElementTree.Element, bold: bool = False):
        name = _local(x)
        if name == "hyperlink":
            text = "".join(t.text or "" for t in _all(x, "t"))
            target = next((relations.get(v) for k, v in x.attrib.items() if k.endswith("}id")), None)
            out.append(f"[{text}]({target})" if target else text)
        elif name == "r":
            properties = next((c for c in x if _local(c) == "rPr"), None)
            bold = properties is not None and any(_local(c) == "b" and not any(v in ("0", "false") for v in c.attrib.values()) for c in properties)
            text = "".join("\n" if _local(t) == "br" else "\t" if _local(t) == "tab" else t.text or "" for t in x if _local(t) in ("t", "br", "tab"))
            out.append(f"**{text}**" if bold and text.strip() else text)
        else:
            for c in x:
                walk(c)

    walk(p)
    return "".join(out).replace("****", "")


def read_docx(data: bytes) -> str:
    """Markdown: headings by style, list items, tables, bold runs and links."""
    with _open(data) as package:
        names = package.namelist()
        root = _xml(package, "word/document.xml")
        relations = {r.get("Id"): r.get("Target") for r in _all(_xml(package, "word/_rels/document.xml.rels"), "Relationship")} if "word/_rels/document.xml.rels" in names else {}
        body = next(_all(root, "body"), None)
        if body is None:
            raise EngineError(READER_PARSE, "no body")
        out = []
        for x in body:
            if _local(x) == "tbl":
                rows = [[" ".join(_paragraph(p, relations) for p in _all(c, "p")).strip() for c in _all(r, "tc")] for r in _all(x, "tr")]
                if rows:
                    width = len(rows[0])
                    out.append("\n".join([table_row(rows[0], width), table_row(["---"] * width, width), *(table_row(r, width) for r in rows[1:])]))
            elif _local(x) == "p":
                text = _paragraph(x, relations).strip()
                style = next((v for s in _all(x, "pStyle") for k, v in s.attrib.items() if k.endswith("}val")), "")
                level = re.fullmatch(r"(?i)heading\s*([1-6])|title", style)
                if text and level:
                    out.append(f"{'#' * int(level[1] or 1)} {text.replace('**', '')}")
                elif text:
                    out.append(f"- {text}" if next(_all(x, "numPr"), None) is not None else text)
        return "\n\n".join(out)
