"""Chunking, normalisation, pages and readers."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.config import ChunkSettings
from lodestone.errors import EngineError
from lodestone.functions import text as X
from lodestone.functions import urls as U
from lodestone.operators import chunking, pdf_lines
from lodestone.operators.chunking import Cutter
from lodestone.sources import encoding, office, readers
from lodestone.sources.html import html_to_markdown


def squeeze(text):
    return "".join(text.split())


def test_short_text_is_one_chunk():
    assert Cutter().texts("One.\n\nTwo. Three!") == ["One.\n\nTwo. Three!"]
    assert Cutter().texts("") == Cutter().texts(None) == Cutter().texts(" \n ") == []


def test_punctuation_becomes_a_line_of_its_own():
    text = ("word " * 150 + "end.x") * 4
    got = Cutter().texts(text)
    assert len(got) > 1 and "\n.\n" in got[0] and squeeze("".join(got)) == squeeze(text)


@pytest.mark.parametrize("n", [900, 1500, 7900])
def test_whole_up_to_the_maximum(n):
    assert Cutter().texts("x" * n) == ["x" * n]


def test_slightly_over_the_maximum_repeats_its_tail():
    assert [len(c) for c in Cutter().texts("x" * 8500)] == [8000, 600]


@pytest.mark.parametrize("n", [9600, 20_001])
def test_far_over_the_maximum_is_cut(n):
    got = Cutter().texts("x" * n)
    assert max(map(len, got)) <= 8000 and sum(map(len, got)) == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["alpha ", "beta", ". ", "! ", "\n", "\n\n", "gamma,delta ", "中文", "。", "x" * 300]), max_size=60).map("".join))
def test_nothing_is_lost_below_the_maximum(text):
    assert squeeze("".join(Cutter(ChunkSettings(chunk_size=200)).texts(text))) == squeeze(chunking.normalise(text)) or len(text) > 8000


def test_fences_and_headings():
    body = "# Title\n" + "a " * 700 + "\n```\nx = 1\n\n\ny = 2\n```\n## Part\n" + "b " * 700
    got = Cutter().chunks(body)
    assert sum(c["text"].count("```") for c in got) == 2
    assert got[0]["heading_stack"][0] == "# Title"
    assert chunking.heading_stack("# A\n## B\n<h2>C  d</h2>\n### E\n# F") == ["# F"]
    assert chunking.heading_stack("# A\n### B\n## C") == ["# A", "## C"]


def test_custom_separator_and_sign():
    cutter = Cutter(ChunkSettings(custom_separator=r"\|\|"))
    assert cutter.texts("one||two||three") == ["one", "two", "three"]
    assert Cutter().texts(f"one{chunking.CUT_SIGN}two") == ["one", "two"]


def test_merging():
    assert chunking.merge_small(["a", "b" * 10, "c"], 5) == ["a\n" + "b" * 10 + "\nc"]
    assert chunking.merge_to_target(["a" * 6, "b" * 6, "c" * 6], 10, 100) == ["a" * 6 + "\n" + "b" * 6, "c" * 6]
    assert chunking.seamed(["a\n", "b"]) == "a\nb" and chunking.seamed(["", "b"]) == "b"
    assert chunking.sliding_window("z" * 100, 50)[-1] == "z" * 50


def test_levels():
    assert len(chunking.ladder(ChunkSettings())) == 12 and len(chunking.ladder(ChunkSettings(), ["a", "b"])) == 14 and len(chunking.ladder(ChunkSettings(heading_depth=9))) == 12


def test_settings():
    assert ChunkSettings(overlap_ratio=0.9).overlap_ratio == 0.5
    with pytest.raises(ValueError):
        ChunkSettings(chunk_size=0)


def test_tables():
    table = "|a|b|\n|---|---|\n" + "\n".join(f"|{i}|{'x' * 50}|" for i in range(60))
    parts = chunking.split_table(table, 500)
    assert len(parts) > 3 and all(p.startswith("|a|b|\n| --- | --- |\n") for p in parts) and sum(p.count("x" * 50) for p in parts) == 60
    assert chunking.split_table("no table") == ["no table"]


def test_format_text_is_shown_where_there_is_one():
    got = Cutter().chunks("a,b", "| a | b |")
    assert got[0]["text"] == "| a | b |" and Cutter().chunks("a,b", "| a | b |", False)[0]["text"] == "a,b"


def test_chunk_frame(spark):
    docs = spark.createDataFrame([(1, "t " * 3000, "f"), (2, None, "f"), (3, " ", "f")], "doc_id int, text string, chunk_index string")
    got = chunking.chunk_documents(docs)
    assert got.columns == ["doc_id", "chunk_index", "text", "heading_stack"] and {r.doc_id for r in got.collect()} == {1}


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_expressions(spark):
    assert one(spark, "a　 b \n", X.valid_length) == 2
    rough = "﻿中 文\r\na\r\n\n\n\nb\x07c "
    for text in (rough.lstrip("﻿"), "甲 乙 丙", "a\rb"):
        assert one(spark, text, X.normalise) == chunking.normalise(text)
    assert one(spark, "中,文", X.space_ideograph_punctuation) == "中, 文"
    assert one(spark, "a.b。c\n\nd", X.presplit) == ["a", ".", "b", "。", "c", "d"]
    assert one(spark, "x\n## T 1 \n# U", X.heading_title) == "T 1" and one(spark, "<H1 class='a'>a\n b</h1>", X.heading_title) == "a b" and one(spark, "none", X.heading_title) is None
    assert one(spark, "Ab_1 中文!", X.terms) == ["ab_1", "中", "文", "中文"]
    assert sorted(one(spark, "Ab ab 中文x 中", X.heuristic_tokens)) == ["ab", "中", "文"]
    assert one(spark, "![a](data:image/png;base64,AA==)![b](http://c)", X.strip_base64_images) == "![b](http://c)"
    assert one(spark, "|a|\n|-|\n|b|", X.is_markdown_table) and not one(spark, "|a|\n|-|\nb", X.is_markdown_table) and not one(spark, "|a|", X.is_markdown_table)


def test_pages(spark):
    pages = ["Header\n\nFirst line\ngoes on.\n- item\n1", "Header\nSecond\n\nPage 2", "Header\nThird\n- 3 -", ""]
    docs = spark.createDataFrame([(1, pages), (2, []), (3, None)], "doc_id int, pages array<string>")
    got = {r.doc_id: r.text for r in pdf_lines.document_text(docs).collect()}
    assert got[1] == "\nFirst line goes on.\n- item\n\nSecond\n\n\nThird\n" and got[2] == got[3] == ""


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h2>Hi <b>you</b></h2><p>a&amp;b</p>", "## Hi **you**\n\na&b"),
        ("<p>a <strong>b</strong> <em>c</em><i>gone</i></p>", "a **b** _c_"),
        ("<ul><li>x</li><li>y<ol><li>z</li></ol></li></ul>", "- x\n- y\n  1. z"),
        ('<a href="u">t\nx</a><script>no()</script><style>p{}</style>', "[t x](u)"),
        ('<video><source src="v.mp4"></video><audio></audio>', "[v.mp4](v.mp4)"),
        ('<img alt="a" src="data:image/png;base64,AAAA">', "![a]()"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("<pre><code>x\n y</code></pre>", "```\nx\n y\n```"),
        ("", ""),
        ("<p>open <b>bold", "open **bold**"),
    ],
)
def test_html(html, markdown):
    assert html_to_markdown(html) == markdown


def test_html_too_large():
    assert html_to_markdown("<p>" + "x" * 1_000_001) == "<p>" + "x" * 1_000_001 and html_to_markdown(None) == ""


def test_encodings():
    text = "héllo 中文"
    for name in ("utf-8", "utf-8-sig", "utf-16", "gb18030"):
        data = text.encode(name)
        assert encoding.decode(data) == text
    assert encoding.decode(b"\xff\xfa\x81", "ascii") and encoding.decode("é".encode(), "ascii") == "é"
    assert encoding.decode("é".encode("latin-1"), "latin1") == "é" and encoding.decode(b"abc", "no-such") == "abc" and encoding.decode(b"") == ""



def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


XLSX = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="A" r:id="r1"/><sheet name="B" state="hidden" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>",
    "xl/worksheets/s1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"/></row><row><c r="A3"><v>7</v></c><c r="C3" t="inlineStr"><is><t>x\ny</t></is></c></row></sheetData></worksheet>',
    "xl/worksheets/s2.xml": '<worksheet><sheetData><row><c r="A1" t="b"><v>1</v></c></row></sheetData></worksheet>',
}


def test_xlsx():
    text, shown = office.read_xlsx(zipped(XLSX))
    assert text == "id,name,\n7,,x\ny\nTrue"
    assert shown == "| id | name |  |\n|---|---|---|\n| 7 |  | x\\ny |"


def test_pptx_and_docx():
    p = lambda *t: "<a:p xmlns:a='a'>" + "".join(f"<a:r><a:t>{x}</a:t></a:r>" for x in t) + "</a:p>"
    deck = zipped({"ppt/slides/slide10.xml": f"<s>{p('ten')}</s>", "ppt/slides/slide2.xml": f"<s>{p('two', '!')}{p()}</s>", "ppt/notesSlides/notesSlide2.xml": f"<s>{p('note')}</s>"})
    assert office.read_pptx(deck) == "note\ntwo!\nten"
    w = "xmlns:w='w' xmlns:r='r'"
    doc = f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert office.read_docx(zipped({"word/document.xml": doc})) == "## Head\n\n**bold** text\n\n| a |\n| --- |"
    for bad in (b"nozip", zipped({"x": ""}), zipped({"ppt/slides/s1.xml": "<broken"})):
        with pytest.raises(EngineError) as e:
            office.read_pptx(bad)
        assert e.value.code == errors.READER_PARSE


def test_csv():
    assert office.csv_table('a,b\n\n"x\ny",2,3\nz\n') == "| a | b |\n| --- | --- |\n| x\\ny | 2 |\n| z |  |" and office.csv_table("") is None and office.csv_table("a,b") == "| a | b |\n| --- | --- |"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "__pycache__").mkdir()
    for name, body in {"a.txt": b"plain", "sub/b.HTML": b"<h1>T</h1>", "sub/c.xlsx": b"bad", ".hidden.txt": b"no", "__pycache__/x.txt": b"no", "d.json": b"{}", "noext": b"x"}.items():
        (tmp_path / name).write_bytes(body)
    files, warnings = readers.list_files(spark, [str(tmp_path), str(tmp_path / "missing")])
    got = {r.filename: r for r in readers.read_files(files.filter("eligible")).collect()}
    assert len(warnings) == 1 and set(got) <= {"a.txt", "b.HTML", "c.xlsx", "d.json", "noext"}
    assert got["a.txt"].text == "plain" and got["b.HTML"].text == "# T" and got["b.HTML"].mime == "text/html"
    assert got["c.xlsx"].error.code == errors.READER_PARSE and got["d.json"].error.code == got["noext"].error.code == errors.READER_UNSUPPORTED
    empty, warnings = readers.list_files(spark, ["/no/such"])
    assert empty.count() == 0 and warnings


def test_url_formats(spark):
    rows = [("http://a/x.php", "text/html; charset=x", None, "html"), ("http://a/x", None, "%PDF-1", "pdf"), ("http://a/x", "image/png", " <?xml?><html>", "html"), ("http://u@a:8/p/y.CSV?q=1.txt", None, "z", "csv"), ("http://a/x.exe", None, "", "txt"), ("http://a.md", None, None, "txt")]
    df = spark.createDataFrame(rows, "url string, ct string, body string, want string")
    for r in df.select("want", U.infer_format(F.col("url"), F.col("ct"), F.col("body")).alias("got"), U.filename_of(F.col("url")).alias("name"), "url").collect():
        assert r.got == r.want
    assert df.filter("url like '%CSV%'").select(U.filename_of(F.col("url"))).first()[0] == "u@a:8/p/y.CSV"
    assert df.select(U.image_extension(F.lit("IMAGE/PNG")), U.image_extension(F.lit("x/y"))).first()[:] == ("png", "bin")


def test_pdf_seam_and_single_files(spark, tmp_path):
    from lodestone.sources import pdf_text

    pages = ["Header\n\nFirst line\ngoes on.\n- item\n1", "Header\nSecond\n\nPage 2", "Header\nThird\n- 3 -", ""]
    docs = spark.createDataFrame([(1, pages)], "doc_id int, pages array<string>")
    assert pdf_text.clean_pages(pages) == pdf_lines.document_text(docs).first().text
    table = dict(readers.READERS)
    try:
        with pytest.raises(EngineError):
            readers.read_bytes(b"%PDF", "pdf")
        readers.register_pdf(lambda data: ["ﬁne text", "more"], nfkc=True)
        assert readers.read_bytes(b"%PDF", ".PDF") == ("fine text\n\nmore\n", None, "application/pdf", 2)
    finally:
        readers.READERS.update(table)
    (tmp_path / "a.md").write_text("# A")
    assert readers.read_file(str(tmp_path / "a.md"))["text"] == "# A"
    with pytest.raises(EngineError) as e:
        readers.read_file(str(tmp_path / "none.txt"))
    assert e.value.code == errors.READER_NOT_FOUND


def test_fetching(spark):
    def fetcher(url):
        if url == "bad":
            raise OSError("no route")
        return "text/html", b"<h1>x</h1>" * (1 if url == "good" else 100)

    got = {r.url: r for r in readers.fetch_pages(spark.createDataFrame([("good",), ("bad",), ("big",)], "url string"), fetcher, most=100).collect()}
    assert got["good"].body and got["bad"].error.code == errors.READER_PARSE and got["big"].error.code == errors.READER_TOO_LARGE
