import io
import zipfile
import zlib

import pytest

from lectern.sources import docx, files, html, json_docs, pdf

PAGE = """<!DOCTYPE html><html><head><title>t</title></head><body>before<!-- ad 7 -->
<h1>First <b>title</b></h1><p>one<i>two  spaced</i></p><nav>menu</nav><div><h2>inner</h2>deep</div>
<h2>Empty</h2><script>x()</script>
<h2>Tables</h2><table><tr><th>a|b</th><th>c</th></tr><tr><td>1<br>x</td><td></td></tr><tr></tr></table>
after &amp; end</body></html>"""


def test_html_sections():
    assert html.sections(PAGE, "stem") == [
        (1, 4, "stem", "before\nad 7"),
        (2, 4, "First title", "one\ntwo spaced\ninner\ndeep"),
        (3, 4, "Tables", "| a\\|b | c |\n| --- | --- |\n| 1 x | |\nafter & end"),
    ]


def test_html_without_body_or_text():
    assert html.sections("plain <b>bold</b>", "s") == [(1, 1, "s", "plain\nbold")]
    assert html.sections(None, "s") == html.sections("", "s") == html.sections("<style>x</style>", "s") == []
    assert html.sections("<p>a</div></b>c", "s") == [(1, 1, "s", "a\nc")]


def test_json_shapes():
    nested = '{"id": 1, "a": " x ", "b": {"c": 2, "url": "u", "d": [" y ", 3, {"e": 4.5}, true, null]}, "t": true, "n": null, "z": "", "w": "  ", "l": ["", " "], "last": 0}'
    assert json_docs.documents(nested) == [(1, 1, "a: x\nb.c: 2\nb.d: y\nb.d.e: 4.5\nz: \nw:   \nlast: 0")]
    assert json_docs.documents('[" a ", {"k": "v"}, 5, null, [1], {"id": 1}]') == [(1, 6, "a"), (2, 6, "k: v")]
    assert json_docs.documents("true") == [(1, 1, "True")] and json_docs.documents("null") == [(1, 1, "None")] and json_docs.documents("[]") == []
    with pytest.raises(ValueError):
        json_docs.documents("{broken")


def word_file(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def row(*cells: str) -> str:
    return "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"


def test_word_paragraphs_tables_and_pages():
    body = p(" first ") + p("") + f"<w:tbl>{row('a', 'b|c')}{row('', '')}{row('1', '2')}</w:tbl>" + p("x" * 2990) + p("last")
    found = docx.pages(word_file(body))
    assert found[0] == (1, 2, "first\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |") and found[1][2] == "x" * 2990 + "\n\nlast"
    assert docx.pages(word_file(f"<w:tbl>{row('', '')}{row('1', '2')}</w:tbl>")) == [(1, 1, "| 1 | 2 |")]
    merged = '<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + p("m") + "</w:tc></w:tr>"
    assert docx.pages(word_file(f"<w:tbl>{merged}</w:tbl>"))[0][2] == "| m | m |\n| --- | --- |"
    assert docx.pages(word_file("")) == []


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<body><h1>T</h1>hello</body>")
    (tmp_path / "F.HTML").write_text("<p>upper</p>")
    (tmp_path / "sub" / ".hidden.json").write_text('{"k": "hidden"}')
    (tmp_path / "sub" / "b.json").write_text('[{"k": "v"}, "s"]')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "w.docx").write_bytes(word_file(p("word text")))
    (tmp_path / "x.csv").write_text("no")
    (tmp_path / "d.part").write_text("no")
    (tmp_path / "scan.png").write_bytes(b"no image")
    return tmp_path


def test_load_a_folder(spark, folder):
    rows = files.load(spark, str(folder)).collect()
    good = {(r["source"], r["page"]): r["page_content"] for r in rows if r["error"] is None}
    assert good == {("a.html", 1): "hello", ("F.HTML", 1): "upper", (".hidden.json", 1): "k: hidden", ("b.json", 1): "k: v", ("b.json", 2): "s", ("w.docx", 1): "word text"}
    assert {r["source"] for r in rows if r["error"]} == {"bad.json", "scan.png"}
    assert {r["section_title"] for r in rows if r["source"] == "F.HTML"} == {"F"}


def test_load_one_file_and_what_is_refused(spark, folder, tmp_path):
    assert files.load(spark, str(folder / "a.html")).head()["section_title"] == "T"
    with pytest.raises(ValueError, match="unsupported"):
        files.load(spark, str(folder / "x.csv"))
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(folder / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path / "empty"))
    with pytest.raises(Exception, match="bad.json"):
        files.load(spark, str(folder / "bad.json"), strict=True).collect()


def test_replaceable_parsers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    parsers = files.Parsers(pdf=lambda content: [(1, 3, "one"), (3, 3, "three")])
    rows = files.load(spark, str(tmp_path), parsers).orderBy("page").collect()
    assert [(r["page"], r["total_pages"], r["page_content"], r["file_type"]) for r in rows] == [(1, 3, "one", "pdf"), (3, 3, "three", "pdf")]


def pdf_file(*pages: bytes, packed: bool = False, fonts: bytes = b"/F1 90 0 R", more: bytes = b"") -> bytes:
    """A file with a page for each row of commands."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))
    out = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [" + kids + b"] /Resources << /Font << " + fonts + b" >> >> >> endobj\n"
    for k, commands in enumerate(pages):
        data = zlib.compress(commands) if packed else commands
        out += b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (10 + 2 * k, 11 + 2 * k)
        out += b"%d 0 obj << /Length %d %s>> stream\n" % (11 + 2 * k, len(data), b"/Filter /FlateDecode " if packed else b"") + data + b"\nendstream endobj\n"
    return out + b"90 0 obj << /Type /Font /Subtype /Type1 >> endobj\n" + more + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pages_of_a_pdf(packed):
    first = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) w\\366rld) Tj 0 -14 Td [(sec) 20 (ond) -400 (line)] TJ T* (third) Tj ET"
    third = b"BT /F1 9 Tf 1 0 0 1 72 700 Tm <4142> Tj 1 0 0 1 90 700 Tm (C) Tj 1 0 0 1 72 680 Tm (D) Tj (E) ' ET"
    assert pdf.pages(pdf_file(first, b"0 0 10 10 re f", third, packed=packed)) == [(1, 3, "Hello (big) w\u00f6rld\nsecond line\nthird"), (3, 3, "ABC\nD\nE")]


def test_fonts_with_a_map_and_what_no_pdf_is():
    cmap = b"1 beginbfchar <0003> <0020> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    more = b"91 0 obj << /Type /Font /ToUnicode 92 0 R >> endobj 92 0 obj << >> stream\n" + cmap + b"\nendstream endobj\n"
    assert pdf.pages(pdf_file(b"BT /F2 9 Tf <001000110003 0012> Tj ET", fonts=b"/F1 90 0 R /F2 91 0 R", more=more)) == [(1, 1, "ab c")]
    for bad in (b"", b"no pdf", b"%PDF-1.4 nothing", pdf_file(b"BT ET") + b"/Encrypt 5 0 R"):
        with pytest.raises(ValueError):
            pdf.pages(bad)
    assert files.pdf_pages(pdf_file(b"BT (x) Tj ET")) == [(1, 1, "x")]
