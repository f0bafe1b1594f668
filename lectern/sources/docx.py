"""Word files as pages of paragraphs and tables, from the XML inside."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from lectern.sources import markdown

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraph_text(p: ElementTree.Element) -> str:
    """Text of the runs of a paragraph, with tabs and breaks; text inside links counts, deleted text does not."""
    out = []
    for node in p.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag == f"{W}tab":
            out.append("\t")
        elif node.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
        elif node.tag == f"{W}noBreakHyphen":
            out.append("-")
    return "".join(out)


def table_rows(table: ElementTree.Element) -> list[list[str]]:
    """Cell texts by row; a merged cell repeats in every place it covers."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{W}tr"):
        cells: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            setting = tc.find(f"{W}tcPr")
            span = setting.find(f"{W}gridSpan") if setting is not None else None
            merge = setting.find(f"{W}vMerge") if setting is not None else None
            text = "\n".join(paragraph_text(p) for p in tc.findall(f"{W}p"))
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and rows and len(rows[-1]) > len(cells):
                text = rows[-1][len(cells)]
            cells += [text] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
        rows.append(cells)
    return rows


def table_markdown(rows: list[list[str]]) -> str:
    """``markdown.table`` of cells on one line each; rows of blank cells count as empty."""
    plain = [[c.strip().replace("|", "\\|").replace("\n", " ") for c in row] for row in rows]
    return markdown.table([row if any(row) else [] for row in plain])


def blocks(content: bytes) -> list[str]:
    """Paragraphs and tables of the body in order, without empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    out = []
    for child in body if body is not None else []:
        text = paragraph_text(child).strip() if child.tag == f"{W}p" else table_markdown(table_rows(child)) if child.tag == f"{W}tbl" else ""
        if text:
            out.append(text)
    return out


def pages(content: bytes, page_chars: int = 3000) -> list[tuple[int, int, str]]:
    """(page, total_pages, text): blocks in order, a new page where the next one would exceed ``page_chars``."""
    groups: list[list[str]] = []
    size = 0
    for block in blocks(content):
        if not groups or size + len(block) > page_chars:
            groups.append([])
            size = 0
        groups[-1].append(block)
        size += len(block)
    return [(i + 1, len(groups), "\n\n".join(g)) for i, g in enumerate(groups)]
