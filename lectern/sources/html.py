"""HTML pages as titled sections of text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.sources import markdown

SECTION = "array<struct<page:int,total_pages:int,section_title:string,text:string>>"
#: Subtrees without content, and tags that never hold any.
NOISE = {"script", "style", "nav", "footer", "head", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer", "keygen", "menuitem"}


class Node:
    """An element, with child elements, strings and notes (comments and declarations) in order."""

    __slots__ = ("tag", "children", "parent")

    def __init__(self, tag: str, parent: Node | None = None):
        self.tag, self.parent, self.children = tag, parent, []

    def walk(self):
        """All elements below, in document order."""
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def strings(self):
        for child in self.children:
            if isinstance(child, Node):
                yield from child.strings()
            elif isinstance(child, str):
                yield child

    def text(self, joint: str) -> str:
        return joint.join(s for s in (x.strip() for x in self.strings()) if s)


class Note:
    """A comment or declaration: no text of its element, but text where it stands directly in the body."""

    def __init__(self, content: str):
        self.content = content


class TreeBuilder(HTMLParser):
    """A lenient tree: an end tag closes the nearest open element of its name and all inside; without one it is void."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.ended = False  # an end tag ends a string, also one that closes nothing

    def handle_starttag(self, tag, attrs):
        node = Node(tag, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, self.at))

    def handle_endtag(self, tag):
        self.ended = True
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], str) and not self.ended:
            self.at.children[-1] += data
        else:
            self.at.children.append(data)
        self.ended = False

    def handle_comment(self, data):
        self.at.children.append(Note(data))

    def handle_decl(self, decl):
        self.at.children.append(Note(re.sub(r"(?i)^doctype\s+", "", decl)))

    def unknown_decl(self, data):
        self.at.children.append(Note(data))

    def handle_pi(self, data):
        self.at.children.append(Note(data))


def table_markdown(table: Node) -> str:
    """``markdown.table`` of the header and data cells of all rows."""
    rows = [x for x in table.walk() if x.tag == "tr"]
    return markdown.table([[c.text(" ").replace("|", "\\|") for c in row.walk() if c.tag in ("th", "td")] for row in rows])


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", text)).strip()


def _swap(node: Node, wanted, made) -> None:
    """Replace the elements ``wanted`` below ``node``, outermost first, by ``made`` of each (None: remove)."""
    kept = []
    for child in node.children:
        if isinstance(child, Node) and wanted(child):
            new = made(child)
            if new is not None:
                kept.append(new)
            continue
        if isinstance(child, Node):
            _swap(child, wanted, made)
        kept.append(child)
    node.children = kept


def sections(html: str | None, stem: str) -> list[tuple[int, int, str, str]]:
    """(page, total_pages, section_title, text) of a page: a new section begins at each h1 or h2 that is a direct child
    of the body. Sections without text are left out and take no page number. Null and empty pages have none."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    root = builder.root
    _swap(root, lambda n: n.tag in NOISE, lambda n: None)
    _swap(root, lambda n: n.tag == "table", lambda n: f"\n\n{table_markdown(n)}\n\n")
    body = next((n for n in root.walk() if n.tag == "body"), root)
    total = max(1, sum(n.tag in ("h1", "h2") for n in root.walk()))
    # what stands before the first heading belongs to the file's name; each heading opens a section of its own
    parts: list[tuple[str, list[str]]] = [(stem, [])]
    for child in body.children:
        if isinstance(child, Node) and child.tag in ("h1", "h2"):
            parts.append((child.text(" "), []))
        else:
            parts[-1][1].append(child.text("\n") if isinstance(child, Node) else (child.content if isinstance(child, Note) else child).strip())
    found = [(title, tidy("\n".join(filter(None, pieces)))) for title, pieces in parts]
    return [(k, total, title, text) for k, (title, text) in enumerate((f for f in found if f[1]), 1)]


def html_sections(html: Column, stem: Column) -> Column:
    """``sections`` of a column of pages, as an array to explode."""

    @F.pandas_udf(SECTION)
    def parse(pages, stems):
        import pandas as pd

        keys = ("page", "total_pages", "section_title", "text")
        return pd.Series([[dict(zip(keys, s)) for s in sections(h, t or "")] for h, t in zip(pages, stems)])

    return parse(html, stem)
