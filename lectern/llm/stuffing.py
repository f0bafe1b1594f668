"""Keyword-stuffed and link-list pages, by the shapes of their lines.

Every line is reduced to a shape: bands of its numbers of words, capitals, separators, links, sentence ends and numbers. A
page's lines are grouped by shape, and a group is judged as a whole: a sentence shape (marks that end sentences, few
separators) is never piled; of the others those are piled whose lines are mostly links, tags or coded products, repeat
the same units or words again and again, or begin again and again with the same words. A page is flagged when piled
groups hold more than half of its characters. Tables, lists of different things, contents, glossaries and code have
shapes that are no sentences either, but they do not repeat themselves.

A page is one row, so its groups need no exchange: the whole operator is one pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LINK = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+", re.I)
WORD = re.compile(r"[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*")
LINE = re.compile(r"[\n\r  ]")
END = re.compile(r"[.!?](?=[\s\"')\]]|$)")
UNIT = re.compile(r"[|,;/»•·>]|\s[-–]\s")
CODED = re.compile(r"\b[A-Za-z]{2,5}[- .:]?\d{3,}")  # letters and a number: a product's code
NUMBER = re.compile(r"(?<!\w)(?:[A-Z]?\d[\d.,]*|n/a|-|yes|no|ok)(?!\w)")
BULLET = re.compile(r"\s*(?:[-*•–]\s|\(?\w{1,3}[.)]\s|\d+(?:\.\d+)+\.?\s)")
SYNTAX = re.compile(r"""\s*(?:def\s|return\b|for\s.*:$|if\s.*:$|import\s|class\s|while\s|[{}\[\]]+,?\s*$|[{\[]?\s*"[^"]*"\s*:|\w+[.(]\w*.*\)$|\w+\s*=\s*[\w\[("'])""")
LEADER = re.compile(r"\.{4,}\s*\d*\s*$")
CELLS = re.compile(r"\s*\|.*\|\s*$|.*\t.*\t|.*\S {2,}\S+ {2,}\S|[^;]*(?:;[^;]*){2,}$")
SHORT = 7  # words of a line that may be a phrase


def _band(n: int) -> int:
    return n.bit_length()


class Group:
    """The lines of one shape: totals, and the words, units, first words and leading words seen."""

    __slots__ = ("lines", "chars", "links", "link_chars", "words", "seen", "units", "units_seen", "ends", "hashtags", "coded", "tokens", "frequent", "starts", "heads")

    def __init__(self):
        self.lines = self.chars = self.links = self.link_chars = self.words = self.units = self.ends = self.hashtags = self.coded = self.tokens = self.frequent = 0
        self.seen, self.units_seen, self.starts, self.heads = set(), set(), set(), set()


def shapes(text: str, frequent: frozenset[str]) -> dict[tuple, Group]:
    """The groups of a text's lines by shape. The first part of a shape names its outline: bullet, syntax, leader, cells,
    numbers, or none of them."""
    groups: dict[tuple, Group] = {}
    for line in LINE.split(text):
        solid = line.strip()
        if not solid:
            continue
        links = LINK.findall(line) if "http" in line or "www." in line or "](" in line or "<" in line or "HTTP" in line or "WWW." in line else ()
        bare = LINK.sub(" ", line) if links else line
        low = bare.lower()
        words, tokens = WORD.findall(low), bare.split()
        n = len(words)
        parts = UNIT.split(low)
        ends = len(END.findall(bare)) if "." in bare or "!" in bare or "?" in bare else 0
        digits = any(map(str.isdigit, bare))
        numbers = len(NUMBER.findall(bare)) if digits or " - " in bare or "n/a" in low else 0
        coded = len(CODED.findall(bare)) if digits else 0
        hashtags = sum(t[0] == "#" and t[1:2].isalpha() for t in tokens) if "#" in bare else 0
        capitals = sum(t[0].isupper() for t in tokens)
        outline = (
            "" if links or hashtags or coded > 1
            else "syntax" if len(parts) < 6 and SYNTAX.match(bare) else "leader" if "...." in bare and LEADER.search(bare)
            else "numbers" if max(len(tokens), len(parts)) > 1 and numbers >= 0.25 * max(len(tokens), len(parts))
            else "bullet" if BULLET.match(bare) else "cells" if ends <= 1 and n <= 30 and CELLS.match(bare) and len(parts) <= 5 else ""
        )
        short = n <= SHORT and not ends and len(parts) < 4 and not outline and not links and solid[-1] not in ":?"
        # a short phrase is told by what it repeats, so its few words and capitals are no part of its shape
        key = ("phrase",) if short else (outline, _band(n), round(4 * capitals / max(1, len(tokens))), _band(len(parts) - 1), _band(len(links)), _band(ends))
        g = groups.get(key)
        if g is None:
            g = groups[key] = Group()
        g.lines += 1
        g.chars += len(solid)
        g.links += len(links)
        g.link_chars += len(line) - len(bare) + len(links)
        g.words += n
        g.seen.update(words)
        g.units += len(parts)
        g.units_seen.update(p.strip() for p in parts)
        g.ends += ends
        g.hashtags += hashtags
        g.coded += coded
        g.tokens += len(tokens)
        g.frequent += sum(w in frequent for w in words)
        if short:
            g.starts.add(" ".join(low.split()[:2]))
            g.heads.add(next((w for w in words if w not in frequent), low))
    return groups


def piled(shape: tuple, g: Group) -> bool:
    """Whether the lines of a shape are piled-up links, tags or keywords."""
    words, lines = max(1, g.words), g.lines
    if g.links and (g.link_chars >= 0.4 * g.chars or (g.links >= 3 * lines and g.words <= 8 * g.links)):
        return True
    if g.hashtags >= 3 and g.hashtags >= 0.5 * g.tokens:
        return True
    if g.coded >= 2 * lines and g.words <= 6 * g.coded:
        return True
    if shape[0] == "phrase":
        return lines >= 5 and (len(g.starts) <= 0.5 * lines or len(g.heads) <= 0.34 * lines)
    if shape[0]:
        return False
    again = len(g.seen) / words
    if g.units >= 6 * lines and g.words <= 8 * g.units:  # a row of units
        few = len(g.units_seen) <= 0.85 * g.units or again <= 0.45
        return (few and g.words <= 4.5 * g.units) or (again <= 0.35 and g.ends <= g.units / 4)
    if g.ends >= 5 * lines and g.words <= 5 * g.ends:  # one or two words between full stops
        return True
    return g.words >= 20 * lines and g.ends <= g.words / 30 and again <= 0.62 and g.units - lines <= g.words / 8 and g.frequent <= 0.25 * g.words


def page_shares(text: str | None, frequent: frozenset[str]) -> tuple[int, int, int]:
    """(characters, characters in piled groups, piled groups) of a text; outer white space of lines does not count."""
    groups = shapes(text or "", frequent)
    own = [g.chars for shape, g in groups.items() if piled(shape, g)]
    return sum(g.chars for g in groups.values()), sum(own), len(own)


def stuffed_pages(pages: DataFrame, id_col: str, text_col: str, common: list[str], share: float = 0.5) -> DataFrame:
    """(id, ``piled_share``, ``shapes``) of the flagged pages, ``shapes`` being the number of piled groups. Null, empty and
    blank texts, and rows with a null id, are never flagged. Other columns are not read; rows that repeat an id are judged
    each for itself. ``common`` are function words of the languages expected (a short list)."""
    frequent = frozenset(w.lower() for w in common if w)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, held / chars, n) for i, text in enumerate(batch.column(1).to_pylist()) for chars, held, n in (page_shares(text, frequent),) if held > share * chars]
            rows, shares, counts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(shares, pa.float64()), pa.array(counts, pa.int64())], [id_col, "piled_share", "shapes"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, text_col).filter(pages[id_col].isNotNull()).mapInArrow(judge, f"`{id_col}` {kind}, piled_share double, shapes long")
