"""Splitting oversized texts at natural boundaries, with balanced targets.

A text over the limit gets the least number of pieces that leaves room for the overlap; equal-length targets are placed,
and each is moved to the strongest boundary near it (blank line, line end, sentence end, other whitespace), the nearest
among equals. A stretch that still exceeds the limit is split again with more pieces, so long as there is whitespace to
cut at; a run without any is cut between code points. Each piece but the first starts up to ``overlap`` characters early, at the start
of a word, as far as the limit leaves room.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\r\n"
GAP = re.compile(r"[ \t\r\n]+")
NAMES = ["none", "word", "sentence", "line", "paragraph"]  # by strength


def gaps(text: str) -> tuple[list[int], list[int], list[int]]:
    """(starts, ends, strengths) of the runs of whitespace inside a trimmed text."""
    starts, ends, strengths = [], [], []
    for m in GAP.finditer(text):
        s, e = m.span()
        lines = text.count("\n", s, e)
        starts.append(s)
        ends.append(e)
        strengths.append(4 if lines > 1 else 3 if lines else 2 if text[s - 1] in ".!?" else 1)
    return starts, ends, strengths


def sufficient(length: int, limit: int, starts: list[int], ends: list[int], strengths: list[int]) -> str:
    """The strongest kind of boundary that leaves no stretch over the limit when every one of it and stronger is cut."""
    for level in (4, 3, 2, 1):
        at = longest = 0
        for s, e, k in zip(starts, ends, strengths):
            if k >= level:
                longest, at = max(longest, s - at), e
        if max(longest, length - at) <= limit:
            return NAMES[level]
    return NAMES[0]


def cuts(length: int, limit: int, overlap: int, starts: list[int], ends: list[int], strengths: list[int]) -> list[tuple[int, int, int]]:
    """(end of a piece, start of the next, strength) between consecutive pieces of at most ``limit`` characters."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, length)]
    room = max(1, limit - overlap)
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit:
            continue
        n = max(2, -(-(hi - lo) // room))
        step = (hi - lo) / n
        near = max(1.0, min(step / 2, (limit - step) / 2))
        first, last = bisect_right(starts, lo), bisect_left(starts, hi)  # gaps strictly inside
        own: list[tuple[int, int, int]] = []
        for k in range(1, n):
            target = lo + k * step
            a = bisect_left(starts, target - near, first, last)
            b = bisect_right(starts, target + near, first, last)
            best = max(range(a, b), key=lambda g: (strengths[g], -abs(starts[g] - target)), default=None)
            if best is not None and (not own or starts[best] > own[-1][1]):
                own.append((starts[best], ends[best], strengths[best]))
        if not own and first < last:  # no boundary near any target: the nearest to the middle
            middle = (lo + hi) / 2
            g = min(bisect_left(starts, middle, first, last), last - 1)
            g = min((x for x in (g - 1, g) if x >= first), key=lambda x: abs(starts[x] - middle))
            own.append((starts[g], ends[g], strengths[g]))
        if not own:
            own = [(at, at, 0) for at in (lo + round(k * step) for k in range(1, n))]
        out.extend(own)
        edges = [lo, *(x for s, e, _ in own for x in (s, e)), hi]
        todo.extend(zip(edges[::2], edges[1::2]))
    return sorted(out)


def split_text(text: str | None, limit: int = 512, overlap: int = 64) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """(boundary, pieces) of one text; a piece is (content, start, characters shared with the one before, kind of cut
    before it). Positions count in the text as given. A text within the limit has one piece and no boundary; null,
    empty and blank texts have none."""
    whole = text or ""
    body = whole.strip(SPACE)
    if not body:
        return None, []
    shift = whole.index(body[0])
    if len(body) <= limit:
        return None, [(body, shift, 0, "start")]
    starts, ends, strengths = gaps(body)
    between = cuts(len(body), limit, overlap, starts, ends, strengths)
    pieces, begin, kind = [], 0, "start"
    for stop, after, strength in [*between, (len(body), len(body), 0)]:
        spare = min(overlap, limit - (stop - begin), begin)
        start = begin
        if pieces and spare > 0:
            gap = bisect_left(ends, begin - spare)  # the first word that starts within reach
            if gap < len(ends) and ends[gap] < begin:
                start = ends[gap]
            elif kind == "none":
                start = begin - spare
            if stop - start > limit:
                start = begin
        pieces.append((body[start:stop], start + shift, begin - start, kind))
        begin, kind = after, NAMES[strength]
    return sufficient(len(body), limit, starts, ends, strengths), pieces


def split_at_boundaries(texts: DataFrame, id_col: str, text_col: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """One row per piece: id, ``chunk_index`` (from 0), ``chunk_total``, ``content``, ``start_pos``, ``shared``
    (characters shared with the piece before), ``cut`` (kind of boundary before it), and ``boundary``: the strongest
    kind sufficient for the whole text, null where it needs no cut.

    Null, empty and blank texts give no row. Other columns are not read. Rows with the same id keep their own pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, total, piece, boundary = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                kind, pieces = split_text(text, limit, overlap)
                row.extend([i] * len(pieces))
                index.extend(range(len(pieces)))
                total.extend([len(pieces)] * len(pieces))
                piece.extend(pieces)
                boundary.extend([kind] * len(pieces))
            content, start, shared, cut = map(list, zip(*piece)) if piece else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(content, pa.string()), pa.array(start, pa.int64()), pa.array(shared, pa.int32()), pa.array(cut, pa.string()), pa.array(boundary, pa.string())],
                ["id", "chunk_index", "chunk_total", "content", "start_pos", "shared", "cut", "boundary"],
            )

    source = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
    out = source.mapInArrow(split, "id long, chunk_index int, chunk_total int, content string, start_pos long, shared int, cut string, boundary string")
    return out.withColumnRenamed("id", id_col)
