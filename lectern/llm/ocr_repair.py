"""Repairing text from scanned pages into continuous readable paragraphs.

* Running headers and page numbers: digits of every line are masked and letters reduced to glyph skeletons; a short line
  whose mask recurs over many pages is a running header, a line of nothing but a number is a page number.
* Words broken over two lines: the mark goes unless the corpus knows the word better with it.
* Misread characters: words are grouped by their confusable-glyph skeleton (``rn`` and ``m``, ``1`` and ``l`` share one);
  in each group the form that the corpus supports is chosen for every place: a form that only scans have, or nearly so, by
  frequency; any form, one that is a word itself too, by how often each form stands after the word before it and before
  the word after it.
* The lines left are reflowed with windows: a paragraph ends at a blank line, a heading or a short line that ends a sentence.

Counts are over all pages. Words and masks are counted, grouped and joined as distributed tables; nothing of the corpus's
vocabulary goes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shingles import BROADCAST_ROWS
from lectern.session import stage

MARKS = "-‐‑¬­"
TOKEN = r"(?U)[\p{L}\p{N}@|]+"
#: Glyphs that scanners take for each other (fixed values).
SINGLES, SINGLES_TO = "01|!l59@$ſ8ethy", "oiiiisgassbcfbv"
PAIRS_LAST = (("ci", "d"), ("ri", "n"), ("rn", "m"), ("ii", "u"), ("vv", "w"))
PAIRS_FIRST = (("ii", "u"), ("vv", "w"), ("cl", "d"), ("ri", "n"), ("rn", "m"))
BLANK = r"(?U)^\s*$"
HEADING = r"(?U)^\s*\p{N}+(?:\.\p{N}+)+\.?\s+\S"
NUMBER_LINE = re.compile(r"[\W_]*(?:(?:p(?:a[g9]e?|g)?|pagina|página|pág|seite|blatt|s)\b\.?)?[\W_]*[\dilo|]*\d[\dilo|]*(?:\s*(?:of|/|de|von|sur|out of)\s*[\dilo|]*\d[\dilo|]*)?[\W_]*$", re.I)
WORDS = re.compile(r"(?:[^\W_]|[@|])+")
WHOLE = re.compile(r"(?:[^\W_]|[@|])+(?:[-‐](?:[^\W_]|[@|])+)+")
CLOSED = re.compile(r"[.!?:;][\"')\]]*$")
CELLS = re.compile(r"\||\t|\S {3,}\S|;\S")
GOES_ON = re.compile(r"(?:[^\W\d_]|[,\-‐‑¬­])$")
LINES = "id long, line_no int, line string, scan boolean, tokens array<string>, wholes array<string>, number boolean, beside boolean, edge boolean"


def skeleton(word: Column, pairs_first: bool = False) -> Column:
    """What is left of a word when glyphs that are taken for each other are made one.

    Pairs of glyphs (``rn`` for ``m``) are replaced after single ones, or before them: ``pliis`` is ``plus`` only in the
    second way, ``overriight`` is ``overnight`` only in the first.
    """
    s = F.lower(word)
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        s = F.replace(s, F.lit(a), F.lit(b))
    if not pairs_first:
        s = F.translate(s, SINGLES, SINGLES_TO)
    for a, b in PAIRS_FIRST if pairs_first else PAIRS_LAST:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, SINGLES, SINGLES_TO) if pairs_first else s


def wrapped(lines: list[str]) -> bool:
    """Whether a page's lines are wrapped like those of a scan: many go on in the next line with a small letter, within a
    steady width."""
    if any(len(x) > 100 for x in lines):
        return False
    if sum(25 <= len(x) <= 100 and x.count(" ") > 1 and not CLOSED.search(x) and not CELLS.search(x) for x in lines) < 3:
        return False
    on = sum(bool(GOES_ON.search(a)) and b[:1].islower() for a, b in zip(lines, lines[1:]))
    return on >= 2 and on >= 0.25 * len(lines)


def page_lines(pages: DataFrame, id_col: str, text_col: str, scanned: Column | None) -> DataFrame:
    """``LINES`` of all pages in one pass. A page is a scan if the column ``scanned`` says so, or if its lines are
    ``wrapped``. Of scans it is told whether a line is a page number, stands ``beside`` one, and stands at the page's
    ``edge`` (the three first and last lines that are not blank). ``wholes`` are words with inner hyphens."""
    flag = F.coalesce(scanned, F.lit(False)) if scanned is not None else F.lit(False)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), flag.alias("told")).filter("id is not null and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, text, told in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines = text.split("\n")
                plain = [x.rstrip() for x in lines]
                scan = told or wrapped(plain)
                numbers = [scan and any(map(str.isdigit, x)) and bool(NUMBER_LINE.match(x)) for x in plain]
                filled = [k for k, x in enumerate(plain) if x.strip()] if scan else []
                edges = {*filled[:3], *filled[-3:]}
                for k, line in enumerate(lines):
                    low = line.lower()
                    wholes = [w.replace("‐", "-") for w in WHOLE.findall(low)] if "-" in low or "‐" in low else []
                    beside = (k > 0 and numbers[k - 1]) or (k + 1 < len(lines) and numbers[k + 1])
                    out.append((page, k, line.replace("\r", ""), scan, WORDS.findall(low), wholes, numbers[k], beside, k in edges))
            columns = list(zip(*out)) if out else [()] * 9
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in LINES.split(", ")])

    return rows.mapInArrow(cut, LINES)


def mask(line: Column) -> Column:
    """A line without its digits, punctuation and outer words for pages, as a skeleton."""
    words = F.regexp_replace(F.lower(line), r"(?iU)\b(?:page|pa9e|seite|página|p|s)\b\.?(?=\s*[\p{N}])", " ")
    words = F.regexp_replace(words, r"(?U)(?<![\p{L}@|])[\p{N}|]+(?![\p{L}@|])", " ")
    words = F.regexp_replace(words, r"(?U)\b(?:of|de|von|sur)\b\s*(?=[\p{P}\s]*$)", " ")
    return F.trim(F.regexp_replace(skeleton(F.regexp_replace(words, r"(?U)[^\p{L}\p{N}@|]+", " ")), " +", " "))


def classified_lines(lines: DataFrame, least_pages: int = 3, at_edge: float = 0.6) -> DataFrame:
    """Lines of scans with ``kind``: blank, pageno, header, heading or text.

    A title recurs on ``least_pages`` pages; whatever the size of the corpus, at least ``at_edge`` of its places are at the
    edge of a page or beside its number, and it hardly ever starts with a small letter, as a line of running text does
    about as often as not."""
    bare = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    words = F.regexp_count(bare, F.lit(r"(?U)\p{L}{2,}"))
    may_head = (F.length(bare) <= 70) & ~F.col("number") & ~bare.rlike(r"[.!?,;]$|[-‐‑¬­]$") & (words >= 1) & (words <= 9) & ~F.col("line").rlike(HEADING)
    rows = lines.filter("scan").select("id", "line_no", "line", "tokens", "number", "beside", "edge", F.when(may_head, mask(bare)).alias("mask"))
    rows = stage(rows, "scan-lines")
    count = lambda c: F.count(F.when(c, 1))
    masks = rows.filter("mask <> ''").groupBy("mask", "id").agg(F.count("*").alias("n"), count(F.col("line").rlike(r"(?U)^\s*\p{Ll}")).alias("small"), count(F.col("edge") | F.col("beside")).alias("outer"))
    masks = masks.groupBy("mask").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("n", "small", "outer")])
    titles = masks.filter((F.col("pages") >= least_pages) & (F.col("small") <= 0.2 * F.col("n")) & (F.col("outer") >= at_edge * F.col("n"))).select("mask", F.lit(True).alias("title"))
    rows = rows.join(titles, "mask", "left")
    holds_number = F.col("line").rlike(r"(?U)(?:^|\s)\p{N}{1,3}\s*$|^\s*\p{N}{1,3}\s")
    upper = F.col("line").rlike(r"(?U)^\P{Ll}*$")
    kind = (
        F.when(F.col("line").rlike(BLANK), "blank")
        .when(F.col("number"), "pageno")
        .when(F.coalesce("title", F.lit(False)) & (F.col("edge") | F.col("beside") | holds_number | upper | (F.length("line") <= 40)), "header")
        .when(F.col("line").rlike(HEADING) & (words <= 8), "heading")
        .otherwise("text")
    )
    return rows.select("id", "line_no", "line", "tokens", kind.alias("kind"))


def word_counts(lines: DataFrame) -> DataFrame:
    """(``word``, ``scan_n``, ``clean_n``) over all lines, in lower case; words with inner hyphens count as wholes too. Words
    are counted in each Arrow batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan in (True, False):
                own = batch.filter(batch.column(0) if scan else pc.invert(batch.column(0)))
                found = pc.value_counts(pa.concat_arrays([own.column(1).flatten(), own.column(2).flatten()]))
                n, none = found.field("counts"), pa.array([0] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([found.field("values"), n if scan else none, none if scan else n], ["word", "scan_n", "clean_n"])

    counted = lines.select("scan", "tokens", "wholes").mapInArrow(count, "word string, scan_n long, clean_n long")
    return counted.groupBy("word").agg(F.sum("scan_n").alias("scan_n"), F.sum("clean_n").alias("clean_n"))


def broken_words(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(``id``, ``line_no``, ``next_no``, ``head``, ``tail``, ``drop``): lines of running text that break a word, and
    whether its mark must go."""
    order = Window.partitionBy("id").orderBy("line_no")
    text = rows.filter("kind = 'text'")
    text = text.select("id", "line_no", "line", F.lead("line").over(order).alias("next"), F.lead("line_no").over(order).alias("next_no"))
    head = F.lower(F.regexp_extract("line", rf"(?U)((?:[\p{{L}}\p{{N}}@|]+-)*[\p{{L}}\p{{N}}@|]+)([{MARKS}])\s*$", 1))
    tail = F.lower(F.regexp_extract("next", r"(?U)^\s*([\p{L}\p{N}@|]+(?:-[\p{L}\p{N}@|]+)*)", 1))
    small = F.col("next").rlike(r"(?U)^\s*[\p{Ll}\p{N}@|]")
    soft = F.col("line").rlike(r"[­¬]\s*$")
    text = text.select("id", "line_no", "next_no", head.alias("head"), tail.alias("tail"), small.alias("small"), soft.alias("soft")).filter("head <> '' and tail <> ''")
    tail_first = F.regexp_extract("tail", r"^[^-]+", 0)
    head_last = F.regexp_extract("head", r"[^-]+$", 0)
    text = text.withColumns({"joined": F.concat(head_last, tail_first), "kept": F.concat("head", F.lit("-"), "tail"), "short": F.concat(head_last, F.lit("-"), tail_first)})
    n = vocabulary.select("word", (F.col("scan_n") + F.col("clean_n")).alias("n"))
    for name in ("joined", "kept", "short"):
        text = text.join(n.withColumnsRenamed({"word": name, "n": f"{name}_n"}), name, "left")
    keep = F.greatest(F.coalesce("kept_n", F.lit(0)), F.coalesce("short_n", F.lit(0)))
    drop = F.col("soft") | (F.coalesce("joined_n", F.lit(0)) > keep) | ((keep == 0) & F.col("small"))
    return text.select("id", "line_no", "next_no", "head", "tail", drop.alias("drop"))


def repairs(vocabulary: DataFrame, least: int = 3, ratio: float = 8.0) -> DataFrame:
    """(``word``, ``better``): misread forms and the supported form of their skeleton group."""
    plain = F.col("word").rlike(r"(?U)^[\p{L}&&[^ﬀ-ﬆ]]+$")
    words = vocabulary.filter(~F.col("word").contains("-") & F.col("word").rlike(r"(?U)\p{L}") & (F.length("word") >= 2))
    words = words.withColumns({"n": F.col("scan_n") + F.col("clean_n"), "plain": plain})
    words = words.withColumn("skeleton", F.explode(F.array_distinct(F.array(skeleton(F.col("word")), skeleton(F.col("word"), True)))))
    # of each group: its most frequent form of letters alone; a form seen on pages that are no scans counts more
    support = F.when(F.col("plain"), F.col("n") + 3 * F.col("clean_n"))
    best = words.groupBy("skeleton").agg(F.max(F.struct(support.alias("support"), "n", "clean_n", "word")).alias("best"), F.count("*").alias("forms"))
    best = best.filter(f"forms > 1 and best.support is not null and best.n >= {least}").drop("forms")
    rows = words.join(best, "skeleton").filter("best.word <> word")
    odd = ~F.col("plain") & F.col("word").rlike(r"(?U)^(?=.*\p{L}).*[0-9@|ﬀ-ﬆ]") & ~F.col("word").rlike(r"(?U)^\p{L}?\p{N}+$")
    # a word that only scans have, or next to no other page beside its group's form, beside one that other pages have too
    better_known = (F.col("best.clean_n") >= 5) & (F.col("best.clean_n") >= F.col("scan_n"))
    rare = ((F.col("clean_n") < 2) | (F.col("best.clean_n") >= 5000 * F.col("clean_n"))) & ((F.col("best.n") >= ratio * F.col("scan_n")) | better_known)
    rows = rows.filter(odd & (F.col("best.n") > F.col("n")) | (F.col("plain") & rare))
    return rows.groupBy("word").agg(F.max("best").alias("best")).select("word", F.col("best.word").alias("better"))


def rivals(vocabulary: DataFrame, least: int = 3) -> DataFrame:
    """(``word``, ``form``): words of letters alone that scans have, each with every supported form of its skeleton groups."""
    words = vocabulary.filter(F.col("word").rlike(r"(?U)^[\p{L}&&[^ﬀ-ﬆ]]{2,}$"))
    words = words.withColumn("skeleton", F.explode(F.array_distinct(F.array(skeleton(F.col("word")), skeleton(F.col("word"), True)))))
    forms = words.filter(F.col("scan_n") + F.col("clean_n") >= least).select("skeleton", F.col("word").alias("form"))
    return words.filter("scan_n > 0").join(forms, "skeleton").filter("word <> form").select("word", "form").distinct()


def _told(rows: DataFrame) -> DataFrame:
    """A written table, told to all tasks if it is small enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _in_context(tokens: Column, left: Column, right: Column) -> Column:
    """Structs of each token with the words before and after it."""
    around = F.concat(F.array(left), tokens, F.array(right))
    return F.arrays_zip(F.slice(around, 1, F.size(tokens)).alias("before"), tokens.alias("word"), F.slice(around, 3, F.size(tokens)).alias("after"))


def running_words(rows: DataFrame, broken: DataFrame) -> DataFrame:
    """(``id``, ``line_no``, ``place``, ``before``, ``word``, ``after``) of whole words of running text: parts of broken
    words are left out, but are joined as neighbours. ``place`` counts the line's words from 0; a page's first word has an
    empty ``before`` and its last an empty ``after``."""
    joined = F.when(F.col("drop"), F.concat(F.regexp_extract("head", r"[^-]+$", 0), F.regexp_extract("tail", r"^[^-]+", 0)))
    starts = broken.select("id", "line_no", F.lit(True).alias("breaks"), joined.alias("glued"))
    ends = broken.select("id", F.col("next_no").alias("line_no"), F.lit(True).alias("goes_on"), joined.alias("carried"))
    text = rows.filter("kind = 'text'").join(_told(starts), ["id", "line_no"], "left").join(_told(ends), ["id", "line_no"], "left")
    order = Window.partitionBy("id").orderBy("line_no")
    first, last = F.get("tokens", F.lit(0)), F.get("tokens", F.size("tokens") - 1)
    left = F.when(F.col("goes_on"), F.coalesce("carried", first)).otherwise(F.lag(last).over(order))
    right = F.when(F.col("breaks"), F.coalesce("glued", last)).otherwise(F.lead(first).over(order))
    skipped = F.when(F.col("goes_on"), 1).otherwise(0)
    whole = F.slice("tokens", skipped + 1, F.greatest(F.lit(0), F.size("tokens") - skipped - F.when(F.col("breaks"), 1).otherwise(0)))
    text = text.select("id", "line_no", skipped.alias("skipped"), whole.alias("whole"), F.coalesce(left, F.lit("")).alias("left"), F.coalesce(right, F.lit("")).alias("right"))
    found = text.select("id", "line_no", "skipped", F.posexplode(_in_context(F.col("whole"), F.col("left"), F.col("right"))).alias("at", "w"))
    return found.select("id", "line_no", (F.col("skipped") + F.col("at")).alias("place"), "w.before", "w.word", "w.after")


def misplaced(words: DataFrame, lines: DataFrame, pairs: DataFrame, least: int = 3, ratio: float = 8.0) -> DataFrame:
    """(``id``, ``line_no``, ``place``, ``word``, ``better``): places whose neighbours speak for another form of the group.

    The other form must stand more often than the word, and ``least`` times, beside either neighbour, and the product of
    the two must be ``ratio`` squared times that of the word. A place with one neighbour only is left to frequency.
    """
    forms = stage(pairs.select("word").union(pairs.select("form")).distinct(), "forms")
    few = [r["word"] for r in forms.collect()] if forms.count() <= BROADCAST_ROWS else None
    shared = lines.sparkSession.sparkContext.broadcast(few)

    def counted(before: pa.Array, word: pa.Array, after: pa.Array) -> Iterator[pa.RecordBatch]:
        """How often each word of the batch stands after each, and before each."""
        if shared.value is not None:
            kept = pc.is_in(word, value_set=pa.array(shared.value, pa.string()))
            before, word, after = before.filter(kept), word.filter(kept), after.filter(kept)
        for side, near in (("before", before), ("after", after)):
            made = pa.table([near, word], ["near", "word"]).filter(pc.not_equal(near, ""))
            made = made.group_by(["near", "word"]).aggregate([([], "count_all")]).rename_columns(["near", "word", "n"])
            yield from made.append_column("side", pa.array([side] * len(made), pa.string())).select(["side", "near", "word", "n"]).combine_chunks().to_batches()

    def of_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from counted(*(batch.column(k) for k in range(3)))

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(0).filter(pc.greater(pc.list_value_length(batch.column(0)), 0))
            word, size = tokens.flatten(), pc.list_value_length(tokens).to_numpy()
            ends, at = size.cumsum(), np.arange(len(word))
            first, last = np.zeros(len(word), bool), np.zeros(len(word), bool)
            first[ends - size], last[ends - 1] = True, True
            empty = pa.scalar("", pa.string())
            before = pc.if_else(pa.array(first), empty, word.take(pa.array(np.maximum(at - 1, 0))))
            after = pc.if_else(pa.array(last), empty, word.take(pa.array(np.minimum(at + 1, max(len(word) - 1, 0)))))
            yield from counted(before, word, after)

    schema = "side string, near string, word string, n long"
    both = words.select("before", "word", "after").mapInArrow(of_places, schema).unionByName(lines.filter("not scan").select("tokens").mapInArrow(of_lines, schema))
    both = both if few is not None else both.join(forms, "word", "left_semi")
    known = stage(both.groupBy("side", "near", "word").agg(F.sum("n").alias("n")), "contexts")

    def beside(side: str) -> DataFrame:
        counts = known.filter(F.col("side") == side).select(F.col("near").alias(side), "word", "n")
        own = counts.withColumnRenamed("n", f"{side}_own").join(_told(pairs), "word")
        other = counts.withColumnsRenamed({"word": "form", "n": f"{side}_other"}).filter(F.col(f"{side}_other") >= least)
        return _told(stage(own.join(other, [side, "form"]).filter(F.col(f"{side}_other") > F.col(f"{side}_own")), f"beside-{side}"))

    found = words.join(beside("before"), ["before", "word"]).join(beside("after"), ["after", "word", "form"])
    weight = F.col("before_other").cast("double") * F.col("after_other")
    found = found.filter(weight >= ratio**2 * F.col("before_own") * F.col("after_own"))
    return found.groupBy("id", "line_no", "place", "word").agg(F.max(F.struct(weight.alias("weight"), "form"))["form"].alias("better"))


def analyse(pages: DataFrame, id_col: str, text_col: str, scanned: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines with kinds, broken words, repairs by place) of the scans among ``pages``.

    Null and empty texts, and rows with a null id, have no lines. Ids must be unique; pages loaded twice under two ids are pages of their own.
    """
    lines = stage(page_lines(pages, id_col, text_col, scanned), "page-lines")
    vocabulary = stage(word_counts(lines), "vocabulary")
    rows = stage(classified_lines(lines), "lines")
    broken = stage(broken_words(rows, vocabulary), "broken")
    words = stage(running_words(rows, broken), "running-words")
    rare = words.join(_told(stage(repairs(vocabulary), "misread")), "word").select("id", "line_no", "place", "word", F.col("better").alias("frequent"))
    placed = misplaced(words, lines, stage(rivals(vocabulary), "rivals"))
    wrong = rare.join(placed, ["id", "line_no", "place", "word"], "full").select("id", "line_no", "place", "word", F.coalesce("better", "frequent").alias("better"))
    return rows, broken, stage(wrong, "repairs")


def faults(pages: DataFrame, id_col: str, text_col: str, scanned: Column | None = None) -> DataFrame:
    """(id, ``line_no``, ``kind``): hyphen, char, header and pageno, each once a line."""
    rows, broken, wrong = analyse(pages, id_col, text_col, scanned)
    out = rows.filter("kind in ('header', 'pageno')").select("id", "line_no", "kind")
    out = out.unionByName(broken.filter("drop").select("id", "line_no", F.lit("hyphen").alias("kind")))
    out = out.unionByName(wrong.select("id", "line_no", F.lit("char").alias("kind")))
    return out.distinct().withColumnRenamed("id", id_col)


def repaired(pages: DataFrame, id_col: str, text_col: str, scanned: Column | None = None) -> DataFrame:
    """(id, ``text``) of the scans: paragraphs, divided by blank lines, without headers, page numbers and faults."""
    rows, broken, wrong = analyse(pages, id_col, text_col, scanned)
    fixes = wrong.groupBy("id", "line_no").agg(F.collect_list(F.struct("place", "word", "better")).alias("fixes"))
    rows = rows.filter("kind not in ('header', 'pageno')").join(fixes, ["id", "line_no"], "left")
    rows = rows.join(broken.select("id", "line_no", "drop"), ["id", "line_no"], "left")

    def fix(line: Column, x: Column) -> Column:
        # the word at its place among the line's words, with a capital if it has one
        place = F.concat(F.lit(r"(?U)^((?:[^\p{L}\p{N}@|]*+[\p{L}\p{N}@|]++){"), x["place"].cast("string"), F.lit(r"}+[^\p{L}\p{N}@|]*+)"))
        word = F.concat(F.lit(r"(?i:\Q"), x["word"], F.lit(r"\E)(?![\p{L}\p{N}@|])"))
        capital = F.regexp_replace(line, F.concat(place, F.lit(r"(?=\p{Lu})"), word), F.concat(F.lit("$1"), F.initcap(x["better"])))
        return F.regexp_replace(capital, F.concat(place, F.lit(r"(?!\p{Lu})"), word), F.concat(F.lit("$1"), x["better"]))

    line = F.when(F.col("fixes").isNotNull(), F.aggregate("fixes", F.col("line"), fix)).otherwise(F.col("line"))
    line = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    line = F.when(F.col("drop"), F.regexp_replace(line, rf"[{MARKS}]$", "")).otherwise(line)
    order = Window.partitionBy("id").orderBy("line_no")
    width = F.max(F.length("line")).over(Window.partitionBy("id"))
    before, short = F.lag("kind").over(order), F.lag(F.col("line").rlike(r"[.!?:][\"')\]]*\s*$") & (F.length("line") < 0.7 * width)).over(order)
    new = (F.col("kind") != "text") | F.coalesce(before != "text", F.lit(True)) | F.coalesce(short, F.lit(False))
    rows = rows.select("id", "line_no", "kind", line.alias("line"), F.col("drop"), new.alias("new"))
    rows = rows.withColumn("paragraph", F.sum(F.col("new").cast("int")).over(order)).filter("kind <> 'blank'")
    glue = F.when(F.col("drop").isNull(), F.concat("line", F.lit(" "))).otherwise(F.col("line"))
    parts = rows.select("id", "paragraph", "line_no", glue.alias("part")).groupBy("id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("parts"))
    parts = parts.select("id", "paragraph", F.trim(F.array_join(F.col("parts.part"), "")).alias("line"))
    text = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "line"))).alias("all"))
    return text.select(F.col("id").alias(id_col), F.array_join(F.col("all.line"), "\n\n").alias("text"))
