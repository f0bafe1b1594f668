"""Text repair and cleaning as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as white space everywhere (fixed value; the inside of a character class).
SPACE = r"\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column) -> Column:
    """The value of ``c``, computed once for each row. A filter on a plain column is pushed below the projection that
    makes it, with a second copy of all that makes it; a generated column is not."""
    return F.explode(F.array(c))


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(_column(c), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def sanitize(c: Column | str, nbsp_to_space: bool = False) -> Column:
    """Control and zero-width characters go, every line break becomes LF, lines lose white space at their end, at most
    two blank lines in a row stay, and the ends are stripped. A no-break space goes too, unless ``nbsp_to_space``."""
    c = _column(c)
    if nbsp_to_space:
        c = F.translate(c, "\u00a0", " ")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u00ad\u200b-\u200f\ufeff\u00a0]", "")
    c = F.regexp_replace(c, r"\r\n|[\r\u0085\u2028\u2029]", "\n")
    c = F.regexp_replace(c, r"[\t \u1680\u2000-\u200a\u202f\u205f\u3000]+(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    return strip(c)


def _composed(form: str):
    @F.pandas_udf(StringType())
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return compose


def unicode_normalize(c: Column | str, nfkc: bool = False) -> Column:
    """Composed form, then typographic quotes, dashes and the ellipsis as ASCII.

    Text below U+0300 is composed already, so only other text is handed to Python (null is handed on in its place).
    """
    c = _column(c)
    needs = c.rlike(r"[^\x00-\u02ff]") if not nfkc else c.rlike(r"[^\x00-\x7f]")
    composed = F.coalesce(_composed("NFKC" if nfkc else "NFC")(F.when(needs, c)), c)
    plain = F.translate(composed, "\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u2015\u00a0\ufeff", "'''\"\"\"--- ")
    return F.replace(plain, F.lit("\u2026"), F.lit("..."))


def join_spaced_letters(c: Column | str) -> Column:
    """``s p a c e d`` becomes ``spaced``: blanks between single word characters go."""
    return F.regexp_replace(_column(c), r"(?U)(?<=(?<!\w)\w) (?=\w(?!\w))", "")


def clean_for_chunking(c: Column | str) -> Column:
    """Spaced letters joined, blank lines and blanks collapsed, ends stripped."""
    c = join_spaced_letters(c)
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_column(c), F.lit(rf"[^{SPACE}]+"))


def base_name(c: Column | str) -> Column:
    """The last part of a path; empty becomes ``unknown``."""
    name = F.regexp_extract(F.regexp_replace(_column(c), r"/+\z", ""), r"[^/]*\z", 0)
    return F.when(name == "", "unknown").otherwise(name)
