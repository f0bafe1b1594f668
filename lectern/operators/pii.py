"""Redaction of personal data by an ordered list of patterns, as column expressions.

Each pattern works on what the one before left, so a link that holds an address counts for both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import once

#: Label, pattern, placeholder, in the order they apply. (?i) ignores case; all are Unicode-aware.
PATTERNS = [
    ("EMAIL", r"(?iuU)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    ("URL", r"""(?iuU)https?://[^\s"'<>]+""", "[URL]"),
    ("CNIC", r"(?U)\b\d{5}-\d{7}-\d{1}\b", "[CNIC]"),
    ("IBAN", r"(?iuU)\bPK\d{2}[A-Z]{4}\d{16}\b", "[IBAN]"),
    ("CREDIT_CARD", r"(?U)\b(?:\d{4}[\s\-]?){3}\d{4}\b", "[CREDIT_CARD]"),
    ("PHONE_PK", r"(?U)(?:\+92|0092|0)3\d{2}[\s\-]?\d{7}\b", "[PHONE]"),
    ("PHONE_INTL", r"(?U)\+\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{4}\b", "[PHONE]"),
    ("IP_ADDRESS", r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP_ADDRESS]"),
    ("DATE_OF_BIRTH", r"(?iuU)(?:date\s+of\s+birth|dob|d\.o\.b\.?)\s*:?\s*\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}", "[DOB]"),
]
LABELS = [label for label, _, _ in PATTERNS]

#: What every match of a pattern holds: a cheap test that spares most texts the pattern itself.
SIGNS = {
    "EMAIL": lambda c: c.contains("@"),
    "URL": lambda c: c.contains("://"),
    "CNIC": lambda c: c.rlike(r"\p{Nd}{5}-"),
    "IBAN": lambda c: c.rlike(r"(?iu)pk\p{Nd}"),
    "CREDIT_CARD": lambda c: c.rlike(r"\p{Nd}{4}"),
    "PHONE_PK": lambda c: c.rlike(r"\p{Nd}{7}"),
    "PHONE_INTL": lambda c: c.contains("+"),
    "IP_ADDRESS": lambda c: c.rlike(r"\p{Nd}\.\p{Nd}"),
    "DATE_OF_BIRTH": lambda c: c.rlike(r"(?iu)birth|dob|d\.o\.b"),
}


def active(types: Sequence[str] = ()) -> list[tuple[str, str, str]]:
    """The patterns of the given labels, all of them where none is given; unknown labels select nothing."""
    return [p for p in PATTERNS if not types or p[0] in types]


def redact(df: DataFrame, column: str = "page_content", types: Sequence[str] = ()) -> DataFrame:
    """``column`` redacted, with ``pii_entities`` (labels in pattern order), ``pii_count`` and ``pii_redacted``.
    Null text stays null and has no entities."""
    names = []
    for k, (label, pattern, placeholder) in enumerate(active(types)):
        names.append(f"_pii_{k}")
        text, sign = F.col(column), SIGNS[label](F.col(column))
        count = F.when(sign, F.regexp_count(text, F.lit(pattern))).otherwise(0)
        df = df.withColumns({names[-1]: count, column: F.when(sign, F.regexp_replace(text, pattern, placeholder)).otherwise(text)})
    found = [F.when(F.col(n) > 0, p[0]) for n, p in zip(names, active(types))]
    total = sum((F.col(n) for n in names), F.lit(0))
    entities = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return df.withColumns({"pii_entities": entities, "pii_count": total, "pii_redacted": total > 0}).drop(*names)


def entity_counts(df: DataFrame) -> DataFrame:
    """Documents for each label, after ``redact``."""
    found = df.select(once(F.col("pii_entities")).alias("found"))
    return found.select(F.explode("found").alias("entity")).groupBy("entity").agg(F.count("*").alias("documents"))
