"""The pre-processing chain: sanitise, normalise, gate, enrich, redact. Every step is ``DataFrame -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import EngineConfig
from lectern.functions import text as T
from lectern.operators import pii

DEFAULTS = {"source": "unknown", "source_path": "", "page": "0", "total_pages": "0", "chunk_index": "0", "chunk_total": "0", "file_type": "unknown"}
REQUIRED = ("source", "page", "total_pages", "file_type", "ingested_at")  # fixed values
NUMBERS = ("page", "total_pages", "chunk_index", "chunk_total")


def whole_number(c: Column) -> Column:
    """A whole number, or 0 where the text is none (``3.7`` is none)."""
    c = T.strip(c.cast("string"))
    return F.coalesce(F.when(c.rlike(r"\A[+-]?\d+\z"), c.try_cast("int")), F.lit(0))


def sanitize_text(df: DataFrame, column: str = "page_content", config: EngineConfig = EngineConfig()) -> DataFrame:
    return df.withColumn(column, T.sanitize(column, config.nbsp_to_space))


def normalize_unicode(df: DataFrame, column: str = "page_content", config: EngineConfig = EngineConfig()) -> DataFrame:
    return df.withColumn(column, T.unicode_normalize(column, config.nfkc))


def normalize_metadata(df: DataFrame, run_time: str | None = None) -> DataFrame:
    """Missing metadata gets its default; the source is a bare file name, the type is trimmed and in lower case, numbers
    are whole or 0, and ``ingested_at`` is kept where it is given. Columns that are absent are made."""
    have = set(df.columns)
    out = {k: F.coalesce(F.col(k).cast("string"), F.lit(v)) if k in have else F.lit(v) for k, v in DEFAULTS.items()}
    out["source"] = T.base_name(out["source"])
    out["file_type"] = F.lower(T.strip(out["file_type"]))
    out |= {k: whole_number(out[k]) for k in NUMBERS}
    now = F.lit(run_time) if run_time else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    out["ingested_at"] = F.coalesce(F.col("ingested_at").cast("string"), now) if "ingested_at" in have else now
    return df.withColumns(out)


def require_metadata(df: DataFrame) -> DataFrame:
    """``df``, if it has all metadata that ``normalize_metadata`` makes; else an error, before anything runs."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing metadata: {', '.join(missing)}; normalize_metadata makes it")
    return df


def reject_reason(column: str = "page_content", least: int = 20) -> Column:
    """Why a document fails the gate; null where it passes."""
    length = F.length(T.strip(column))
    return F.when(F.col(column).isNull(), "content is no text").when(length < least, F.concat(F.lit("content has only "), length.cast("string"), F.lit(" characters")))


def schema_gate(df: DataFrame, column: str = "page_content", least: int = 20) -> DataFrame:
    """Documents of at least ``least`` characters, stripped."""
    return df.withColumn(column, T.once(T.strip(column))).filter(F.length(column) >= least)


def schema_rejects(df: DataFrame, column: str = "page_content", least: int = 20) -> DataFrame:
    """The documents that fail the gate, with ``reject_reason``."""
    return df.withColumn("reject_reason", reject_reason(column, least)).filter("reject_reason is not null")


def enrich(df: DataFrame, column: str = "page_content") -> DataFrame:
    """Counts, reading time at 240 words a minute, number and table marks, and density. Null text counts as empty."""
    t = F.coalesce(F.col(column), F.lit(""))
    words, chars = T.word_count(t), F.length(t)
    per_word = chars / F.greatest(words, F.lit(1))
    return df.withColumns(
        {
            "word_count": words,
            "char_count": chars,
            "estimated_read_time_seconds": F.greatest(F.lit(1), F.bround(words / F.lit(4.0), 0).cast("int")),
            "has_numbers": t.rlike(r"(?U)\d{3,}"),
            "has_tables": t.rlike(r"(?U)\|[\s\-]+\|"),
            "content_density": F.when((words == 0) | (per_word < 4), "sparse").when(per_word > 8, "dense").otherwise("normal"),
        }
    )


def preprocess(df: DataFrame, config: EngineConfig = EngineConfig(), run_time: str | None = None, column: str = "page_content") -> DataFrame:
    """The whole chain in its fixed order. Counts describe the text before redaction, and the gate comes before both."""
    df = normalize_unicode(sanitize_text(df, column, config), column, config)
    df = enrich(schema_gate(require_metadata(normalize_metadata(df, run_time)), column, config.min_document_chars), column)
    return pii.redact(df, column, config.pii_types) if config.pii_enabled else df
