"""Chunking: routing by file type, recursive splitting, and semantic grouping of sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.config import EngineConfig
from lectern.functions import text as T
from lectern.functions.vectors import cosine

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Abbreviations that end no sentence (fixed values).
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Sr", "Jr", "No", "Fig", "vs", "approx", "e.g", "i.e", "z.B", "bzw", "Nr", "Mme", "Sra", "p.ej")
SENTENCE_END = re.compile("".join(rf"(?<!\b{re.escape(a)}\.)" for a in ABBREVIATIONS) + r"(?<=[.!?])\s+")


def route(file_type: Column, semantic_types: Sequence[str] = ("html", "json")) -> Column:
    return F.when(F.lower(T.strip(file_type)).isin(*semantic_types), "semantic").otherwise("recursive")


def _parts(text: str, separator: str) -> list[str]:
    """Cut at a separator, which stays at the start of what follows it; no empty parts."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join parts up to ``size`` characters; a chunk begins with trailing parts of the one before, up to ``overlap``."""
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            yield "".join(held)
            drop = 0
            while total > overlap or (total > 0 and total + len(part) > size):
                total -= len(held[drop])
                drop += 1
            held = held[drop:]
        held.append(part)
        total += len(part)
    yield "".join(held)


def recursive_split(text: str, size: int = 512, overlap: int = 64, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters where the separators allow, tried from the strongest to single characters.
    Parts of ``size`` characters or more are split further; chunks are stripped and never empty."""
    out: list[str] = []

    def emit(parts: list[str]) -> None:
        out.extend(c for c in (x.strip() for x in _packed(parts, size, overlap)) if c)

    def split(piece: str, level: int) -> None:
        while level < len(separators) - 1 and separators[level] and separators[level] not in piece:
            level += 1
        small: list[str] = []
        for part in _parts(piece, separators[level]):
            if len(part) < size:
                small.append(part)
                continue
            emit(small)
            small = []
            if level + 1 < len(separators):
                split(part, level + 1)
            else:
                out.append(part)
        emit(small)

    if text:
        split(text, 0)
    return out


def sentences(text: str) -> list[str]:
    """Sentences end at ., ! or ? before white space, but not at one of ``ABBREVIATIONS``. A stand-in for a trained tokenizer;
    give another where needed."""
    return [s for s in SENTENCE_END.split(text.strip()) if s]


def breakpoints(similarities: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Positions (from 1) after which a group of sentences ends: where the next is unlike and the group has the least
    size, or where it has the greatest. One pass over the array, in the JVM."""
    t, lo, hi = F.lit(config.similarity_threshold), F.lit(config.min_sentences), F.lit(config.max_sentences)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.array().cast("array<int>").alias("b"))

    def step(a: Column, s: Column) -> Column:
        size = a["c"] + 1
        cut = ((s < t) & (size >= lo)) | (size >= hi)
        return F.struct((a["n"] + 1).alias("n"), F.when(cut, 0).otherwise(size).alias("c"), F.when(cut, F.array_append(a["b"], a["n"] + 1)).otherwise(a["b"]).alias("b"))

    return F.aggregate(similarities, start, step, lambda a: a["b"])


def adjacent_similarities(vectors: Column) -> Column:
    """Cosine of each vector and the next."""
    n = F.size(vectors)
    return F.zip_with(F.slice(vectors, 1, F.greatest(n - 1, F.lit(0))), F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), cosine)


def grouped(parts: Column, breaks: Column, least: int = 2) -> Column:
    """Sentences joined by blanks between the breaks; a tail of fewer than ``least`` joins the group before it."""
    n = F.size(parts)
    inner = F.filter(breaks, lambda b: b < n)
    last = F.coalesce(F.try_element_at(inner, F.lit(-1)), F.lit(0))
    cuts = F.when((n - last < least) & (F.size(inner) > 0), F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))).otherwise(inner)
    starts, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(n))
    return F.zip_with(starts, ends, lambda s, e: F.array_join(F.slice(parts, s + 1, e - s), " "))


def _recursive_parts(df: DataFrame, text: Column, config: EngineConfig) -> DataFrame:
    """``df`` with ``_recursive``: the chunks of the cleaned ``text``, none of them empty."""
    size, overlap = config.chunk_size, config.chunk_overlap

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: recursive_split(t, size, overlap) if t else [])

    return df.withColumn("_clean", T.once(T.clean_for_chunking(text))).withColumn("_recursive", T.once(split("_clean"))).drop("_clean")


def _semantic_parts(df: DataFrame, text: Column, compare: Callable[[DataFrame, str, str], DataFrame], config: EngineConfig, splitter: Callable[[str], list[str]]) -> DataFrame:
    """``df`` with ``_semantic``: groups of like sentences of ``text``; a text of few sentences is one, unchanged."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: splitter(t) if t else [])

    df = df.withColumn("_text", T.once(F.when(T.strip(text) != "", text))).withColumn("_sentences", T.once(cut("_text")))
    few = F.size("_sentences") <= config.min_sentences
    df = compare(df.withColumn("_long", F.when(few, F.array().cast("array<string>")).otherwise(F.col("_sentences"))), "_long", "_similar")
    groups = grouped(F.col("_long"), breakpoints(F.col("_similar"), config), config.min_sentences)
    whole = F.when(F.col("_text").isNotNull(), F.array("_text"))
    return df.withColumn("_semantic", T.once(F.when(few, whole).otherwise(groups))).drop("_text", "_sentences", "_long", "_similar")


def _numbered(df: DataFrame, parts: Column, column: str) -> DataFrame:
    rest = [c for c in df.columns if c not in ("_recursive", "_semantic", "_route", column, "chunk_index", "chunk_total")]
    made = df.select(*rest, F.size(parts).alias("chunk_total"), F.posexplode(parts).alias("chunk_index", column))
    return made.filter(F.col(column) != "")


def recursive_chunks(df: DataFrame, config: EngineConfig = EngineConfig(), column: str = "page_content") -> DataFrame:
    """One row a chunk of the cleaned text, with ``chunk_index`` and ``chunk_total``; texts empty after cleaning go.
    All columns of the document stay."""
    return _numbered(_recursive_parts(df, F.col(column), config), F.col("_recursive"), column)


def semantic_chunks(df: DataFrame, compare: Callable[[DataFrame, str, str], DataFrame], config: EngineConfig = EngineConfig(), column: str = "page_content", splitter: Callable[[str], list[str]] = sentences) -> DataFrame:
    """One row a group of like sentences. Documents of at most ``min_sentences`` sentences are one chunk, unchanged.

    ``compare(df, texts, out)`` adds the similarities of neighbouring texts of an array (``embed.embed_similarities``).
    """
    return _numbered(_semantic_parts(df, F.col(column), compare, config, splitter), F.col("_semantic"), column)


def chunk_documents(df: DataFrame, compare: Callable[[DataFrame, str, str], DataFrame], config: EngineConfig = EngineConfig(), column: str = "page_content", splitter: Callable[[str], list[str]] = sentences) -> DataFrame:
    """Documents routed by ``file_type`` to the semantic or the recursive chunker. Both read ``df``, side by side: where much
    work makes it, give it as a written table (``session.stage``), as the engine does."""
    routed = df.withColumn("_route", route(F.col("file_type"), config.semantic_types))
    semantic = semantic_chunks(routed.filter("_route = 'semantic'").drop("_route"), compare, config, column, splitter)
    return recursive_chunks(routed.filter("_route = 'recursive'").drop("_route"), config, column).unionByName(semantic)
