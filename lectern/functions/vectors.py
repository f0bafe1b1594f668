"""Vector arithmetic and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; the longer vector's rest is left out."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def chroma_score(cos: Column) -> Column:
    """A score in [0, 1] from a cosine: half of one plus it, never below 0."""
    return F.greatest(F.lit(0.0), 1 - (1 - cos) / 2)


def vector_id(source: Column, page: Column, chunk_index: Column) -> Column:
    """The first 32 hexadecimal digits of SHA-256 of ``source::p<page>::c<index>``."""
    return F.substring(F.sha2(F.concat(source, F.lit("::p"), page.cast("string"), F.lit("::c"), chunk_index.cast("string")), 256), 1, 32)


def point_id(identity: Column) -> Column:
    """The first 16 hexadecimal digits as an unsigned 64-bit number."""
    return F.conv(F.substring(identity, 1, 16), 16, 10).cast("decimal(20,0)")
