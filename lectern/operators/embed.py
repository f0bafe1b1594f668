"""Embeddings through a replaceable provider, in batches, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import EngineConfig

Provider = Callable[[list[str]], list[list[float]]]


def hashing_provider(dimension: int = 768) -> Provider:
    """A deterministic offline stand-in for a model: signed counts of hashed words and word pairs, of unit length. It
    puts texts with common words close together and knows nothing of meaning."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for i, text in enumerate(texts):
            words = text.lower().split()
            for token in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = xxhash.xxh64_intdigest(token)
                out[i, h % dimension] += 1 if h >> 63 else -1
            size = np.linalg.norm(out[i])
            if size:
                out[i] /= size
        return out.tolist()

    return embed


def with_retries(provider: Provider, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> Provider:
    """Try ``attempts`` times, waiting 1, 2, 4 ... seconds between; the last failure is raised."""

    def embed(texts: list[str]) -> list[list[float]]:
        if attempts < 1:
            raise RuntimeError("no attempt to embed is allowed")
        for k in range(attempts):
            try:
                return provider(texts)
            except Exception:
                if k == attempts - 1:
                    raise
                wait(2.0**k)
        raise AssertionError

    return embed


def _batched(provider: Provider, texts: list[str], size: int) -> list[list[float]]:
    out: list[list[float]] = []
    for k in range(0, len(texts), size):
        batch = texts[k : k + size]
        made = provider(batch)
        if len(made) != len(batch):  # else every later text would get another's vector
            raise ValueError(f"the provider gave {len(made)} vectors for {len(batch)} texts")
        out += made
    if len({len(v) for v in out}) > 1:
        raise ValueError(f"the provider gave vectors of different lengths: {sorted({len(v) for v in out})}")
    return out


def embed_texts(df: DataFrame, text_col: str, vector_col: str, provider: Provider | None = None, config: EngineConfig = EngineConfig(), dimension: int | None = None) -> DataFrame:
    """``vector_col`` for every text; null texts have a null vector. Every row keeps its own vector, whatever the order. A
    provider that gives another number of vectors than of texts, or vectors of another length than ``dimension`` (by
    default not checked for a provider of one's own, else that of ``config``), ends the job."""
    dimension = dimension or (None if provider else config.dimension)
    call, size = with_retries(provider or hashing_provider(config.dimension), config.embed_retries), max(1, config.embed_batch)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.notna()
            vectors = pd.Series([None] * len(s), index=s.index, dtype=object)
            made = _batched(call, s[known].tolist(), size)
            if made and dimension and len(made[0]) != dimension:
                raise ValueError(f"the provider gives vectors of length {len(made[0])}, the table holds {dimension}")
            for at, v in zip(s.index[known], made):
                vectors[at] = v
            yield vectors

    return df.withColumn(vector_col, embed(text_col))


def embed_similarities(provider: Provider | None = None, config: EngineConfig = EngineConfig()) -> Callable[[DataFrame, str, str], DataFrame]:
    """For semantic chunking: the cosines of neighbouring texts of an array. The vectors stay where they are made; only
    one number a pair goes back to the JVM. A vector of length 0 is like nothing."""
    call, size = with_retries(provider or hashing_provider(config.dimension), config.embed_retries), max(1, config.embed_batch)

    def similarities(parts) -> list[float]:
        if parts is None or len(parts) < 2:
            return []
        v = np.asarray(_batched(call, list(parts), size), dtype=np.float64)
        lengths = np.linalg.norm(v, axis=1)
        both = lengths[1:] * lengths[:-1]
        return np.where(both > 0, np.einsum("nd,nd->n", v[1:], v[:-1]) / np.where(both > 0, both, 1), 0.0).tolist()

    def add(df: DataFrame, texts: str, out: str) -> DataFrame:
        @F.pandas_udf("array<double>")
        def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(similarities)

        return df.withColumn(out, measure(texts))

    return add
