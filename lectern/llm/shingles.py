"""Word shingles as hashed integers, computed for whole Arrow batches at a time.

A *word* is a longest run of letters or digits, in lower case. The *likeness* of two texts is the Jaccard similarity of
their sets of runs of ``width`` consecutive words. Every set is held as sorted, distinct 64-bit hashes, so set
operations are numpy operations on flat arrays with row offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import stage

BROADCAST_ROWS = 500_000  # ids are broadcast up to this many (8 bytes each), else joined by shuffle
HOT_PRINTS = 1_000  # prints with more than one row in this many are told to all tasks: there cannot be more of them
WORD = re.compile(r"[^\W_]+")


class _WordHashes(dict):
    """Hash of a word, kept for the next text that has it; emptied when it grows beyond ``LIMIT`` words."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, flat, and the number of words of each text. Null counts as empty."""
    flat: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    get, find = _HASHES.__getitem__, WORD.findall
    for i, text in enumerate(texts):
        if text:
            words = find(text.lower())
            flat.extend(map(get, words))
            counts[i] = len(words)
    return np.array(flat, dtype=np.uint64), counts


def fingerprints(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits (two int64 columns) that depend on the sequence of words of each text alone."""
    starts = np.cumsum(counts) - counts
    at = np.arange(len(flat), dtype=np.uint64) - np.repeat(starts, counts).astype(np.uint64)
    out = np.zeros((len(counts), 2), dtype=np.uint64)
    filled = counts > 0
    for k, step in enumerate(odd_numbers(2, 11)):
        terms = mix(flat + at * step + np.uint64(k))
        if len(terms):
            out[filled, k] = np.add.reduceat(terms, starts[filled])
    return out.view(np.int64)


def shingle_sets(flat: np.ndarray, counts: np.ndarray, width: int = 3, min_words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct shingles of every text, flat, and how many each has.

    A text of fewer than ``max(width, min_words)`` words has none.
    """
    starts = np.cumsum(counts) - counts
    size = np.where(counts >= max(width, min_words), counts - width + 1, 0)
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    row = np.repeat(np.arange(len(counts)), size)
    at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    hashes = np.zeros(total, dtype=np.uint64)
    for k, step in enumerate(odd_numbers(width, 5)):
        hashes += flat[at + k] * step
    hashes = mix(hashes)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(total, dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], np.bincount(row[keep], minlength=len(counts))


def pair_likeness(left: list, right: list, width: int = 3) -> np.ndarray:
    """Likeness of ``left[i]`` and ``right[i]``; 0 where neither has a shingle."""
    n = len(left)
    if not n:
        return np.zeros(0)
    hashes, size = shingle_sets(*word_hashes([*left, *right]), width)
    row = np.repeat(np.arange(2 * n), size) % n
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    both = np.bincount(row[1:][same], minlength=n)
    either = size[:n] + size[n:] - both
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


def text_prints(texts: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(``row``, ``p0``, ``p1``): a written table of the prints of the word sequences of all texts of ``min_words`` words
    or more, of one at least."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, counts = word_hashes(batch.column(1).to_pylist())
            keep = np.flatnonzero(counts >= max(min_words, 1))
            both = fingerprints(flat, counts)[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)).cast(pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["row", "p0", "p1"])

    return stage(texts.select(F.col(id_col).cast("long").alias("row"), text_col).mapInArrow(prints, "row long, p0 long, p1 long"), "prints")


def first_of_copies(rows: DataFrame) -> DataFrame:
    """``rows(row, p0, p1)``, a written table, as (``row``, ``first``, ``copies``): the smallest row with the same print, and
    how many there are.

    Counting is partial. Prints that very many rows share (at most ``HOT_PRINTS`` of them, whatever the number of rows) are
    broadcast, so their rows stay where they are; those of the others are joined by print.
    """
    key = ["p0", "p1"]
    groups = stage(rows.groupBy(*key).agg(F.min("row").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "copied")
    least = max(rows.count() // HOT_PRINTS, 1) + 1
    told = rows.join(F.broadcast(groups.filter(F.col("copies") >= least)), key, "left")
    rest = told.filter("first is null").select("row", *key).join(groups.filter(F.col("copies") < least), key, "left")
    out = told.filter("first is not null").select("row", "first", "copies")
    return out.unionByName(rest.select("row", F.coalesce("first", "row").alias("first"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies")))


def with_likeness(pairs: DataFrame, texts: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``pairs(a, b)``, a written table, with the likeness of their texts.

    Only texts that a pair names leave their scan; they are exchanged by id once, for both sides.
    """
    ids = stage(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "paired")
    side = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    side = side.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "_id", "left_semi")
    both = (
        pairs.join(side.withColumnsRenamed({"_id": "a", "_text": "_left"}), "a")
        .join(side.withColumnsRenamed({"_id": "b", "_text": "_right"}), "b")
        .select("a", "b", "_left", "_right")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = pair_likeness(batch.column(2).to_pylist(), batch.column(3).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["a", "b", "likeness"])

    return both.mapInArrow(measure, "a long, b long, likeness double")


def earlier_in_group(group: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (later, earlier) of equal neighbours in ``group``, which is sorted; one pair of arrays per distance.

    With ``most``, only pairs at most that far apart.
    """
    alive, step = np.arange(1, len(group)), 1
    while len(alive) and (most is None or step <= most):
        alive = alive[alive >= step]
        alive = alive[group[alive] == group[alive - step]]
        if len(alive):
            yield alive, alive - step
        step += 1
