"""Encoding a corpus with a public byte-level BPE vocabulary, by tree concatenation where a text is very long.

Texts up to ``leaf`` characters are encoded whole. A longer one is halved again and again until its parts fit; the parts
are encoded as rows of their own, in parallel, and joined back pairwise up the tree. A part ends, where there is one
near, between a visible character and a single space before the next visible one: the vocabulary's splitting pattern
never spans that place, so such a join needs no work. At any other join a window of tokens on both sides is decoded and
encoded again, and grows until its first and its last tokens are those the two sides already have there. Whether a
sequence of tokens is the encoding depends on neighbouring tokens alone, so agreement at both seams makes the whole exact.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARIES = "/opt/tokenizers"
#: The public splitting pattern of the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAFE = re.compile(r"\S(?= \S)")
LEAF = 1 << 12  # characters; longer texts are encoded in parts


@lru_cache(maxsize=4)
def encoder(folder: str = VOCABULARIES, name: str = "byte_bpe_50k"):
    """The encoding of ``name`` in ``folder``, read once a process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def halves(text: str, leaf: int) -> list[tuple[str, bool]]:
    """(part, whether the place before it is a safe one) of a text, by repeated halving."""
    if len(text) <= leaf:
        return [(text, True)]
    middle = len(text) // 2
    near = max(64, leaf // 8)
    spots = [m.end() for m in SAFE.finditer(text, max(0, middle - near), min(len(text), middle + near))]
    cut = min(spots, key=lambda p: abs(p - middle)) if spots else middle
    left, right = halves(text[:cut], leaf), halves(text[cut:], leaf)
    return [*left, (right[0][0], bool(spots)), *right[1:]]


def join(left: list[int], right: list[int], enc) -> list[int]:
    """The encoding of the text of ``left`` followed by that of ``right``."""
    if not left or not right:
        return left + right
    size = 8
    while True:
        a, b = max(0, len(left) - size), min(len(right), size)
        try:
            text = enc.decode_bytes(left[a:] + right[:b]).decode("utf-8")
        except UnicodeDecodeError:  # a token ends inside a character
            text = None
        if text is not None:
            again = enc.encode_ordinary(text)
            head = a == 0 or again[:2] == left[a : a + 2]
            tail = b == len(right) or again[-2:] == right[b - 2 : b]
            if head and tail:
                return left[:a] + again + right[b:]
        if a == 0 and b == len(right):
            return enc.encode_ordinary(enc.decode_bytes(left + right).decode("utf-8"))
        size *= 2


def join_tree(parts: list[tuple[list[int], bool]], enc) -> list[int]:
    """Neighbours are joined pairwise until one is left."""
    while len(parts) > 1:
        level = []
        for k in range(0, len(parts) - 1, 2):
            (left, safe_left), (right, safe) = parts[k], parts[k + 1]
            level.append((left + right if safe else join(left, right, enc), safe_left))
        if len(parts) % 2:
            level.append(parts[-1])
        parts = level
    return parts[0][0] if parts else []


def encode_texts(texts: DataFrame, id_col: str, text_col: str, folder: str = VOCABULARIES, name: str = "byte_bpe_50k", leaf: int = LEAF) -> DataFrame:
    """(id, ``ids``): the token ids of every text, without special tokens; null and empty texts have the empty list.

    Blank texts and outer spaces are encoded as they stand, and strings that look like special tokens are ordinary
    text. Ids must be unique (rows that repeat an id of a very long text would be joined); further columns are not read.
    """
    texts = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    long_text = F.coalesce(F.length("text") > leaf, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                ids = [enc.encode_ordinary(t) if t else [] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = halves(batch.column(1)[k].as_py(), leaf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k] * len(parts))), pa.array(range(len(parts)), pa.int32()), pa.array([p for p, _ in parts]), pa.array([s for _, s in parts])],
                    ["id", "part", "text", "safe"],
                )

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            ids = [enc.encode_ordinary(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(ids, pa.list_(pa.int32()))], ["id", "part", "safe", "ids"])

    def rejoin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        ids = join_tree([(list(i), bool(s)) for i, s in zip(pdf["ids"], pdf["safe"])], encoder(folder, name))
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "ids": [ids]})

    schema = f"id {kind}, ids array<int>"
    whole = texts.filter(~long_text).mapInArrow(short, schema)
    parts = texts.filter(long_text).mapInArrow(leaves, f"id {kind}, part int, text string, safe boolean").repartition("id", "part")
    joined = parts.mapInArrow(encode_leaves, f"id {kind}, part int, safe boolean, ids array<int>").groupBy("id").applyInPandas(rejoin, schema)
    return whole.unionByName(joined).withColumnRenamed("id", id_col)


def count_tokens(texts: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:
    """(id, ``tokens``): the number of tokens of every text, 0 for null and empty ones."""
    return encode_texts(texts, id_col, text_col, **settings).select(id_col, F.size("ids").cast("long").alias("tokens"))
