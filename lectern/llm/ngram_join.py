"""Near-duplicate texts: an exact similarity self-join over word shingles by vertical partitioning.

All shingles stand in one global order, rare ones first. That order is cut into fragments. A text's shingles that can
witness a partner (its extended prefix) are sent, as one segment per fragment, to the fragments they belong to; each
fragment counts, for itself, the partial overlap of the texts that meet in it, and the counts are summed per pair.
Pairs that reach the count every true pair must reach are verified on their texts, so the result is exact.

What makes it bounded at any size:

* copies of one sequence of words are one class; only its first row takes part, and membership is kept beside it;
* the order comes from a table of counters of fixed size (documented at ``counter_bits``), summed over all texts. They
  are kept as 16-bit codes that round large counts up, so no shingle is too frequent to be split by its true count. Any
  order that all texts share gives a right result, so collisions in it cost time, never a pair;
* a shingle counted once cannot be shared and is never sent;
* a segment carries a 128-bit parity map of its text. Its Hamming distance to another's never exceeds the size of the
  symmetric difference, so a pair beyond the allowed difference is dropped inside the fragment without a loss;
* a shingle in very many texts is split into blocks of texts, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shingles as S
from lectern.session import stage

ELL = 3  # shared shingles of the extended prefixes that every true pair has
TEXT = np.dtype([("row", "<i8"), ("size", "<u4"), ("map0", "<u8"), ("map1", "<u8")])  # once a text and fragment
MEET = np.dtype([("token", "<u4"), ("text", "<u2"), ("pos", "<u2")])  # 32 bits of a shingle's hash, text in the segment, position and side
MOST_TEXTS, MOST_POS = 60_000, 32_767


def copy_classes(texts: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(``row``, ``class``, ``copies``): the class of a text is the smallest id with the same sequence of words.

    Texts of fewer than ``min_words`` words, null and empty ones are left out.
    """
    return stage(S.first_of_copies(S.text_prints(texts, id_col, text_col, min_words)).select("row", F.col("first").alias("class"), "copies"), "classes")


MANTISSA = 11


def as_code(count: np.ndarray) -> np.ndarray:
    """Counts as 16-bit codes in the same order: exact below 2**12, above it rounded up to 12 leading bits. No count
    saturates below 2**42."""
    count = count.astype(np.int64)
    shift = np.maximum(0, np.frexp(count.astype(np.float64))[1] - (MANTISSA + 1))
    top = -(-count >> shift)  # rounded up
    over = top >> (MANTISSA + 1) > 0
    shift, top = shift + over, np.where(over, top >> 1, top)
    return np.where(shift == 0, top, ((shift + 1) << MANTISSA) + (top - (1 << MANTISSA))).astype("<u2")


def as_count(code: np.ndarray) -> np.ndarray:
    """The least count with this code or more: never below the count it was made of."""
    code = code.astype(np.int64)
    shift = np.maximum(0, (code >> MANTISSA) - 1)
    return np.where(shift == 0, code, ((code & ((1 << MANTISSA) - 1)) + (1 << MANTISSA)) << shift)


def shingle_counters(texts: DataFrame, text_col: str, width: int, min_words: int, bits: int, fan: int = 64) -> np.ndarray:
    """Upper bounds of the number of texts that have a shingle, as codes (``as_code``) in ``2**bits`` cells.

    Every task sums its own cells and sends them in compressed blocks; a block of up to ``fan`` tasks is summed in one
    task, then those sums by block. The driver receives 2 bytes a cell, whatever the number of texts.
    """
    blocks = max(1, 2**bits // 2**18)
    part = 2**bits // blocks
    schema = "block int, home int, cells binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2**bits, dtype=np.uint32)
        for batch in batches:
            hashes, _ = S.shingle_sets(*S.word_hashes(batch.column(0).to_pylist()), width, min_words)
            cells, n = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
            table[cells.astype(np.int64)] += n.astype(np.uint32)
        home = TaskContext.get().partitionId() // fan
        for k in range(blocks):
            piece = table[k * part : (k + 1) * part]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([home], pa.int32()), pa.array([zlib.compress(piece.astype("<u4").tobytes(), 1)], pa.binary())], ["block", "home", "cells"])

    def add(kind_in: str, kind_out):
        def total(pdf: pd.DataFrame) -> pd.DataFrame:
            cells = np.zeros(part, dtype=np.int64)
            for blob in pdf["cells"]:
                cells += np.frombuffer(zlib.decompress(blob), dtype=kind_in)
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "home": [0], "cells": [zlib.compress(kind_out(cells).tobytes(), 1)]})

        return total

    counted = texts.select(text_col).mapInArrow(count, schema)
    counted = counted.groupBy("block", "home").applyInPandas(add("<u4", lambda c: c.astype("<i8")), schema)
    counted = counted.groupBy("block").applyInPandas(add("<i8", as_code), schema)
    out = np.zeros(2**bits, dtype="<u2")
    for row in counted.toLocalIterator():
        out[row["block"] * part : (row["block"] + 1) * part] = np.frombuffer(zlib.decompress(row["cells"]), dtype="<u2")
    return out


def ordered_prefixes(hashes: np.ndarray, size: np.ndarray, counters: np.ndarray, bits: int, threshold: float) -> dict[str, np.ndarray]:
    """The shingles of each text's extended prefix that more than one text may have, with their position in the order.

    ``order`` is the place in the global order: the counter first, then the hash.
    """
    row = np.repeat(np.arange(len(size)), size)
    found = counters[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
    key = (found.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
    sort = np.lexsort((key, row))
    hashes, found, key = hashes[sort], found[sort], key[sort]
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    total = size[row]
    keep = (pos < total - np.ceil(threshold * total - 1e-9) + ELL) & (found > 1)
    return {"token": hashes[keep], "order": key[keep], "count": found[keep], "row": row[keep], "pos": pos[keep], "size": total[keep]}


def parity_maps(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit words a text: bit i is the parity of the number of shingles that fall on i."""
    out = np.zeros((len(size), 2), dtype=np.uint64)
    filled = size > 0
    if filled.any():
        bit = np.uint64(1) << (hashes & np.uint64(63))
        upper = (hashes & np.uint64(64)) > 0
        starts = (np.cumsum(size) - size)[filled]
        out[filled, 0] = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), starts)
        out[filled, 1] = np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), starts)
    return out


def packed(texts: np.ndarray, meets: np.ndarray) -> bytes:
    """One segment: the number of texts, the texts, then what they bring to the fragment, field by field."""
    used, meets = np.unique(meets["text"], return_inverse=True)[0], meets.copy()
    meets["text"] = np.searchsorted(used, meets["text"])
    texts = texts[used]
    fields = [texts[n].tobytes() for n in TEXT.names] + [meets[n].tobytes() for n in MEET.names]
    return np.array([len(texts)], "<u4").tobytes() + b"".join(fields)


def unpacked(segments) -> tuple[np.ndarray, np.ndarray]:
    """(texts, meets) of segments, with ``text`` in a wider array of its own: meets are (token, text, pos)."""
    all_texts, token, text, pos, before = [], [], [], [], 0
    for blob in segments:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        at, texts = 4, np.zeros(n, TEXT)
        for name in TEXT.names:
            texts[name] = np.frombuffer(blob, TEXT[name], n, at)
            at += n * TEXT[name].itemsize
        m = (len(blob) - at) // MEET.itemsize
        token.append(np.frombuffer(blob, "<u4", m, at))
        text.append(np.frombuffer(blob, "<u2", m, at + 4 * m).astype(np.int64) + before)
        pos.append(np.frombuffer(blob, "<u2", m, at + 6 * m))
        all_texts.append(texts)
        before += n
    return np.concatenate(all_texts), np.rec.fromarrays([np.concatenate(token), np.concatenate(text), np.concatenate(pos)], names="token,text,pos")


def partial_overlaps(texts: np.ndarray, meets: np.ndarray, threshold: float, cross: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared shingles, least of them in all) of the pairs that meet in one fragment and may be true, a < b.

    With ``cross`` only pairs of different sides count: a side is the lowest bit of ``pos``.
    """
    sort = np.argsort(meets["token"], kind="stable")
    token, at, pos = meets["token"][sort], meets["text"][sort], meets["pos"][sort]
    row, size, maps = texts["row"][at], texts["size"][at].astype(np.float64), (texts["map0"][at], texts["map1"][at])
    side, pos = pos & 1, (pos >> 1).astype(np.float64)
    share = threshold / (1 + threshold)
    lefts, rights, leasts = [], [], []
    for i, j in S.earlier_in_group(token):
        both = size[i] + size[j]
        need = np.ceil(both * share - 1e-9)
        ell = np.minimum(ELL, need)
        ok = (pos[i] < size[i] - need + ell) & (pos[j] < size[j] - need + ell)
        if cross:
            ok &= side[i] != side[j]
        i, j, room = i[ok], j[ok], (both - 2 * need)[ok]
        apart = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int64) for m in maps)
        near = apart <= room
        leasts.append(ell[ok][near])
        ok = near
        lefts.append(row[i[ok]])
        rights.append(row[j[ok]])
    if not lefts:
        return (np.zeros(0, np.int64),) * 4
    left, right = np.concatenate(lefts), np.concatenate(rights)
    a, b = np.minimum(left, right), np.maximum(left, right)
    sort = np.lexsort((b, a))
    a, b, least = a[sort], b[sort], np.concatenate(leasts)[sort].astype(np.int64)
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    return a[starts], b[starts], np.diff(np.append(starts, len(a))), least[starts]


def similar_pairs(
    texts: DataFrame,
    id_col: str,
    text_col: str,
    width: int = 5,
    threshold: float = 0.8,
    min_words: int = 0,
    counter_bits: int | None = None,
    fragments: int | None = None,
    hot: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): ``pairs(a, b, likeness)`` of class representatives with likeness >= ``threshold``, a < b, and
    ``classes(row, class, copies)``, the class of every row that has at least ``min_words`` words.

    Null, empty and too short texts, and rows with a null id, are in neither. Rows with the same words in the same order are one class and give
    no pair. Ids must be unique integers. ``texts`` may hold further columns under any name; they are not read.
    ``counter_bits``: 2**bits counters of 2 bytes, by default about eight a text, between 2**16 and 2**26 (128 MB).
    ``fragments``: parts of the shingle order, by default one for 25,000 texts and at least 12.
    ``hot``: a shingle in more texts than this is split into blocks of about this many.
    """
    spark = texts.sparkSession
    texts = texts.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    classes = copy_classes(texts, "row", "text", max(min_words, width))
    n = classes.count()
    bits = counter_bits or int(np.clip(np.ceil(np.log2(8 * max(n, 1))), 16, 26))
    parts = fragments or max(12, n // 25_000)
    counters = shingle_counters(texts, "text", width, min_words, bits)
    copies = classes.filter("row != class").select("row")
    firsts = texts.join(F.broadcast(copies) if copies.count() <= S.BROADCAST_ROWS else copies, "row", "left_anti")

    shared = spark.sparkContext.broadcast(counters)

    def sample_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = S.shingle_sets(*S.word_hashes(batch.column(0).to_pylist()), width, min_words)
            order = ordered_prefixes(*sets, shared.value, bits, threshold)["order"]
            yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.float64))], ["at"])

    # Where to cut the order: quantiles over about 2,000 texts. They balance the fragments; no result hangs on them.
    some = texts.filter("text is not null").sample(min(1.0, 2000 / max(n, 1)), seed=7).select("text").mapInArrow(sample_orders, "at double")
    ends = some.select(F.percentile_approx("at", [k / parts for k in range(1, parts)], F.lit(2000)).alias("q")).head()["q"]
    cuts = np.unique(np.array(ends or [], dtype=np.float64).astype(np.uint64))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in (part for whole in batches for part in (whole.slice(k, MOST_TEXTS) for k in range(0, whole.num_rows, MOST_TEXTS))):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hashes, size = S.shingle_sets(*S.word_hashes(batch.column(1).to_pylist()), width, min_words)
            p = ordered_prefixes(hashes, size, counters, bits, threshold)
            if not len(p["row"]):
                continue
            texts = np.zeros(len(ids), dtype=TEXT)
            texts["row"], texts["size"] = ids, size
            texts["map0"], texts["map1"] = parity_maps(hashes, size).T
            meets = np.zeros(len(p["row"]), dtype=MEET)
            meets["token"], meets["text"] = p["token"] & np.uint64(0xFFFFFFFF), p["row"]
            meets["pos"] = np.minimum(p["pos"], MOST_POS).astype(np.uint16) << np.uint16(1)
            home = np.searchsorted(cuts, p["order"], side="right").astype(np.int64)
            lo = np.zeros(len(home), np.int64)
            splits = -(-as_count(p["count"]) // hot)
            many = np.flatnonzero(splits > 1)  # hot shingles: this text's block meets every other block in a task of its own
            lo[many] = (S.mix(ids[p["row"][many]].astype(np.int64).view(np.uint64)) % splits[many].astype(np.uint64)).astype(np.int64)
            hi = lo.copy()
            if len(many):
                source = np.repeat(many, splits[many])
                other = np.arange(len(source)) - np.repeat(np.cumsum(splits[many]) - splits[many], splits[many])
                source, other = source[other != lo[source]], other[other != lo[source]]
                more = meets[source].copy()
                more["pos"] |= (lo[source] > other).astype(np.uint16)
                meets, home = np.concatenate([meets, more]), np.concatenate([home, home[source]])
                lo, hi = np.concatenate([lo, np.minimum(lo[source], other)]), np.concatenate([hi, np.maximum(hi[source], other)])
            sort = np.lexsort((meets["token"], hi, lo, home))
            meets, home, lo, hi = meets[sort], home[sort], lo[sort], hi[sort]
            new = np.ones(len(home), dtype=bool)
            new[1:] = (home[1:] != home[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            starts = np.flatnonzero(new)
            blobs = [packed(texts, meets[s:e]) for s, e in zip(starts, np.append(starts[1:], len(meets)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(home[starts], pa.int64()), pa.array(lo[starts], pa.int64()), pa.array(hi[starts], pa.int64()), pa.array(blobs, pa.binary())],
                ["fragment", "lo", "hi", "entries"],
            )

    def overlaps(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, n, least = partial_overlaps(*unpacked(pdf["entries"]), threshold, cross=pdf["lo"].iloc[0] != pdf["hi"].iloc[0])
        return pd.DataFrame({"a": a, "b": b, "n": n, "least": least})

    sent = firsts.mapInArrow(segments, "fragment long, lo long, hi long, entries binary")
    partial = sent.groupBy("fragment", "lo", "hi").applyInPandas(overlaps, "a long, b long, n long, least long")
    pairs = stage(partial.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")).filter("n >= least").select("a", "b"), "candidates")
    return S.with_likeness(pairs, texts, "row", "text", width).filter(F.col("likeness") >= threshold - 1e-12), classes


def row_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """All (``row_a``, ``row_b``) of different rows, row_a < row_b, that the pairs of classes and the classes stand for."""
    own = classes.filter("copies > 1").select(F.col("class").alias("a"), F.col("class").alias("b")).distinct()
    left = classes.select(F.col("class").alias("a"), F.col("row").alias("x"))
    right = classes.select(F.col("class").alias("b"), F.col("row").alias("y"))
    rows = pairs.select("a", "b").unionByName(own).join(left, "a").join(right, "b")
    rows = rows.filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return rows.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))


def near_duplicate_groups(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per text: ``row``, ``group`` (smallest row it is linked to over any number of links) and ``links``
    (texts it is directly linked to, copies included).

    Labels spread over links until none changes, two hops a round; every round is a written table.
    """
    pairs = stage(pairs.select("a", "b"), "links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("best"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "best").alias("label"), F.col("label").alias("old"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(hop, "label").select("node", F.least("label", "further").alias("label"), "old")
        step = stage(step, "labels")
        if step.filter("label != old").isEmpty():
            break
        labels = step.select("node", "label")
    sizes = classes.groupBy("class").agg(F.first("copies").alias("copies"))
    linked = both.join(sizes.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.sum("copies").alias("far"))
    out = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").join(linked.withColumnRenamed("a", "class"), "class", "left")
    return out.select("row", F.coalesce("label", "class").alias("group"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("links"))
