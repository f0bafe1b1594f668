"""Duplicates and near-duplicates of new batches against everything accepted before: a prefix-tree hash forest.

Every text has one signature of ``DEPTH`` min-hashes per tree; read as one integer, signatures that share a prefix stand
next to each other in sorted order, so a tree is a sorted array and a subtree a range of it. The forest is a set of
*runs* of accepted rows. A run is a Parquet table with one folder for each *slot* (a tree and a range of its keys), and
in it the sorted entries in blocks that know their least and greatest key. A new batch

1. drops its own exact copies (a copy is a case whether its first row is accepted or is a case itself);
2. is signed;
3. is located by range search: the slots of its keys name the folders to read, their blocks' least and greatest keys name
   the blocks a subtree reaches into, and only those blocks are brought together with the new entries; in a block the
   search is on the whole signature first, then on shorter and shorter prefixes, until the prefix length at which
   ``1 - (1 - t**d)**trees`` reaches the recall target. A 64-bit sketch that travels with each entry drops what is far
   below the threshold ``t`` (``exact_sketch`` keeps everything that shares a subtree);
4. has its candidates verified on the texts, and its rows settled in order: a row is a case if an accepted row before
   it is alike, else it is accepted;
5. leaves its accepted rows as a sorted run. Runs are merged once there are more than ``max_runs`` of them.

History is never signed, sorted or exchanged as a whole again. Texts of history are scanned by id, and only those of
candidates leave the scan.

Hot groups: in a subtree that many new rows share, rows are linked to the first alike ones only, its leaders; every row
keeps its first few links, chosen while they are found, and blocks bound what meets in one call. A row linked to a case is
compared with what that case repeats, which settles most of a hot group. Rows that are still not settled are searched
again with wider limits, against what is accepted by then and among each other, until all are settled: a group of alike
rows shrinks to its accepted ones instead of being expanded into all its pairs, and no link is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import shingles as S
from lectern.session import discard, stage, work_folder

DEPTH, DIGIT = 5, 12  # min-hashes in a signature, and the bits kept of each
ENTRY = np.dtype([("key", "<u8"), ("at", "<i8"), ("sketch", "<u8")])
ROW_BITS = 44  # a position in the order: the batch above, the row id in the lower 44 bits
SIGNED = "slot int, lead long, n int, entries binary"
RUN = "block int, n int, lo long, hi long, entries binary, run int, slot int"
POSITIONS = -1  # the slot that holds no entries but the positions of an Arrow batch's rows
SMALL_GROUP = 1024  # new rows of a subtree that are all compared with each other in the first search
PAIRS_AT_ONCE = 1 << 21
FEW_ENTRIES = 1 << 19  # new entries (24 bytes each) are broadcast to what they are searched in up to this number
FEW_SHARE = 1 / 8  # of history, below which only the blocks that new entries hit are brought to them


def depth_for(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix at which a pair just at the threshold shares a subtree of some tree with this probability."""
    for depth in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def sketch_floor(threshold: float) -> int:
    """Agreeing sketch bits, of 64, that a pair at the threshold falls short of about once in 500 times."""
    p = (1 + threshold) / 2
    return int(np.floor(64 * p - 2.9 * np.sqrt(64 * p * (1 - p))))


def sign(hashes: np.ndarray, size: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys[text, tree], sketch[text]) of texts with at least one shingle each."""
    starts = np.cumsum(size) - size
    steps, shifts = S.odd_numbers(trees * DEPTH, 23), S.odd_numbers(trees * DEPTH, 29)
    keys = np.zeros((len(size), trees), dtype=np.uint64)
    sketch = np.zeros(len(size), dtype=np.uint64)
    for k in range(trees * DEPTH):
        least = S.mix(np.minimum.reduceat((hashes ^ shifts[k]) * steps[k], starts))
        keys[:, k // DEPTH] = (keys[:, k // DEPTH] << np.uint64(DIGIT)) | (least >> np.uint64(64 - DIGIT))
        if k < 64:
            sketch |= (least & np.uint64(1)) << np.uint64(k)
    return keys, sketch


def located(new: np.ndarray, old: np.ndarray, depth: int, floor: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, agreeing bits, rows that had more) between new entries and the sorted old ones: widening range
    search. No more than ``PAIRS_AT_ONCE`` pairs and ``most`` links a row are held beside the new links of a few steps."""
    none = np.zeros(0, np.int64)
    kept, more, fresh, held = (none, none, none), [none], [], 0
    done_lo = done_hi = None

    def limited() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        *links, left_out = strongest(*(np.concatenate(x) for x in zip(kept, *fresh)), most)
        more[0] = np.union1d(more[0], left_out)
        return tuple(links)

    for d in range(DEPTH, depth - 1, -1):
        shift = np.uint64(DIGIT * (DEPTH - d))
        prefix = new["key"] >> shift
        lo = np.searchsorted(old["key"], prefix << shift, side="left")
        hi = np.searchsorted(old["key"], ((prefix + np.uint64(1)) << shift) - np.uint64(1), side="right")
        ranges = [(lo, hi)] if done_lo is None else [(lo, done_lo), (done_hi, hi)]
        for a, b in ranges:
            ends = np.cumsum(b - a)
            for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
                k = np.arange(start, min(start + PAIRS_AT_ONCE, int(ends[-1])))
                i = np.searchsorted(ends, k, side="right")
                j = a[i] + k - (ends[i] - (b - a)[i])
                alike = 64 - np.bitwise_count(new["sketch"][i] ^ old["sketch"][j]).astype(np.int64)
                ok = (alike >= floor) & (old["at"][j] < new["at"][i])
                fresh.append((new["at"][i[ok]], old["at"][j[ok]], alike[ok]))
                held += int(ok.sum())
                if held > PAIRS_AT_ONCE:
                    kept, fresh, held = limited(), [], 0
        done_lo, done_hi = lo, hi
    kept = limited()
    return *kept, more[0]


def linked(new: np.ndarray, depth: int, floor: int, leaders: int, small: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, rows with links left out) among new entries: at most ``most`` links a row.

    In a subtree of more than ``small`` entries the first is a leader, the rows alike to it are linked to it and set aside,
    and so on with the rest. Rows set aside, and leaders after rows were set aside, have links that were not looked for."""
    group = new["key"] >> np.uint64(DIGIT * (DEPTH - depth))
    sort = np.lexsort((new["at"], group))
    new, group = new[sort], group[sort]
    first = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - first
    none = np.zeros(0, np.int64)
    kept, fresh, partial, held = (none, none, none), [], [none], 0

    def limited() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        *links, left_out = strongest(*(np.concatenate(x) for x in zip(kept, *fresh)), most)
        partial.append(left_out)
        return tuple(links)

    few = size <= small
    own = new[few]
    for i, j in S.earlier_in_group(group[few]):
        alike = 64 - np.bitwise_count(own["sketch"][i] ^ own["sketch"][j]).astype(np.int64)
        ok = alike >= floor
        fresh.append((own["at"][i[ok]], own["at"][j[ok]], alike[ok]))
        held += int(ok.sum())
        if held > PAIRS_AT_ONCE:
            kept, fresh, held = limited(), [], 0
    for start in np.unique(first[~few]):
        rest, aside = new[start : start + size[start]], False
        for _ in range(leaders):
            if aside:
                partial.append(rest["at"][:1])
            if len(rest) < 2:
                break
            alike = 64 - np.bitwise_count(rest["sketch"][1:] ^ rest["sketch"][0]).astype(np.int64)
            ok = alike >= floor
            later = rest["at"][1:][ok]
            fresh.append((later, np.full(len(later), rest["at"][0]), alike[ok]))
            partial.append(later)
            aside = aside or len(later) > 0
            rest = rest[1:][~ok]
        else:
            partial.append(rest["at"])
    kept = limited()
    return kept[0], kept[1], np.unique(np.concatenate(partial))


def strongest(later: np.ndarray, earlier: np.ndarray, alike: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` strongest links of each row, the earlier row first among equals, and the rows that had more."""
    if not len(later):
        return later, earlier, alike, later
    sort = np.lexsort((earlier, -alike, later))
    later, earlier, alike = later[sort], earlier[sort], alike[sort]
    new = np.ones(len(later), dtype=bool)
    new[1:] = (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1])
    later, earlier, alike = later[new], earlier[new], alike[new]
    rank = np.arange(len(later)) - np.searchsorted(later, later, side="left")
    return later[rank < most], earlier[rank < most], alike[rank < most], np.unique(later[rank >= most])


class HashForest:
    """Accepted rows under sorted signatures, in runs under one folder.

    ``width`` words a shingle, ``threshold`` the likeness from which a row is a case; texts of fewer than ``min_words``
    words (null and empty ones too) are never cases and never accepted. ``trees`` and ``recall`` set the prefix length.
    ``buckets``: ranges of the key a tree is cut into; give one for every few hundred thousand expected rows (default 4,
    or what the folder has). ``block``: entries of a block. With ``exact_sketch`` no candidate is dropped by its sketch.

    The settings that shape keys and slots are kept in the folder; opening it with others raises ``ValueError``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, width: int = 5, threshold: float = 0.8, min_words: int = 0, trees: int = 16, recall: float = 0.995, buckets: int | None = None, max_runs: int = 8, block: int = 1 << 12, exact_sketch: bool = False):
        self.spark, self.folder = spark, folder or work_folder(spark, "forest")
        self.width, self.threshold, self.min_words, self.trees = width, threshold, max(min_words, width), trees
        self.depth, self.floor = depth_for(threshold, trees, recall), 0 if exact_sketch else sketch_floor(threshold)
        self.max_runs, self.block = max_runs, block
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._settled(buckets)
        self._root = f"{self.folder}/runs"
        self._fs.mkdirs(self._path(self._root))
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self._root)))
        self._runs = [f"{self._root}/{n}" for n in names if n.startswith("run=") and self._fs.exists(self._path(f"{self._root}/{n}/_SUCCESS"))]
        self._next = 1 + max((int(n.split("=")[1]) for n in names if n.startswith("run=")), default=0)

    def _settled(self, buckets: int | None) -> int:
        """The number of buckets, after the folder's settings were compared, or written where there are none."""
        at = f"{self.folder}/settings.json"
        mine = {"width": self.width, "threshold": self.threshold, "min_words": self.min_words, "trees": self.trees, "depth": self.depth, "digit": DIGIT, "signature": DEPTH, "buckets": buckets or 4}
        if self._fs.exists(self._path(at)):
            stored = json.loads(self.spark.read.text(at, wholetext=True).head()[0])
            if buckets is None:
                mine["buckets"] = stored.get("buckets")
            other = {k: (stored.get(k), v) for k, v in mine.items() if stored.get(k) != v}
            if other:
                raise ValueError(f"the forest in {self.folder} was written with other settings (stored, given): {other}")
            return stored["buckets"]
        self._fs.mkdirs(self._path(self.folder))
        out = self._fs.create(self._path(at), True)
        out.writeBytes(json.dumps(mine))
        out.close()
        return mine["buckets"]

    def runs(self, slots: list[int] | None = None) -> DataFrame:
        """All blocks, or those of some slots: only their folders are read."""
        if not self._runs:
            return self.spark.createDataFrame([], RUN)
        rows = self.spark.read.schema(RUN).option("basePath", self._root).parquet(*self._runs)
        return rows if slots is None else rows.filter(F.col("slot").isin(slots))

    def _signed(self, texts: DataFrame) -> DataFrame:
        """``SIGNED`` rows of ``texts(at, text)``: the sorted entries of each Arrow batch by slot."""
        width, least, trees, buckets, depth = self.width, self.min_words, self.trees, self.buckets, self.depth

        def sign_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes, size = S.shingle_sets(*S.word_hashes(batch.column(1).to_pylist()), width, least)
                kept = np.flatnonzero(size)
                if not len(kept):
                    continue
                keys, sketch = sign(hashes, size[kept], trees)
                at = batch.column(0).to_numpy(zero_copy_only=False)[kept].astype(np.int64)
                slot, n, blobs = [POSITIONS], [len(at)], [at.tobytes()]  # the rows of one batch are told by the first of them
                lead = min(36, DIGIT * depth)  # a bucket is a range of the leading bits of the shortest prefix: no subtree lies in two
                for t in range(trees):
                    rows = np.zeros(len(at), dtype=ENTRY)
                    rows["key"], rows["at"], rows["sketch"] = keys[:, t], at, sketch
                    rows = rows[np.argsort(rows["key"], kind="stable")]
                    home = (((rows["key"] >> np.uint64(DIGIT * DEPTH - lead)) * np.uint64(buckets)) >> np.uint64(lead)).astype(np.int64)
                    for b in np.unique(home):
                        slot.append(t * buckets + int(b))
                        own = rows[home == b]
                        n.append(len(own))
                        blobs.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(np.full(len(slot), at.min(), np.int64)), pa.array(n, pa.int32()), pa.array(blobs, pa.binary())], ["slot", "lead", "n", "entries"])

        return texts.select("at", "text").mapInArrow(sign_rows, SIGNED)

    def _candidates(self, fresh: DataFrame, since: DataFrame | None, most: int, leaders: int, small: int) -> tuple[DataFrame, DataFrame]:
        """(pairs (a, b) that may be alike, b earlier; rows ``at`` with links left out) of signed rows with the runs, with the
        signed rows ``since`` that were accepted after them, and among each other.

        Where the new rows are few beside history, they are first held against the ends of the blocks alone, and only blocks
        they hit are read; else both sides are exchanged by slot."""
        depth, floor, block = self.depth, self.floor, self.block

        def reached(entries: np.ndarray, heads: pd.DataFrame) -> Iterator[tuple[int, int]]:
            """The range of sorted entries that may share a subtree with each block."""
            shift = np.uint64(DIGIT * (DEPTH - depth))
            first = (entries["key"] >> shift) << shift
            last = first + ((np.uint64(1) << shift) - np.uint64(1))
            begin = np.searchsorted(last, heads["lo"].to_numpy().astype(np.uint64), side="left")
            return zip(begin, np.searchsorted(first, heads["hi"].to_numpy().astype(np.uint64), side="right"))

        def search(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            parts = [np.frombuffer(x, dtype=ENTRY) for x in new["entries"]]
            entries = np.concatenate(parts) if parts else np.zeros(0, ENTRY)
            later, earlier, more = linked(entries, depth, floor, leaders, small, most)
            found, sent = [np.stack([later, earlier]), np.stack([more, np.full(len(more), -1)])], []
            if len(entries) and len(known):
                entries = entries[np.argsort(entries["key"], kind="stable")]
                blobs = known["entries"] if "entries" in known else [None] * len(known)
                for run, slot, number, blob, (a, e) in zip(known["run"], known["slot"], known["block"], blobs, reached(entries, known)):
                    if blob is None:
                        sent += [(run, slot, number, entries[k : min(k + block, e)].tobytes()) for k in range(a, e, block)]
                    elif a < e:
                        later, earlier, _, more = located(entries[a:e], np.frombuffer(blob, ENTRY), depth, floor, most)
                        found += [np.stack([later, earlier]), np.stack([more, np.full(len(more), -1)])]
            a, b = np.concatenate(found, axis=1)
            out = pd.DataFrame({"a": a, "b": b, "run": -1, "slot": -1, "block": -1, "entries": None})
            if sent:
                run, slot, number, blobs = zip(*sent)
                out = pd.concat([out, pd.DataFrame({"a": -1, "b": -1, "run": run, "slot": slot, "block": number, "entries": blobs})], ignore_index=True)
            return out

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.zeros((2, 0), np.int64)]
                for mine, theirs in zip(batch.column(0), batch.column(1)):
                    later, earlier, _, more = located(np.frombuffer(mine.as_py(), ENTRY), np.frombuffer(theirs.as_py(), ENTRY), depth, floor, most)
                    found += [np.stack([later, earlier]), np.stack([more, np.full(len(more), -1)])]
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        own = fresh.filter("slot >= 0")
        per_slot = own.groupBy("slot").agg(F.sum("n").alias("n")).collect()  # trees x buckets at most
        slots, entries = [r["slot"] for r in per_slot], sum(r["n"] for r in per_slot)
        known = self.runs(slots if 2 * len(slots) <= self.trees * self.buckets else None)
        heads = known.select("run", "slot", "block", "n", "lo", "hi")
        few = entries < FEW_SHARE * (heads.agg(F.sum("n")).head()[0] or 0)
        sides = own.select("slot", "entries").groupBy("slot").cogroup((heads if few else known).groupBy("slot"))
        found = sides.applyInPandas(search, "a long, b long, run int, slot int, block int, entries binary")
        if few:
            found = stage(found, "searched")
            sent = found.filter("run >= 0").select("run", "slot", "block", F.col("entries").alias("mine"))
            sent = F.broadcast(sent) if entries <= FEW_ENTRIES else sent
            met = sent.join(known.select("run", "slot", "block", F.col("entries").alias("theirs")), ["run", "slot", "block"])
            found = found.filter("run < 0").select("a", "b").unionByName(met.select("mine", "theirs").mapInArrow(meet, "a long, b long"))
        found = found.select("a", "b")
        if since is not None and entries <= FEW_ENTRIES:
            mine = F.broadcast(own.select("slot", F.col("entries").alias("mine")))
            met = since.filter("slot >= 0").select("slot", F.col("entries").alias("theirs")).join(mine, "slot")
            found = found.unionByName(met.select("mine", "theirs").mapInArrow(meet, "a long, b long"))
        elif since is not None:
            packed = self._packed(since, self._next).select("run", "slot", "block", "n", "lo", "hi", "entries")
            met = own.select("slot", "entries").groupBy("slot").cogroup(packed.groupBy("slot")).applyInPandas(search, "a long, b long, run int, slot int, block int, entries binary")
            found = found.unionByName(met.select("a", "b"))
        found = stage(found.distinct(), "candidates")
        return found.filter("b >= 0"), found.filter("b < 0").select(F.col("a").alias("at"))

    def _without(self, signed: DataFrame, gone: DataFrame) -> DataFrame:
        """Signed rows without those of ``gone(at)``."""

        def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lead, entries in zip(*(batch.column(k).to_pylist() for k in range(2))):
                    at = np.frombuffer(entries, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lead, np.int64)), pa.array(at.copy())], ["lead", "at"])

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blobs = []
                for entries, out in zip(*(batch.column(k).to_pylist() for k in (3, 4))):
                    if out:
                        rows = np.frombuffer(entries, ENTRY)
                        entries = rows[~np.isin(rows["at"], np.array(out))].tobytes()
                    blobs.append(entries)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(blobs, pa.binary())], ["slot", "lead", "n", "entries"])

        homes = signed.filter(f"slot = {POSITIONS}").select("lead", "entries").mapInArrow(positions, "lead long, at long")
        lost = homes.join(gone, "at", "left_semi").groupBy("lead").agg(F.collect_list("at").alias("gone"))  # rows of one Arrow batch
        return signed.filter("slot >= 0").join(lost, "lead", "left").select("slot", "lead", "n", "entries", "gone").mapInArrow(drop, SIGNED)

    def _packed(self, entries: DataFrame, run: int) -> DataFrame:
        """``RUN`` rows of ``entries(slot, entries)``: the entries of a slot, sorted, in blocks."""
        size = self.block

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in pdf["entries"]])
            rows = rows[np.argsort(rows["key"], kind="stable")]
            blocks = [rows[k : k + size] for k in range(0, len(rows), size)]
            ends = np.array([(b["key"][0], b["key"][-1]) for b in blocks], dtype=np.int64).reshape(-1, 2)
            return pd.DataFrame({"block": range(len(blocks)), "n": [len(b) for b in blocks], "lo": ends[:, 0], "hi": ends[:, 1], "entries": [b.tobytes() for b in blocks], "run": run, "slot": pdf["slot"].iloc[0]})

        return entries.filter("slot >= 0").select("slot", "entries").groupBy("slot").applyInPandas(pack, RUN)

    def _write(self, packed: DataFrame) -> None:
        path = f"{self._root}/run={self._next}"
        packed.drop("run").write.option("compression", "zstd").partitionBy("slot").mode("overwrite").parquet(path)
        self._runs.append(path)
        self._next += 1

    def add(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """Settle the rows of ``batch(at, text)`` and take the accepted ones into the forest.

        ``at`` is the position in the order (see ``position``) and later than all of history; ``texts(at, text)`` gives
        the texts of history and batch for verification. Returns ``(at, of)``: the cases, with the position of a row
        they repeat (for copies within the batch the first of them).
        """
        batch = batch.select("at", "text")
        copies = self._copies(batch)
        firsts = batch.join(copies.select("at"), "at", "left_anti")
        own = stage(self._signed(firsts), "signed")
        fresh, accepted, near = own, None, None
        most, leaders, small = 4, 1024, SMALL_GROUP
        while True:
            pairs, partial = self._candidates(fresh, accepted, most, leaders, small)
            alike = S.with_likeness(pairs, texts, "at", "text", self.width)
            edges = stage(alike.filter(F.col("likeness") >= self.threshold - 1e-12).select("a", "b"), "edges")
            found, waiting = self._settle(edges, partial)
            near = found if near is None else near.unionByName(found)
            if waiting.isEmpty():
                break
            waiting = stage(waiting, "waiting")
            # a row linked to a case is likely to repeat what that case repeats: most of a hot group is settled so
            hops = edges.join(waiting.withColumnRenamed("at", "a"), "a", "left_semi").join(found.withColumnRenamed("at", "b"), "b").select("a", F.col("of").alias("b"))
            hops = S.with_likeness(stage(hops.distinct(), "hops"), texts, "at", "text", self.width).filter(F.col("likeness") >= self.threshold - 1e-12)
            more = stage(hops.groupBy("a").agg(F.min("b").alias("of")).withColumnRenamed("a", "at"), "found")
            near, found_now = near.unionByName(more), found.unionByName(more)
            waiting = stage(waiting.join(more.select("at"), "at", "left_anti"), "waiting")
            if waiting.isEmpty():
                break
            # what is accepted among those that wait stays with them: they are searched again among each other
            searched = waiting if accepted is None else stage(searched.join(found_now.select("at"), "at", "left_anti"), "searched-again")
            if accepted is None:
                accepted = self._without(own, stage(near.select("at").unionByName(waiting), "unsettled"))
            fresh = stage(self._signed(firsts.join(searched, "at", "left_semi")), "signed")
            most, leaders, small = most * 16, leaders * 16, small * 8
        self._write(self._packed(self._without(own, near.select("at")), self._next))
        discard(own)
        if len(self._runs) > self.max_runs:
            self.merge()
        return copies.unionByName(near)

    def _copies(self, batch: DataFrame) -> DataFrame:
        """(``at``, ``of``) of the rows whose words are those of an earlier row of the batch."""
        return stage(S.first_of_copies(S.text_prints(batch, "at", "text", self.min_words)).filter("row <> first").select(F.col("row").alias("at"), F.col("first").alias("of")), "copies")

    def _settle(self, edges: DataFrame, partial: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cases with a row they repeat, rows that these links can't settle).

        Each round accepts the rows that no open link leads back from and makes cases of the rows linked to them; the
        rest shrinks. The first open row in order is always accepted, so every round settles some.
        """
        found, open_edges = None, edges
        while True:
            waiting = open_edges.select(F.col("a").alias("b")).distinct()
            roots = open_edges.select("b").distinct().join(waiting, "b", "left_anti").join(partial.withColumnRenamed("at", "b"), "b", "left_anti")
            now = stage(open_edges.join(roots, "b", "left_semi").groupBy("a").agg(F.min("b").alias("of")).withColumnRenamed("a", "at"), "found")
            found = now if found is None else found.unionByName(now)
            if now.isEmpty():
                break
            gone = now.select("at")
            open_edges = open_edges.join(gone.withColumnRenamed("at", "a"), "a", "left_anti").join(gone.withColumnRenamed("at", "b"), "b", "left_anti")
            open_edges = stage(open_edges.select("a", "b"), "edges")
        unsettled = partial.unionByName(open_edges.select(F.col("a").alias("at"))).distinct()
        return found, unsettled.join(found.select("at"), "at", "left_anti")

    def merge(self) -> None:
        """Write all runs as one; a slot's blocks are sorted together."""
        old = list(self._runs)
        packed = self._packed(self.runs(), self._next)
        self._runs = []
        self._write(packed)
        for path in old:
            self._fs.delete(self._path(path), True)


def position(batch_col: str, row_col: str):
    """Place in the order of (batch, row) as one integer. Batches up to 2**19 - 1 and row ids up to 2**44 - 1."""
    return F.shiftleft(F.col(batch_col).cast("long"), ROW_BITS).bitwiseOR(F.col(row_col).cast("long"))


def arrivals(sizes: dict[int, int]) -> list[list[int]]:
    """Batches in order, joined into arrivals that are each at least as large as all before: the forest is then read
    about log2(n) times, not once a batch. The first batch arrives alone."""
    out: list[list[int]] = []
    total = pending = 0
    for batch in sorted(sizes):
        if not out or pending >= total:
            total, pending = total + pending, 0
            out.append([])
        out[-1].append(batch)
        pending += sizes[batch]
    return out


def repeated_rows(rows: DataFrame, batch_col: str, row_col: str, text_col: str, **settings) -> DataFrame:
    """(``row``, ``of``): all rows, batch after batch, whose text repeats one accepted earlier, and a row it repeats.

    Rows with a null batch or id have no place in the order and are left out; ids must be unique. Null, empty and too
    short texts are never cases and never accepted. Other columns are not read."""
    spark = rows.sparkSession
    all_rows = rows.select(position(batch_col, row_col).alias("at"), F.col(text_col).alias("text"), F.col(batch_col).alias("batch")).filter("at is not null")
    sizes = {r["batch"]: r["n"] for r in all_rows.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    forest = HashForest(spark, buckets=max(2, total // 300_000), **settings)
    found = spark.createDataFrame([], "at long, of long")
    for group in arrivals(sizes):
        batch = all_rows.filter(F.col("batch").isin(group))
        found = found.unionByName(forest.add(batch, all_rows.filter(F.col("batch") <= max(group))))
    low = F.lit((1 << ROW_BITS) - 1)
    return found.select(F.col("at").bitwiseAND(low).alias("row"), F.col("of").bitwiseAND(low).alias("of"))
