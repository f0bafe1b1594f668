"""Keyed tables with last-write-wins upserts, as runs of Parquet files under one folder.

A write adds one run: the rows of the batch, the last of each key, numbered by the write. Reading takes of each key the
row of the latest run; a delete is a run of marks. So a write costs what it brings and never rewrites the table; runs are
merged once there are more than ``max_runs``. A run becomes visible when its folder is renamed into place, and a reader
works on the runs it listed, so nothing is read while it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNKS = "vector_id string, source string, page int, chunk_index int, content string, metadata_json string, ingested_at string"
VECTORS = "vector_id string, vector array<float>, text string, source string, page int, total_pages int, chunk_index int, chunk_total int"


def last_of_each(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row a key: the last by ``order``, in a batch without one by the order of its rows."""
    rows = rows.withColumn("_order", order if order is not None else F.monotonically_increasing_id())
    first = Window.partitionBy(key).orderBy(F.desc("_order"))
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank", "_order")


class KeyedTable:
    """``ensure``-ed on construction: the folder and an empty table exist afterwards."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = CHUNKS, key: str = "vector_id", max_runs: int = 16):
        self.spark, self.folder, self.key, self.max_runs = spark, folder.rstrip("/"), key, max_runs
        self.schema = StructType.fromDDL(schema)
        self._stored = StructType.fromDDL(f"{schema}, _gone boolean")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def runs(self) -> list[str]:
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        merged = [n for n in names if n.startswith("run-") and n.endswith("-all")]
        return [n for n in names if n.startswith("run-") and (not merged or n >= merged[-1])]

    def _write(self, rows: DataFrame, suffix: str = "") -> None:
        known = [int(n.split("-")[1]) for n in self.runs()]
        name = f"run-{max(known, default=0) + 1:08d}{suffix}"
        rows.select(*self._stored.names).write.mode("overwrite").parquet(f"{self.folder}/_tmp-{name}")
        if not self._fs.rename(self._path(f"{self.folder}/_tmp-{name}"), self._path(f"{self.folder}/{name}")):
            raise RuntimeError(f"another writer took {name}")

    def _stacked(self, names: list[str]) -> DataFrame:
        parts = None
        for name in names:
            one = self.spark.read.schema(self._stored).parquet(f"{self.folder}/{name}").withColumn("_run", F.lit(int(name.split("-")[1])))
            parts = one if parts is None else parts.unionByName(one)
        return parts if parts is not None else self.spark.createDataFrame([], self._stored).withColumn("_run", F.lit(0))

    def read(self, where: Column | None = None) -> DataFrame:
        """The current rows. ``where`` must be a condition on the key; it reaches the Parquet scans of all runs."""
        names = self.runs()
        rows = self._stacked(names)
        if where is not None:
            rows = rows.filter(where)
        if len(names) > 1:
            rows = last_of_each(rows, self.key, F.col("_run"))
        return rows.filter("not _gone").select(*self.schema.names)

    def upsert(self, rows: DataFrame, order: Column | None = None) -> int:
        """Insert or replace by key; within the batch the last wins. Returns the number of rows given, repeats included."""
        given = rows.select(*self.schema.names).cache()
        try:
            n = given.count()
            if n:
                self._write(last_of_each(given, self.key, order).withColumn("_gone", F.lit(False)))
        finally:
            given.unpersist()
        if len(self.runs()) > self.max_runs:
            self.compact()
        return n

    def delete(self, condition: Column) -> int:
        """Remove the current rows that meet the condition; returns how many there were."""
        return self._mark(self.read().filter(condition))

    def _mark(self, rows: DataFrame) -> int:
        gone = rows.cache()
        n = gone.count()
        if n:
            self._write(gone.withColumn("_gone", F.lit(True)))
        gone.unpersist()
        return n

    def compact(self) -> None:
        """Write the current rows as one run and drop the older ones."""
        old = self.runs()
        self._write(self.read().withColumn("_gone", F.lit(False)), "-all")
        for name in old:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def get(self, key: str) -> DataFrame:
        return self.read(F.col(self.key) == key)

    def by_source(self, source: str) -> DataFrame:
        """Rows of one source (case counts), by page and chunk."""
        return self._of_source(F.col("source") == source).orderBy("page", "chunk_index")

    def delete_by_source(self, source: str) -> int:
        return self._mark(self._of_source(F.col("source").eqNullSafe(source)))

    def _of_source(self, condition: Column) -> DataFrame:
        """Current rows that meet a condition on other columns than the key. The condition reaches the scans first: only the
        keys that ever met it take part in finding the last write."""
        names = self.runs()
        rows = self._stacked(names)
        if len(names) > 1:
            keys = rows.filter(condition).select(self.key).distinct()
            rows = last_of_each(rows.join(keys, self.key, "left_semi"), self.key, F.col("_run"))
        return rows.filter(condition & ~F.col("_gone")).select(*self.schema.names)


def chunk_rows(chunks: DataFrame, key: Column) -> DataFrame:
    """Rows of the chunk table of ``chunks``, with all other columns as JSON in ``metadata_json``."""
    rest = [c for c in chunks.columns if c not in ("page_content", "vector")]
    at = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in chunks.columns else F.lit(d)
    return chunks.select(
        key.alias("vector_id"), at("source", "unknown").alias("source"), at("page", 0).alias("page"), at("chunk_index", 0).alias("chunk_index"),
        F.col("page_content").alias("content"), F.to_json(F.struct(*rest)).alias("metadata_json"), at("ingested_at", "").alias("ingested_at"),
    )


def vector_rows(chunks: DataFrame, key: Column) -> DataFrame:
    """Rows of the vector table of embedded ``chunks``."""
    return chunks.select(key.alias("vector_id"), "vector", F.col("page_content").alias("text"), "source", "page", "total_pages", "chunk_index", "chunk_total")
