"""A landing folder as a stream of files into the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources.files import unfinished

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, recursive: bool = False, since: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """A stream of finished files; with ``since`` (a UTC timestamp) only of files changed after it. A file written in
    place under the same name is not read again."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", recursive).option("maxFilesPerTrigger", per_trigger).load(folder)
    stream = stream.filter(~unfinished(F.col("path")))
    return stream.filter(F.col("modificationTime") > F.lit(since).cast("timestamp")) if since else stream


class LandingZone:
    """Runs ``ingest(files)`` on every batch of arriving files; ``ingest`` returns the rows of files it could not take,
    which are kept in ``dead_letters``. Processed files are remembered in the checkpoint, so a restart continues."""

    def __init__(self, spark: SparkSession, folder: str, ingest: Callable[[DataFrame], DataFrame | None], checkpoint: str, dead_letters: str, recursive: bool = False, since: str | None = None):
        self.spark, self.folder, self.ingest = spark, folder, ingest
        self.checkpoint, self.dead_letters, self.recursive, self.since = checkpoint, dead_letters, recursive, since
        self.query: StreamingQuery | None = None

    def is_running(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self, available_now: bool = False, interval: str = "2 seconds") -> StreamingQuery:
        """Start once; a second start returns the query that runs. ``available_now`` ends when all files are taken."""
        if self.is_running():
            return self.query

        def batch(files: DataFrame, number: int) -> None:
            failed = self.ingest(files)
            if failed is not None:
                failed.write.mode("append").parquet(self.dead_letters)

        writer = arriving_files(self.spark, self.folder, self.recursive, self.since).writeStream.foreachBatch(batch).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
