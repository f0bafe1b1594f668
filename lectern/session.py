"""Session helpers: a local session for tests, table reading, and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "lectern", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session with the settings the test-suite and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder, shared by all executors, for tables that cut lineage.

    It lies under ``spark.checkpoint.dir``. Only where a local session sets none (tests, the command line) is a folder of
    this machine's own taken, and then it is set for the session too; on a cluster executors would not share it, so a
    missing setting is an error there.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation of what went before."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._staged_at = path
    return made


def discard(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote and nothing reads any more."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once an application, through the shared folder. Where the workers find the
    package by themselves this changes nothing but the copy they use."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or not package.is_dir():
        return
    _SHIPPED.add(app)
    target = f"{work_folder(spark, 'package')}.zip"
    with tempfile.TemporaryDirectory() as made:
        archive = Path(made) / "package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        to = jvm_path(target)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, jvm_path(archive.as_uri()), to)
    spark.sparkContext.addPyFile(target)
