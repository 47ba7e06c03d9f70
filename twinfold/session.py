"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on; each only replaces the value Spark ships with.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts can be 200,000 characters: keep Arrow batches small enough for a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def records_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` for the jobs run inside the block; the caller's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def local_session(cores: str = "*", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("twinfold")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="twinfold-")
    context.setCheckpointDir(folder)
    return folder


# The tables that the innermost open block of this thread has to delete.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that this thread materializes inside the block when it ends.

    Jobs of other threads keep theirs.
    """
    mine: list[str] = []
    outer = _held.set(mine)
    try:
        yield
    finally:
        _held.reset(outer)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in mine:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive a lost executor, and gives the
    planner exact sizes, so that it broadcasts only what is small in fact.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/twinfold/{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = _held.get()
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)
