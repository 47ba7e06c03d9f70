"""Small helpers that several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.session import records_per_batch  # noqa: F401

# Rows per Arrow batch. Texts can be very long, so batches have few rows.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows; keeps a smaller setting of the caller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fold(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast an object of this package's classes, which workers need not have installed."""
    return spark.sparkContext.broadcast([cloudpickle.dumps(value)])


def shared(sent: Broadcast) -> Any:
    """The object in a task. It lives as long as the worker, so what it remembers serves later tasks too."""
    holder = sent.value
    if isinstance(holder[0], bytes):
        holder[0] = pickle.loads(holder[0])
    return holder[0]


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A bounded result on the driver, as arrays without an object per row."""
    rows = df.toArrow()
    return {c: rows[c].to_numpy() for c in rows.column_names}


def as_bytes(texts: pd.Series) -> Iterator[bytes]:
    """UTF-8 of each text; null is empty."""
    for text in texts:
        yield text.encode() if text else b""


def grouped(items: Iterable, size: Iterable[int], limit: int) -> Iterator[list]:
    """Consecutive items whose sizes add up to about ``limit``."""
    held, total = [], 0
    for item, n in zip(items, size):
        held.append(item)
        total += n
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
