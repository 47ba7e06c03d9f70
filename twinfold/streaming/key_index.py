"""Rows found by key in a store that grows with every batch, without opening the files that hold none of them.

Each batch adds one run: its rows, sorted by a hash of their key and laid into one folder per leading part of the
hash, and a filter with one 64-bit word for about four keys, in which each of them sets four bits. A search asks the
filters first and opens only parts that may hold one of its keys.

Runs are merged by ``FANOUT``: before batch 8 the runs 0..7, before batch 64 the runs 0..63. So at most seven runs per
power of eight stand beside each other, and a row is written once per power. The filter of a run is written last and makes
it complete; a run that lies within another one does not count. So a job that dies in between loses nothing.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.operators.joins import keep_ids
from twinfold.session import materialize

FANOUT = 8
# Rows of a part, and about those of a writing task.
PART_ROWS = 1_000_000
KEYS_A_WORD, BITS_A_KEY = 4, 4


def key_hash(kind: str, *values: str) -> Column:
    """What a key is stored and searched under."""
    return F.xxhash64(F.lit(kind), *values).alias("h")


def _mask() -> Column:
    """The bits that a key sets in its filter word."""
    spread = F.xxhash64("h", F.lit(1))
    bits = [F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS_A_KEY)]
    one = F.lit(1).cast("long")
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, bit) for bit in bits])


class Run(NamedTuple):
    """Rows of the batches ``first`` to ``last`` in 2^bits parts, with ``words`` filter words for each part."""

    first: int
    last: int
    bits: int
    words: int

    @property
    def name(self) -> str:
        return f"run={self.first}.{self.last}.{self.bits}.{self.words}"

    def part(self) -> Column:
        return F.shiftrightunsigned("h", 64 - self.bits).cast("int") if self.bits else F.lit(0)

    def word(self) -> Column:
        return F.pmod(F.xxhash64("h", F.lit(2)), F.lit(self.words)).cast("int")


class KeyIndex:
    """Rows of ``schema`` under ``h``, a hash of kind and key, and ``kind``.

    Null keys have a hash like any other; a search may return rows of another key only if all 64 bits agree.
    Batches are numbered from 0 and come in order. A batch that is added again replaces its run, or changes nothing if
    that has been merged already: batch k is made from earlier ones only, so its rows are the same.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part_rows: int = PART_ROWS):
        fields = [T.StructField("kind", T.StringType()), T.StructField("h", T.LongType()), *schema.fields, T.StructField("batch", T.IntegerType())]
        self.spark, self.path, self.schema, self.part_rows = spark, path.rstrip("/"), T.StructType(fields), part_rows
        context = spark.sparkContext
        self._path = lambda name: context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._files = self._path("").getFileSystem(context._jsc.hadoopConfiguration())

    def _complete(self) -> list[Run]:
        found = self._files.globStatus(self._path("run=*/filter/_SUCCESS")) or []
        names = [s.getPath().getParent().getParent().getName() for s in found]
        return sorted((Run(*map(int, n.split("=")[1].split("."))) for n in names), key=lambda r: (r.first, -r.last))

    def runs(self) -> list[Run]:
        """The runs that count, in order of their batches."""
        counted: list[Run] = []
        for run in self._complete():
            if not counted or run.first > counted[-1].last:
                counted.append(run)
        return counted

    def add(self, rows: DataFrame, batch: int) -> None:
        """Store the rows of one batch, first merging the runs that are due."""
        if any(r.first <= batch <= r.last and r.last > r.first for r in self.runs()):
            return
        self._merge(batch)
        self._store(rows.withColumn("batch", F.lit(batch)), batch, batch)

    def _merge(self, batch: int) -> None:
        span = FANOUT
        while batch and batch % (span * FANOUT) == 0:
            span *= FANOUT
        if not batch or batch % span:
            return
        due = [r for r in self.runs() if batch - span <= r.first and r.last < batch]
        if len(due) > 1:
            self._store(self._read([f"{r.name}/rows" for r in due]), batch - span, batch - 1)
            for run in self._complete():
                if run not in self.runs():
                    self._files.delete(self._path(run.name), True)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*[f"{self.path}/{f}" for f in folders])

    def _store(self, rows: DataFrame, first: int, last: int) -> None:
        for old in self._complete():
            if (old.first, old.last) == (first, last):
                self._files.delete(self._path(f"{old.name}/filter"), True)
                self._files.delete(self._path(old.name), True)
        stored = materialize(rows.select(*self.schema.names))
        n, keys = stored.agg(F.count("*"), F.approx_count_distinct("h")).first()
        if not n:
            return
        bits = max(0, math.ceil(math.log2(n / self.part_rows)))
        run = Run(first, last, bits, max(1, math.ceil(keys / KEYS_A_WORD / 2**bits)))
        # The content decides between rows of one key, so a hot key lies in many tasks and files.
        content = F.xxhash64(*self.schema.names)
        placed = stored.withColumn("part", run.part()).withColumn("_content", content)
        placed = placed.repartitionByRange(math.ceil(n / self.part_rows), "part", "h", "_content")
        placed.sortWithinPartitions("part", "h").drop("_content").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{run.name}/rows")
        words = stored.select(run.part().alias("part"), run.word().alias("word"), _mask().alias("mask"))
        words.groupBy("part", "word").agg(F.bit_or("mask").alias("word_bits")).write.mode("overwrite").parquet(f"{self.path}/{run.name}/filter")

    def folders(self, wanted: DataFrame, before: int) -> list[str]:
        """The parts, in runs with batches below ``before``, that may hold a hash of the stored ``wanted``."""
        asked = []
        for run in self.runs():
            if run.first >= before:
                continue
            keys = wanted.select(F.lit(run.name).alias("run"), run.part().alias("part"), run.word().alias("word"), _mask().alias("mask"))
            bits = self.spark.read.parquet(f"{self.path}/{run.name}/filter")
            hit = keys.join(bits, ["part", "word"]).where(F.col("mask").bitwiseAND(F.col("word_bits")) == F.col("mask"))
            asked.append(hit.select("run", "part"))
        if not asked:
            return []
        hits = reduce(DataFrame.unionByName, asked).distinct().collect()  # names of folders, as any list of files
        return sorted(f"{r.run}/rows/part={r.part}" for r in hits)

    def find(self, wanted: DataFrame, before: int) -> DataFrame:
        """Rows of batches below ``before`` whose hash is among ``wanted`` (``h``), stored."""
        keys = materialize(wanted.select("h").distinct())
        rows = self._read(self.folders(keys, before)).where(F.col("batch") < before)
        return materialize(keep_ids(rows, keys, "h"))
