"""Article and cluster tables: keyed updates, upserts, versioned storage.

A table is a log of numbered commits, each a list of data folders. Data is written to a folder of its own first; then
a complete commit file takes its number, if no other file has it. So readers never see a half-written
table, two writers never share a number, no folder is ever written twice, and a writer that dies leaves
nothing but files that no commit names. Writing a committed version again (a replayed batch) changes nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields that a repeated submission may change; features and cluster state are kept.
MUTABLE = [
    "title", "content", "publish_time", "source", "state", "top", "tags", "topic", "tag_ids", "topic_ids", "updated_at",
]



def latest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Each task keeps only its best row before the shuffle."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def merge_updates(base: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Partial update by key: the new table, and the updates whose key is unknown.

    ``updates`` has one row per key and any of the other columns. Every column it
    carries replaces the stored value, nulls included.
    """
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, F.struct(*changed).alias("_new"))
    merged = base.join(new, key, "left")
    columns = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
        for c in base.columns
    ]
    return merged.select(*columns), updates.join(base.select(key), key, "left_anti")


def upsert_articles(base: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """Idempotent submit: unknown ids become new rows, known ids take the mutable fields only.

    Repeated ids within ``incoming`` count once, the first in ``order`` winning.
    ``text_changed`` marks known ids whose text differs from the stored one; their
    fingerprints are those of the old text until they are rechecked.
    """
    latest = latest_per_key(incoming, "article_id", order)
    old = base.withColumn("_known", F.lit(True)).select(F.col("article_id"), F.struct("_known", *[c for c in base.columns if c != "article_id"]).alias("_old"))
    new = latest.select(F.col("article_id"), F.struct(*[c for c in latest.columns if c != "article_id"]).alias("_new"))
    both = old.join(new, "article_id", "full_outer")
    is_known, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    columns = [F.col("article_id")]
    for name in base.columns:
        if name == "article_id":
            continue
        stored = F.col(f"_old.{name}")
        if name not in latest.columns:
            value = stored
        elif name in MUTABLE:
            value = F.when(is_new, F.col(f"_new.{name}")).otherwise(stored)
        else:
            value = F.when(is_known, stored).otherwise(F.col(f"_new.{name}"))
        columns.append(value.alias(name))
    changed = is_known & is_new & (
        ~F.col("_old.title").eqNullSafe(F.col("_new.title")) | ~F.col("_old.content").eqNullSafe(F.col("_new.content"))
    )
    return both.select(*columns, (is_new & ~is_known).alias("is_new"), changed.alias("text_changed"))


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """Point read; the filter reaches the Parquet scan."""
    return table.where(F.col(key) == value)


class Conflict(RuntimeError):
    """Another writer has committed what this one did not see."""


class Table:
    """A versioned Parquet table below ``path``.

    A number is taken by a rename that fails if the target exists (HDFS), on local disks by a hard link;
    stores without such a step need one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        context = spark.sparkContext
        self._jvm = context._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(context._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _publish(self, version: int, folders: list[str]) -> bool:
        """Make a commit that appears whole; false if the number is taken."""
        target = self._path(f"_log/{version:012d}.commit")
        draft = self._path(f"_log/{version:012d}.{uuid.uuid4().hex}.draft")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        try:
            if self._files.getUri().getScheme() != "file":
                return self._files.rename(draft, target)
            link, whole = (self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft))
            try:
                self._jvm.java.nio.file.Files.createLink(link, whole)
            except Py4JJavaError as error:
                if "FileAlreadyExists" in error.java_exception.getClass().getName():
                    return False
                raise
            return True
        finally:
            self._files.delete(draft, False)

    def _stored(self, rows: DataFrame, version: int) -> str:
        """Write rows to a folder of their own."""
        folder = f"version={version}/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        return folder

    def folders(self, version: int | None = None) -> list[str]:
        """The data folders of a version, by default of the newest one."""
        version = self.version() if version is None else version
        if version < 0:
            return []
        source = self._files.open(self._path(f"_log/{version:012d}.commit"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))["folders"]
        finally:
            source.close()

    def write(self, rows: DataFrame, version: int) -> None:
        """Make ``rows`` the whole content as ``version``; one that is committed already stays as it is."""
        if version not in self.versions():
            self._publish(version, [self._stored(rows, version)])

    def replace(self, rows: DataFrame, seen: int) -> int:
        """Make ``rows`` the whole content, unless a version after ``seen`` has been committed; the new version."""
        if not self._publish(seen + 1, [self._stored(rows, seen + 1)]):
            raise Conflict(f"version {self.version()} has been committed after version {seen}")
        return seen + 1

    def append(self, rows: DataFrame) -> int:
        """Add rows to what is committed, whoever commits meanwhile; the new version. Data is written once."""
        folder = self._stored(rows, self.version() + 1)
        while True:
            seen = self.version()
            if self._publish(seen + 1, [*self.folders(seen), folder]):
                return seen + 1

    def versions(self) -> list[int]:
        """The committed versions in rising order."""
        found = self._files.globStatus(self._path("_log/*.commit"))
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found or [])

    def version(self) -> int:
        """The newest committed version, or -1 when there is none."""
        return max(self.versions(), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        found = self.folders(version)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in found])

    def compact(self, by: str, files: int = 1) -> int:
        """The same rows in ``files`` files of one folder, sorted by ``by``, so that a lookup by it opens few of them."""
        seen = self.version()
        rows = self.read(seen)
        return self.replace(rows.repartitionByRange(files, by).sortWithinPartitions(by), seen)

    def clear(self, confirm: bool = False) -> None:
        """Replace the content by an empty table; older versions stay on disk."""
        if not confirm:
            raise ValueError("clearing a table needs confirm=True")
        seen = self.version()
        self.replace(self.spark.createDataFrame([], self.schema), seen)
