"""Null texts, versions without a marker, and scratch tables of several jobs at once."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions import fingerprints as fp
from twinfold.session import materialize, scratch
from twinfold.sources.tables import Table


def test_null_text_is_an_empty_text(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "some words here")], "id int, t string")
    rows = {r.id: r.f for r in texts.select("id", fp.fingerprint(F.col("t")).alias("f")).collect()}
    assert rows[1] == rows[2] and rows[1].buckets == [] and rows[3].n_shingles > 0
    assert {r.id: r.s for r in texts.select("id", fp.simhash(F.col("t")).alias("s")).collect()}[1] == 0


def test_interrupted_version_is_not_read(spark, tmp_path):
    schema = T.StructType([T.StructField("x", T.LongType())])
    table = Table(spark, str(tmp_path / "t"), schema)
    assert table.version() == -1 and table.read().count() == 0
    table.write(spark.createDataFrame([(1,)], schema), 0)
    # A writer that stopped after the rows and before the marker.
    spark.createDataFrame([(2,), (3,)], schema).write.parquet(f"{table.path}/version=1")
    assert table.version() == 0 and [r.x for r in table.read().collect()] == [1]
    table.write(spark.createDataFrame([(4,)], schema), 1)
    assert [r.x for r in table.read().collect()] == [4]


def test_scratch_leaves_other_jobs_alone(spark):
    other, begun, done = [], threading.Event(), threading.Event()

    def job():
        begun.wait(60)
        other.append(materialize(spark.range(3)))
        done.set()

    thread = threading.Thread(target=job)
    thread.start()
    with scratch(spark):
        materialize(spark.range(5))
        begun.set()
        assert done.wait(60)
    thread.join()
    assert other[0].count() == 3
