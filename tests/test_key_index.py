"""The index of stored rows by key: whole answers, few files, merged runs, replays and interrupted jobs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.session import materialize
from twinfold.streaming.key_index import FANOUT, KeyIndex, key_hash

SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.StringType())])


def batch_rows(spark, keys):
    rows = spark.createDataFrame([(k, f"v{k}") for k in keys], SCHEMA)
    return rows.select(F.lit("k").alias("kind"), key_hash("k", "key"), "key", "value")


def ask(spark, index, keys, before):
    wanted = spark.createDataFrame([(k,) for k in keys], "key bigint").select(key_hash("k", "key"))
    return sorted((r.key, r.batch) for r in index.find(wanted, before).collect())


def opened(spark, index, keys, before):
    wanted = materialize(spark.createDataFrame([(k,) for k in keys], "key bigint").select(key_hash("k", "key")))
    return len(index.folders(wanted, before))


def test_finds_all_and_only_what_was_stored(spark, tmp_path):
    rng = random.Random(5)
    index, stored = KeyIndex(spark, str(tmp_path / "i"), SCHEMA, part_rows=40), []
    for batch in range(FANOUT + 2):
        keys = [rng.randrange(500) for _ in range(30)] + [7] * 100  # one key holds most rows
        index.add(batch_rows(spark, keys), batch)
        stored += [(k, batch) for k in keys]
    assert [(r.first, r.last) for r in index.runs()] == [(0, FANOUT - 1), (FANOUT, FANOUT), (FANOUT + 1, FANOUT + 1)]
    asked = [7, *range(0, 500, 9), 1000]
    for before in (0, 3, FANOUT + 2):
        assert ask(spark, index, asked, before) == sorted(r for r in stored if r[0] in asked and r[1] < before)
    assert ask(spark, index, [], 99) == []


def test_files_opened_grow_with_hits_and_not_with_history(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), SCHEMA, part_rows=500)
    for batch in range(4):
        index.add(batch_rows(spark, range(batch * 4_000, batch * 4_000 + 4_000)), batch)
        if batch == 0:
            early = opened(spark, index, [1, 2], 99)
    parts = sum(2**r.bits for r in index.runs())
    assert parts == 32 and early <= 3
    # Two keys of batch 0, however much has come since: their parts, and seldom one that holds neither.
    assert opened(spark, index, [1, 2], 99) <= 4
    assert opened(spark, index, [-1, -2, -3], 99) <= 2
    assert opened(spark, index, range(0, 16_000, 7), 99) == parts


def test_replayed_and_interrupted_batches(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), SCHEMA, part_rows=10)
    for batch in range(FANOUT):
        index.add(batch_rows(spark, [batch, 100 + batch]), batch)
    last = FANOUT - 1
    index.add(batch_rows(spark, range(50, 90)), last)  # other rows, another number of parts
    assert ask(spark, index, [last, 50], 99) == [(50, last)]
    index.add(batch_rows(spark, []), last)
    assert ask(spark, index, [last, 50], 99) == []
    index.add(batch_rows(spark, [last]), last)
    # A run without its filter does not count.
    half = tmp_path / "i" / f"run=0.{last}.0.1" / "rows"
    half.mkdir(parents=True)
    assert len(index.runs()) == FANOUT
    index.add(batch_rows(spark, [5]), FANOUT)
    assert [(r.first, r.last) for r in index.runs()] == [(0, last), (FANOUT, FANOUT)]
    index.add(batch_rows(spark, [999]), 3)  # merged already
    assert ask(spark, index, [3, 5, 999], 99) == [(3, 3), (5, 5), (5, FANOUT)]


def test_empty_index(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), SCHEMA)
    assert index.runs() == [] and ask(spark, index, [1], 5) == []
    index.add(batch_rows(spark, []), 0)
    assert ask(spark, index, [1], 5) == []
