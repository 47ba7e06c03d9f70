"""Nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random and keeps the sign of each component: one bit per
dimension, packed, and one correction scalar, the inner product of the vector with its code.
The inner product with a query is estimated from the rotated query and the bits; its error
is bounded by ``epsilon * sqrt(1 / scalar^2 - 1) / sqrt(d - 1)`` but for a tail that falls like
``exp(-epsilon^2 / 2)``, whatever the data, because the rotation is random. Only vectors whose upper
bound reaches the queries' fifth-best exact value so far are compared in full precision.

The index is a table of blocks of vectors with codes, scalars and originals. Queries are
cut into blocks too; every pair of a query block and an index block is one unit of
work that gives each query's best few, and a ranking over the units gives the best of all.

Edge cases: a vector that is null, empty, zero, or holds a null or non-finite component takes no
part, nor does a null vec_id. Vectors of different lengths are never compared. Ties go to the smaller
vec_id; rows with equal ids are candidates of their own, but not for a query of their id. With
fewer candidates than ``k`` all are returned. An empty table gives no rows. Only ``vec_id`` and
``embedding`` are read; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import grouped, records_per_batch
from twinfold.llm.vectors import cosines, is_usable, unit_rows
from twinfold.session import materialize

EPSILON = 3.5
SEED = 7
_BLOCK = 4096  # vectors of an index block
_QUERIES = 1024  # queries of a query block
_STRIP = 64  # queries estimated at a time

_BLOCK_SCHEMA = "block long, size int, vec_ids array<long>, codes binary, scalars binary, originals binary"


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(rows: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and each one's inner product with its code."""
    turned = unit_rows(rows) @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(rows.shape[1])


def _blocks(vectors: DataFrame, limit: int, with_codes: bool) -> DataFrame:
    """Rows of ``(vec_id, embedding)`` as blocks of vectors of one length."""
    usable = vectors.where(F.col("vec_id").isNotNull() & is_usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for held in grouped(*_twice(batches), limit):
            whole = pa.Table.from_batches(held).combine_chunks()
            column = whole["embedding"].combine_chunks()
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
            first = np.cumsum(lengths) - lengths
            ids = whole["vec_id"].combine_chunks().to_numpy()
            for size in np.unique(lengths):
                of_size = np.flatnonzero(lengths == size)
                for at in range(0, len(of_size), limit):
                    chosen = of_size[at : at + limit]
                    rows = flat[first[chosen][:, None] + np.arange(size)]
                    codes, scalars = encode(rows, rotation(int(size))) if with_codes else (np.zeros(0, np.uint8), np.zeros(0))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part << 32 | number], type=pa.int64()), pa.array([size], type=pa.int32()),
                            pa.array([ids[chosen]], type=pa.list_(pa.int64())),
                            *[pa.array([x.tobytes()], type=pa.binary()) for x in (codes, scalars, rows)],
                        ],
                        names=[c.split()[0] for c in _BLOCK_SCHEMA.split(", ")],
                    )
                    number += 1

    return usable.mapInArrow(cut, _BLOCK_SCHEMA)


def _twice(batches: Iterator[pa.RecordBatch]) -> tuple[Iterator[pa.RecordBatch], Iterator[int]]:
    from itertools import tee

    one, other = tee(batches)
    return one, (b.num_rows for b in other)


def index(vectors: DataFrame) -> DataFrame:
    """The index of every usable vector, as a stored table."""
    return materialize(_blocks(vectors, _BLOCK, True))


def best_of_block(queries: tuple, block: tuple, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, block row, cosine)`` of each query's ``k`` best in a block; may hold some more."""
    query_ids, query_rows = queries
    ids, codes, scalars, rows = block
    size = rows.shape[1]
    unit_queries, units = unit_rows(query_rows), unit_rows(rows).astype(np.float32)
    turned = (unit_queries @ rotation(size)).astype(np.float32)
    unit_queries = unit_queries.astype(np.float32)
    signs = (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))
    scale = (1 / scalars).astype(np.float32)
    slack = (epsilon * np.sqrt(np.maximum(1 / scalars**2 - 1, 0)) / math.sqrt(max(size - 1, 1)) + 1e-5).astype(np.float32)
    found = []
    for at in range(0, len(query_ids), _STRIP):
        strip = slice(at, min(at + _STRIP, len(query_ids)))
        guess = (turned[strip] @ signs.T) * scale
        own = ids[None, :] == query_ids[strip, None]
        guess[own] = -np.inf
        # The exact values of those that look best bound each query's k-th best from below.
        some = min(4 * k, len(ids))
        likely = np.argpartition(guess, len(ids) - some, axis=1)[:, len(ids) - some :]
        n = len(guess)
        exact = cosines(np.repeat(query_rows[strip], some, axis=0), rows[likely.ravel()]).reshape(n, some)
        exact[np.take_along_axis(own, likely, axis=1)] = -np.inf
        least = np.sort(exact, axis=1)[:, max(some - k, 0)] if some >= k else np.full(n, -np.inf)
        q, v = np.nonzero((guess + slack >= least[:, None].astype(np.float32) - np.float32(1e-5)) & ~own)
        # In single precision first; what may still be among the best is computed exactly.
        close = np.einsum("ij,ij->i", unit_queries[strip][q], units[v]) >= least[q] - 1e-5
        q, v = q[close], v[close]
        score = cosines(query_rows[strip][q], rows[v])
        better = score >= least[q]
        found.append((q[better] + at, v[better], score[better]))
    return tuple(map(np.concatenate, zip(*found)))


def search(vectors: DataFrame, is_query: Column, k: int = 5, epsilon: float = EPSILON) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows where ``is_query`` holds, the ``k`` nearest other rows."""
    spark = vectors.sparkSession
    blocks = index(vectors)
    asked = materialize(_blocks(vectors.where(is_query), _QUERIES, False))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Every query block meets every index block of its vector length: both sides name the pair.
    numbers = asked.groupBy("size").agg(F.collect_list("block").alias("asked"))
    mine = blocks.join(numbers, "size").withColumn("query_block", F.explode("asked")).drop("asked")
    their_numbers = blocks.groupBy("size").agg(F.collect_list("block").alias("blocks"))
    theirs = asked.join(their_numbers, "size").select(
        F.col("block").alias("query_block"), F.explode("blocks").alias("block"),
        F.col("vec_ids").alias("query_ids"), F.col("originals").alias("query_rows"),
    )
    pairs = mine.join(theirs, ["query_block", "block"])
    schema = "query_id long, vec_id long, score double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                size = one["size"].as_py()
                queries = (one["query_ids"].values.to_numpy(), np.frombuffer(one["query_rows"].as_buffer()).reshape(-1, size))
                ids = one["vec_ids"].values.to_numpy()
                codes = np.frombuffer(one["codes"].as_buffer(), dtype=np.uint8).reshape(len(ids), -1)
                block = (ids, codes, np.frombuffer(one["scalars"].as_buffer()), np.frombuffer(one["originals"].as_buffer()).reshape(-1, size))
                q, v, score = best_of_block(queries, block, k, epsilon)
                # The best k of this block: by query, then falling score, then id.
                order = np.lexsort((ids[v], -score, q))
                q, v, score = q[order], v[order], score[order]
                new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, dtype=bool)
                rank = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
                best = rank < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[0][q[best]]), pa.array(ids[v[best]]), pa.array(score[best])],
                    names=["query_id", "vec_id", "score"],
                )

    # A pair is some megabytes; a few at a time are in one Arrow batch.
    with records_per_batch(spark, 8):
        near = materialize(pairs.repartition(parts, "query_block", "block").mapInArrow(compare, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
