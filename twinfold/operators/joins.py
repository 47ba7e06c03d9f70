"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.session import materialize

# A key with more rows than this is cut into pieces of about this many rows. No more
# than (all rows / HOT_ROWS) keys can be that large, so their list can be broadcast.
HOT_ROWS = 1_000_000


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    size: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    total: int | None = None,
    *,
    repeated: bool = False,
) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row per key and the key's row count in ``size``.

    With ``repeated`` a key may have several rows of equal ``size``.

    Rows of a hot key get a salt from their own content (so a re-run task gives
    the same rows), one salt per ``hot_rows`` rows; the group's single row is repeated
    once per salt. Rows with a
    null key match nothing and are spread over all tasks. ``total`` is a known bound of
    the number of rows; within ``hot_rows`` no key can be hot and the join is a plain one.
    """
    if total is not None and total <= hot_rows:
        return rows.join(groups, keys, how)
    salts = F.ceil(F.col(size) / F.lit(hot_rows)).cast("int")
    hot = groups.where(F.col(size) > hot_rows).select(*keys, salts.alias("_salts"))
    hot = hot.distinct() if repeated else hot
    content = F.xxhash64(*rows.columns)
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    salt = F.when(no_key, F.pmod(content, F.lit(1 << 20))).otherwise(F.pmod(content, F.coalesce("_salts", F.lit(1))))
    salted_rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    salted_groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted_rows.join(salted_groups, [*keys, "_salt"], how).drop("_salt")


def rank_within(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, their place from 1 within ``key``, whatever a key's size; ``order`` must be total.

    Rows are range-partitioned by key and order, so a large key lies in many partitions.
    A row's rank is its place in its partition plus the key's rows in earlier partitions.
    """
    placed = materialize(rows.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy(key, "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(key, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(key, "_p").orderBy(*order))
    ranked = placed.withColumn("_here", here).join(before, [key, "_p"])
    return ranked.withColumn("rank", F.col("_here") + F.col("_before")).drop("_p", "_here", "_before")


def keep_ids(rows: DataFrame, ids: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows whose ``key`` is in the stored ``ids``.

    The planner knows the stored size: ids within its broadcast threshold are
    broadcast and ``rows`` is not shuffled; more ids make it a shuffled join.
    """
    return rows.join(ids.select(key), key, "left_semi")


def join_chunks(
    left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, chunk: int, condition: Column | None = None
) -> DataFrame:
    """Inner join on a key that may be hot on both sides.

    The rows of a key are cut by their id into chunks of about ``chunk`` on each side, and each chunk pair is a
    join key of its own: no task buffers more than a chunk of one key. Apart from the key the sides have different columns.
    """
    n_left = left.groupBy(key).agg(F.count("*").alias("_left"))
    sizes = materialize(n_left.join(right.groupBy(key).agg(F.count("*").alias("_right")), key))
    pieces = [F.ceil(F.col(side) / F.lit(chunk)).cast("int") for side in ("_left", "_right")]

    def cut(rows: DataFrame, size: str, id_: str, own: int) -> DataFrame:
        placed = join_groups(rows, sizes, [key], size)
        piece = F.pmod(F.xxhash64(id_), pieces[own]).cast("int")
        others = F.explode(F.sequence(F.lit(0), pieces[1 - own] - 1))
        names = ("_i", "_j") if own == 0 else ("_j", "_i")
        return placed.select(*rows.columns, piece.alias(names[0]), others.alias(names[1]))

    joined = cut(left, "_left", left_id, 0).join(cut(right, "_right", right_id, 1), [key, "_i", "_j"])
    return (joined if condition is None else joined.where(condition)).drop("_i", "_j")


def split_pairs(rows: DataFrame, keys: list[str], size: str, node: str, chunk: int) -> DataFrame:
    """Each unordered pair of rows with equal ``keys`` once, columns suffixed ``_a`` and ``_b``.

    A key with n rows is cut into ceil(n / chunk) chunks and its chunk pairs become
    separate join keys, so that no task holds a whole large key.
    """
    chunks = F.ceil(F.col(size) / F.lit(chunk)).cast("int")
    cut = rows.withColumn("_n", chunks).withColumn("_c", F.pmod(F.xxhash64(node), F.col("_n")).cast("int"))
    values = [c for c in rows.columns if c not in keys]
    left = cut.select(
        *keys, F.col("_c").alias("_i"), F.explode(F.sequence("_c", F.col("_n") - 1)).alias("_j"),
        *[F.col(c).alias(f"{c}_a") for c in values],
    )
    right = cut.select(
        *keys, F.explode(F.sequence(F.lit(0), "_c")).alias("_i"), F.col("_c").alias("_j"),
        *[F.col(c).alias(f"{c}_b") for c in values],
    )
    pairs = left.join(right, [*keys, "_i", "_j"])
    pairs = pairs.where((F.col("_i") < F.col("_j")) | (F.col(f"{node}_a") < F.col(f"{node}_b")))
    # Put the smaller node first, with everything that belongs to it.
    swap = F.col(f"{node}_a") > F.col(f"{node}_b")
    ordered = [
        F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}")
        for c in values for x, y in (("a", "b"), ("b", "a"))
    ]
    return pairs.select(*keys, *ordered)
