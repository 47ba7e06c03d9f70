"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector x is ``s * q + r``: int8 components q, a scale s and a rest r whose length is
known exactly. For two vectors ``|<x, y> - s t <q, p>| <= |s q| |r_y| + |r_x|``, so the product of the integer
tiles proves most pairs to be below the threshold and many to be above; the others are recomputed
from the original vectors in double precision.

Equal vectors are one row with a weight first. Distinct vectors are cut into tiles, and
every pair of tiles is one unit of work. It gives one row per vector that has links there: their
number, by weight, and the vector it hangs on in the unit's spanning forest. Links are never
listed, so the output stays linear in the vectors of a unit.

Edge cases: a vector that is null, empty, zero, or holds a null or non-finite component links
with nothing. Vectors of different lengths are never linked. Rows with equal ids are separate
vectors. A null vec_id takes part and has no component id of its own. An empty table gives an empty
result. Only ``vec_id`` and ``embedding`` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import records_per_batch
from twinfold.llm.vectors import cosines, is_usable, unit_rows
from twinfold.operators.components import connected_components
from twinfold.session import materialize

THRESHOLD = 0.9
_TILE = 2048  # vectors of a tile
_STRIP = 256  # rows of a tile multiplied at a time
_ROUNDING = 1e-5  # more than single precision can lose in the products below


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the unit rows: int8 components, scale, length of the quantised row, length of the rest."""
    unit = unit_rows(rows)
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back**2).sum(axis=1)), np.sqrt(((unit - back) ** 2).sum(axis=1))


def links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of two tiles with a cosine of at least ``threshold``; of a tile with itself each pair once."""
    qa, sa, na, ra = quantise(a)
    qb, sb, nb, rb = quantise(b)
    right = qb.astype(np.float32).T
    # Sums of 1,040 products of int8 are exact in single precision; longer vectors are summed in pieces.
    pieces = [slice(i, i + 1024) for i in range(0, a.shape[1], 1024)]
    for at in range(0, len(a), _STRIP):
        strip = slice(at, min(at + _STRIP, len(a)))
        left = qa[strip].astype(np.float32)
        product = sum((left[:, p] @ right[p]).astype(np.float64) if len(pieces) > 1 else left[:, p] @ right[p] for p in pieces)
        product *= sb.astype(np.float32)
        # First with the largest rest of the tile, then with each pair's own.
        least = (threshold - ra[strip] - na[strip] * rb.max() - _ROUNDING) / sa[strip]
        i, j = np.nonzero(product >= (least * (1 - np.sign(least) * 1e-6)).astype(np.float32)[:, None])
        if same:
            i, j = i[j > i + at], j[j > i + at]
        if not len(i):
            continue
        value = product[i, j].astype(np.float64) * sa[strip][i]
        i = i + at
        slack = na[i] * rb[j] + ra[i] + _ROUNDING
        linked = value - slack >= threshold
        open_pairs = np.flatnonzero(~linked & (value + slack >= threshold))
        for some in np.array_split(open_pairs, len(open_pairs) // 100_000 + 1):
            linked[some] = cosines(a[i[some]], b[j[some]]) >= threshold
        yield i[linked], j[linked]


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the trees of linked rows; every label is the smallest row of its tree."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, shorter := label[label]):
            label[:] = shorter


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector."""
    spark = vectors.sparkSession
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = all_rows.where(is_usable(F.col("v")))
    # A vector's number is written once, so a lost task cannot change it.
    distinct = materialize(
        usable.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    sizes = distinct.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).withColumn(
        "tiles", F.ceil(F.col("n") / _TILE).cast("int")
    )
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    member = F.struct("node", "weight", "v")
    tiles = materialize(
        distinct.join(sizes, F.size("v") == F.col("size")).withColumn("tile", tile)
        .groupBy("size", "tiles", "tile").agg(F.collect_list(member).alias("members"))
    )
    # Each pair of tiles i <= j is one unit. Tasks read both from the stored table, partition by partition:
    # sent to its units through a shuffle, a tile would be written once for every other one.
    left = tiles.select("size", F.col("tile").alias("i"), F.col("members").alias("a"))
    right = tiles.select(F.col("size").alias("_size"), F.col("tile").alias("j"), F.col("members").alias("b"))
    pair = (F.col("size") == F.col("_size")) & (F.col("i") <= F.col("j"))
    units = left.hint("shuffle_replicate_nl").join(right, pair).select("size", "i", "j", "a", "b")
    schema = "node long, links long, root long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, same = batch.column("size")[row].as_py(), batch.column("i")[row] == batch.column("j")[row]
                sides = []
                for c in ("a", "b"):
                    members = batch.column(c)[row].values
                    whole = members.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    sides.append((members.field("node").to_numpy(), members.field("weight").to_numpy(), whole))
                (na, wa, a), (nb, wb, b) = sides
                shift = 0 if same else len(a)
                nodes = na if same else np.r_[na, nb]
                label, counts = np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
                for i, j in links(a, b, threshold, same):
                    np.add.at(counts, i, wb[j])
                    np.add.at(counts, j + shift, wa[i])
                    merge(label, i, j + shift)
                linked = np.flatnonzero(counts)
                if len(linked):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[linked]), pa.array(counts[linked]), pa.array(nodes[label[linked]])],
                        names=["node", "links", "root"],
                    )

    with records_per_batch(spark, 4):
        found = materialize(units.mapInArrow(compare, schema))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    groups = connected_components(edges).select("node", F.col("component").alias("group"))
    known = distinct.select("v", "node", "first", "weight").join(counts, "node", "left").join(groups, "node", "left")
    known = known.withColumn("group", F.coalesce("group", "node"))
    smallest = known.groupBy("group").agg(F.min("first").alias("smallest"))
    named = materialize(
        known.join(smallest, "group").select(
            "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "smallest"
        )
    )
    usable_rows = usable.join(named, "v").select("vec_id", F.col("links").alias("n_links"), F.col("smallest").alias("component_id"))
    other = all_rows.where(~is_usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable_rows.unionByName(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
