"""Similar pairs within large buckets, compared block by block instead of pair by pair.

Texts that are connected by pairs in one bucket which their sketches leave possible are a family. A family is cut into blocks of
bounded bytes, and each pair of its blocks is one unit of work. A unit counts the common shingles of all its pairs at once: frequent shingles by a
product of 0/1 matrices, rare ones along the lists of their holders. Only similar pairs leave it, so neither the dissimilar
pairs nor a set per pair is ever written; tasks read the blocks from the stored table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions import shingle_sets
from twinfold.operators.bucket_units import possible_links
from twinfold.operators.components import connected_components
from twinfold.operators.features import with_normalized
from twinfold.operators.joins import join_groups
from twinfold.params import Params
from twinfold.session import materialize, records_per_batch

# Workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 8_000_000  # bytes of the shingle sets of a block
TEXTS = 1_000  # texts of a block, at most or so
_WIDTH = 4_096  # shingles of one matrix product
_LISTED = 2_000_000  # pairs of holders that are counted at a time
_DENSE = 100  # a shingle is listed if its pairs of holders are fewer than all pairs by this factor


def _places(sets: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in ``of`` of each element that is there, by rising place."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    ids = np.concatenate(sets)
    at = np.minimum(np.searchsorted(of, ids), len(of) - 1)
    held = of[at] == ids
    order = np.argsort(at[held], kind="stable")
    return rows[held][order], at[held][order]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` has in common with each of ``right``."""
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    if not len(both):
        return counts
    (row_a, at_a), (row_b, at_b) = _places(left, both), _places(right, both)
    n_a, n_b = (np.bincount(at, minlength=len(both)) for at in (at_a, at_b))
    begin_b = np.cumsum(n_b) - n_b
    dense = n_a * n_b * _DENSE > counts.size
    column = np.cumsum(dense) - 1
    sides = [(rows[dense[at]], column[at[dense[at]]], n) for rows, at, n in ((row_a, at_a, len(left)), (row_b, at_b, len(right)))]
    for at in range(0, int(dense.sum()), _WIDTH):
        parts = []
        for rows, columns, n in sides:
            low, high = np.searchsorted(columns, [at, at + _WIDTH])
            part = np.zeros((n, _WIDTH), dtype=np.float32)
            part[rows[low:high], columns[low:high] - at] = 1
            parts.append(part)
        counts += parts[0] @ parts[1].T
    listed = np.flatnonzero(~dense[at_a])
    if len(listed):
        flat = counts.reshape(-1)
        times = n_b[at_a[listed]]
        upto = np.cumsum(times)
        cuts = np.searchsorted(upto, np.arange(_LISTED, int(upto[-1]), _LISTED))
        for some in np.split(np.arange(len(listed)), cuts):
            if not len(some):
                continue
            n = times[some]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pair = np.repeat(row_a[listed[some]], n) * len(right) + row_b[np.repeat(begin_b[at_a[listed[some]]], n) + inner]
            flat += np.bincount(pair, minlength=flat.size)
    return counts


def forest(pairs: list[tuple], labels: dict[str, str]) -> list[tuple]:
    """Pairs ``(a, b, ...)`` that join what is apart so far; ``labels`` are the components of the ids."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for pair in pairs:
        a, b = root(labels[pair[0]]), root(labels[pair[1]])
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(pair)
    return kept


def similar_in_buckets(
    members: DataFrame, articles: DataFrame, params: Params, labels: DataFrame | None = None, sketches: DataFrame | None = None
) -> DataFrame:
    """``(article_id_a, article_id_b, score)``: similar pairs of distinct texts that share a bucket of stored ``members``, stored.

    With ``labels(article_id, label)``, components so far, only pairs across them, and of these in each unit no more than connect
    what all of them connect. With a ``fresh`` column only pairs with a fresh text; a ``batch`` column says where texts are.
    Texts that ``sketches(article_id, sketch)`` show to be too different from all others of their buckets are not read.
    """
    linked = connected_components(possible_links(members, sketches, params.threshold, labels)).toDF("article_id", "family")
    if linked.isEmpty():
        return members.sparkSession.createDataFrame([], "article_id_a string, article_id_b string, score double")
    keys = ["article_id", "batch"] if "batch" in members.columns else ["article_id"]
    fresh = F.col("fresh") if "fresh" in members.columns else F.lit(True)
    texts = members.groupBy(*keys).agg(F.collect_set("bucket").alias("buckets"), F.max(fresh).alias("fresh"))
    known = labels if labels is not None else texts.limit(0).select("article_id", F.col("article_id").alias("label"))
    texts = texts.join(known, "article_id", "left").join(linked, "article_id")
    texts = materialize(texts.withColumn("label", F.coalesce("label", "article_id")))
    wanted = with_normalized(articles.select(*keys, "title", "content").join(texts.select(*keys), keys, "left_semi"))
    sets = wanted.select(*keys, shingle_sets.shingle_ids(F.col("normalized"), params.shingle_size).alias("ids"))
    # Texts of buckets have shingles. A filter on the sets would be moved before the join, and sets be made of all articles.
    rows = materialize(texts.join(sets, keys).drop("batch"))
    sizes = rows.groupBy("family").agg(F.greatest(F.ceil(F.sum(F.length("ids")) / BLOCK), F.ceil(F.count("*") / TEXTS)).cast("int").alias("blocks"), F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("article_id"), F.col("blocks")).cast("int")
    member = F.struct("article_id", "label", "fresh", "buckets", "ids")
    blocks = materialize(
        join_groups(rows, sizes, ["family"], "n").withColumn("block", block)
        .groupBy("family", "blocks", "block").agg(F.collect_list(member).alias("members"))
    )
    # Of a family of one block nothing is joined; there are no more blocks of others than their bytes make.
    alone = blocks.where("blocks = 1").select(F.lit(True).alias("same"), F.col("members").alias("a"), F.array().cast(blocks.schema["members"].dataType).alias("b"))
    cut = blocks.where("blocks > 1")
    left = cut.select("family", F.col("block").alias("i"), F.col("members").alias("a"))
    right = cut.select(F.col("family").alias("_family"), F.col("block").alias("j"), F.col("members").alias("b"))
    pair = (F.col("family") == F.col("_family")) & (F.col("i") <= F.col("j"))
    units = alone.unionByName(left.hint("shuffle_replicate_nl").join(right, pair).select((F.col("i") == F.col("j")).alias("same"), "a", "b"))
    least, spanning = params.threshold, labels is not None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                same = batch.column("same")[at].as_py()
                sides = []
                for c in ("a", "a" if same else "b"):
                    held = batch.column(c)[at].values
                    ids = [np.frombuffer(x, dtype=np.uint64) for x in held.field("ids").to_pylist()]
                    sides.append([held.field(f).to_pylist() for f in ("article_id", "label", "fresh")] + [held.field("buckets"), ids])
                found = similar(*sides, same)
                yield pa.RecordBatch.from_pydict(
                    {"article_id_a": [p[0] for p in found], "article_id_b": [p[1] for p in found], "score": [p[2] for p in found]},
                    schema=pa.schema([("article_id_a", pa.string()), ("article_id_b", pa.string()), ("score", pa.float64())]),
                )

    def similar(a: list, b: list, same: bool) -> list[tuple]:
        (names_a, labels_a, fresh_a, buckets_a, ids_a), (names_b, labels_b, fresh_b, buckets_b, ids_b) = a, b
        if spanning and len({*labels_a, *labels_b}) < 2:
            return []
        counts = common_counts(ids_a, ids_b).astype(np.float64)
        n_a, n_b = (np.array([len(s) for s in ids], dtype=np.float64) for ids in (ids_a, ids_b))
        scores = counts / (n_a[:, None] + n_b[None, :] - counts)
        near = (scores >= least) & (np.array(fresh_a)[:, None] | np.array(fresh_b)[None, :])
        if same:
            near &= np.arange(len(ids_a))[:, None] < np.arange(len(ids_b))[None, :]
        if spanning:
            number = {x: k for k, x in enumerate({*labels_a, *labels_b})}
            code_a, code_b = (np.array([number[x] for x in labels]) for labels in (labels_a, labels_b))
            near &= code_a[:, None] != code_b[None, :]
        i, j = np.nonzero(near)
        sets_a = {x: set(buckets_a[x].as_py()) for x in np.unique(i).tolist()}
        sets_b = {x: set(buckets_b[x].as_py()) for x in np.unique(j).tolist()}
        pairs = [
            (min(names_a[x], names_b[y]), max(names_a[x], names_b[y]), float(scores[x, y]))
            for x, y in zip(i.tolist(), j.tolist()) if not sets_a[x].isdisjoint(sets_b[y])
        ]
        return forest(pairs, {**dict(zip(names_a, labels_a)), **dict(zip(names_b, labels_b))}) if spanning else pairs

    with records_per_batch(members.sparkSession, 4):
        return materialize(units.mapInArrow(compare, "article_id_a string, article_id_b string, score double"))
