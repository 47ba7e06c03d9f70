"""Hard negatives by inner product over an R-tree packed with sort-tile-recursive.

Vectors become whole numbers, ``floor(scale * x)``, so all scores are exact. The rows are packed into tiles of some
thousands: quantiles of the three coordinates that vary most cut them into slabs, slabs into strips and strips into tiles, in Spark;
within a tile the same is done down to leaves of some hundred rows. Every node has its minimum bounding box and
its range of labels. For an anchor the components of a box give an interval of inner products: per coordinate the
product with one or the other end, added up.

A best-first queue serves a block of anchors: the node with the highest upper bound comes next. It is left out for
an anchor if its box lies outside of all of the anchor's score windows or strictly below the k-th best score found in
each, or if its labels cannot do; equal scores stay in, since smaller ids win. Boxes of whole tiles
are tried first in tasks of their own, so a tile meets only anchors that it may serve.

1. Each anchor's best rows of its label in its own tile bound its k-th positive score from below.
2. Positives: tiles that reach that bound are searched, with the label equal.
3. Negatives: per positive a window of scores, with the label different; all windows of an anchor in one search.

Edge cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; nor do
rows with a component of about 2**26 or more after scaling, whose scores need not fit a long (vectors have up to 2,048
components). An empty vector has score 0. Vectors of different lengths never meet. Rows of the anchor's own id are
neither its positives nor its negatives; anchors of equal ids are searched one by one. Ties go to the smaller vec_id.
An empty table, and an anchor without positives or without rows in a window, give no rows. Only ``vec_id``, ``label`` and
``embedding`` are read; other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import records_per_batch
from twinfold.operators.joins import join_groups
from twinfold.session import materialize

_TILE = 4096  # rows of a tile, or so
_LEAF = 128  # rows of a leaf
_FANOUT = 8  # children of an inner node of a tile's tree
_SLABS = 64  # parts that a coordinate is cut into at most; larger tiles are cut by row number
_BLOCK = 1024  # anchors that are searched together, or so
_GROUP = 16  # blocks that meet a tile in one task, or so
_NODES = 2048  # boxes of tiles that meet a block in one task, or so
_LARGEST = 1 << 26
_NONE = -(1 << 62)  # below every score
_TOP = 1 << 62

_TILE_SCHEMA = (
    "tile long, dim int, ids binary, labels binary, anchor binary, rows binary, numbers binary, low binary, high binary, "
    "least_label long, most_label long"
)
_QUERY = "numbers binary, ids binary, labels binary, rows binary, lows binary, highs binary"


def _one_row(**values) -> dict:
    """A row of arrays as bytes."""
    return {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in values.items()}


def _arrow(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({n: pa.array([r[n] for r in rows], type=kinds[k]) for n, k in fields})


def _ints(cell, kind=np.int64) -> np.ndarray:
    held = cell.as_buffer()
    return np.frombuffer(held, dtype=kind) if held.size else np.zeros(0, dtype=kind)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column of lists of one length."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(whole), dim)


# --- the tree -----------------------------------------------------------------


def str_order(rows: np.ndarray, leaf: int = _LEAF) -> np.ndarray:
    """An order of the rows in which consecutive ``leaf`` rows are near each other: sort-tile-recursive."""

    def tiled(chosen: np.ndarray, coordinates: list[int]) -> np.ndarray:
        pages = math.ceil(len(chosen) / leaf)
        if pages <= 1 or not coordinates:
            return chosen
        chosen = chosen[np.argsort(rows[chosen, coordinates[0]], kind="stable")]
        slabs = math.ceil(pages ** (1 / len(coordinates)))
        size = math.ceil(pages / slabs) * leaf
        return np.concatenate([tiled(chosen[at : at + size], coordinates[1:]) for at in range(0, len(chosen), size)])

    spread = rows.astype(np.float64).var(axis=0) if rows.size else np.zeros(rows.shape[1])
    return tiled(np.arange(len(rows)), np.argsort(-spread, kind="stable")[:3].tolist())


class Tree:
    """Boxes over rows that stand in leaf order. Node 0 is the root; a node's children are consecutive."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        starts = np.arange(0, len(rows), _LEAF)
        levels = [(np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts),
                   np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts))]
        while len(levels[-1][0]) > 1:
            low, high, least, most = levels[-1]
            at = np.arange(0, len(low), _FANOUT)
            levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                           np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))
        levels.reverse()
        self.low, self.high, self.least, self.most = (np.concatenate(part) for part in zip(*levels))
        sizes = [len(level[0]) for level in levels]
        self.first_leaf = sum(sizes[:-1])
        self.children: list[range] = []
        begin = 0
        for size, below in zip(sizes, sizes[1:]):
            begin += size
            self.children += [range(begin + i * _FANOUT, begin + min((i + 1) * _FANOUT, below)) for i in range(size)]


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of every anchor (rows) with a point of every box (columns)."""
    kind = _exact(anchors, low, high)
    up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
    low, high = low.astype(kind).T, high.astype(kind).T
    return (up @ low + down @ high).astype(np.int64), (up @ high + down @ low).astype(np.int64)


def _exact(anchors: np.ndarray, *others: np.ndarray):
    """Double precision where every sum of products is a whole number that it holds, else long."""
    most = [max((int(np.abs(x).max()) for x in side if x.size), default=0) for side in ((anchors,), others)]
    return np.float64 if anchors.shape[1] * most[0] * most[1] < 1 << 53 else np.int64


def wanted(below: np.ndarray, above: np.ndarray, floors: np.ndarray, highs: np.ndarray, labels: np.ndarray,
           least: np.ndarray, most: np.ndarray, same: bool) -> np.ndarray:
    """Which anchors may still gain from a box: by its score interval in one of the windows, and by its labels."""
    by_score = ((below[:, None] <= highs) & (above[:, None] >= floors)).any(axis=1)
    fits = (least <= labels) & (labels <= most) if same else (least != labels) | (most != labels)
    return by_score & fits


def best_first(anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, lows: np.ndarray, highs: np.ndarray,
               rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """``(anchor, window, row, score)`` of the ``k`` best rows per anchor and window, best first.

    ``lows`` and ``highs`` are the ends of the windows of every anchor. ``rows`` stand in leaf order.
    """
    tree = Tree(rows, labels)
    below, above = intervals(anchors, tree.low, tree.high)
    kind = _exact(anchors, rows)
    anchors, rows = anchors.astype(kind), rows.astype(kind)
    n, windows = lows.shape
    floors = lows.copy()  # the window's low end, then the k-th best score in it
    held = [np.zeros(0, dtype=np.int64)] * 3  # anchor * windows + window, row, score
    queue = [(-int(above[:, 0].max()), 0)]
    while queue:
        _, node = heapq.heappop(queue)
        need = np.flatnonzero(wanted(below[:, node], above[:, node], floors, highs, anchor_labels, tree.least[node], tree.most[node], same))
        if not len(need):
            continue
        if node < tree.first_leaf:
            for child in tree.children[node]:
                heapq.heappush(queue, (-int(above[need, child].max()), child))
            continue
        begin = (node - tree.first_leaf) * _LEAF
        leaf = slice(begin, begin + _LEAF)
        scores = (anchors[need] @ rows[leaf].T).astype(np.int64)
        fits = (labels[leaf][None, :] == anchor_labels[need][:, None]) == same
        fits &= ids[leaf][None, :] != anchor_ids[need][:, None]
        new = []
        for w in range(windows):
            a, r = np.nonzero(fits & (scores >= floors[need, w][:, None]) & (scores <= highs[need, w][:, None]))
            new.append((need[a] * windows + w, r + begin, scores[a, r]))
        key, row, score = (np.concatenate([old, *parts]) for old, parts in zip(held, zip(*new)))
        if len(key) == len(held[0]):
            continue
        order = np.lexsort((ids[row], -score, key))
        key, row, score = key[order], row[order], score[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        best = rank < k
        full = rank == k - 1
        floors.reshape(-1)[key[full]] = score[full]
        held = [key[best], row[best], score[best]]
    key, row, score = held
    return key // windows, key % windows, row, score


# --- tables -------------------------------------------------------------------


def whole_rows(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """The rows that take part, stored: number, id, label, components, whether it is an anchor."""
    doubles = F.col("embedding").cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(doubles, lambda x: F.floor(x * scale))
    fits = F.forall(doubles, lambda x: F.abs(x * scale) < _LARGEST - 1)
    chosen = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & fits)
    return materialize(chosen.select(
        F.monotonically_increasing_id().alias("number"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"), scaled.cast("array<int>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).withColumn("dim", F.size("v")))


def tiles_of(rows: DataFrame, total: int) -> DataFrame:
    """Stored tiles: rows cut by quantiles of three coordinates, one after the other; ``total`` is their number."""
    spread = (
        rows.select(F.posexplode("v").alias("c", "x")).groupBy("c").agg(F.var_pop("x").alias("spread"))
        .orderBy(F.desc("spread"), "c").limit(3).collect()
    )
    slabs = min(_SLABS, math.ceil(math.ceil(total / _TILE) ** (1 / max(len(spread), 1))))
    shares = [i / slabs for i in range(1, slabs)]
    cut, keys = rows, ["dim"]
    for level, coordinate in enumerate(spread):
        if not shares:
            break
        x = F.coalesce(F.get("v", F.lit(coordinate.c)), F.lit(0))
        name = f"s{level}"
        # At most 64 * 64 rows per vector length, each of 63 numbers. Stored, since another run may give other quantiles.
        bounds = materialize(cut.groupBy(*keys).agg(F.percentile_approx(x, shares, 2000).alias("bounds")))
        cut = cut.join(F.broadcast(bounds), keys)
        cut = cut.withColumn(name, F.size(F.filter("bounds", lambda b: b < x))).drop("bounds")
        keys = [*keys, name]
    counts = materialize(cut.groupBy(*keys).agg(F.count("*").alias("n")))
    dealt = join_groups(cut, counts, keys, "n", total=total)
    chunk = F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / _TILE))
    dealt = dealt.withColumn("tile", F.xxhash64(*keys, chunk))

    def pack(key, rows):
        dim = rows["dim"][0].as_py()
        v = _matrix(rows["v"], dim)
        order = str_order(v)
        v = v[order]
        column = lambda name: rows[name].to_numpy()[order]
        labels = column("label")
        return _arrow([_one_row(
            tile=key[0].as_py(), dim=dim, ids=column("vec_id"), labels=labels, anchor=column("anchor").astype(np.uint8),
            rows=v, numbers=column("number"), low=v.min(axis=0), high=v.max(axis=0),
            least_label=int(labels.min()), most_label=int(labels.max()),
        )], _TILE_SCHEMA)

    columns = ["tile", "dim", "number", "vec_id", "label", "anchor", "v"]
    return materialize(dealt.select(*columns).groupBy("tile").applyInArrow(pack, _TILE_SCHEMA))


def _tile(row: dict) -> tuple[np.ndarray, ...]:
    dim = row["dim"].as_py()
    ids = _ints(row["ids"])
    return _ints(row["rows"], np.int32).reshape(len(ids), dim), ids, _ints(row["labels"])


def own_bounds(tiles: DataFrame, k: int) -> DataFrame:
    """``(number, low)``: each anchor's k-th best score of its label in its own tile, or one below every score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                rows, ids, labels = _tile(row)
                numbers = _ints(row["numbers"])
                chosen = np.flatnonzero(_ints(row["anchor"], np.uint8))
                for at in range(0, len(chosen), _BLOCK):
                    some = chosen[at : at + _BLOCK]
                    lows = np.full((len(some), 1), _NONE)
                    a, _, _, score = best_first(rows[some], ids[some], labels[some], lows, -lows, rows, ids, labels, k, True)
                    counts = np.bincount(a, minlength=len(some))
                    least = np.full(len(some), _NONE)
                    last = np.cumsum(counts) - 1
                    least[counts >= k] = score[last[counts >= k]]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[some]), pa.array(least)], names=["number", "low"])

    return tiles.mapInArrow(search, "number long, low long")


def search(tiles: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """``(number, anchor_id, low, high, vec_id, score)``: per tile the ``k`` best rows of every window of every query.

    ``queries`` has ``number, vec_id, label, v, dim`` and the windows ``lows, highs`` (arrays of one length).
    ``low`` and ``high`` are the ends of the window. The result is stored.
    """
    spark = tiles.sparkSession
    queries = materialize(queries)
    many, pages = queries.count(), tiles.count()
    blocks, node_blocks = max(1, math.ceil(many / _BLOCK)), max(1, math.ceil(pages / _NODES))
    groups = math.ceil(blocks / _GROUP)

    def pack(key, rows):
        dim, width = key[0].as_py(), len(rows["lows"][0])
        wide = [rows[c].combine_chunks().flatten().to_numpy().reshape(-1, width) for c in ("lows", "highs")]
        return _arrow([_one_row(
            dim=dim, block=key[1].as_py(), width=width, rows=_matrix(rows["v"], dim), lows=wide[0], highs=wide[1],
            **{a: rows[b].to_numpy() for a, b in (("numbers", "number"), ("ids", "vec_id"), ("labels", "label"))},
        )], f"dim int, block long, width int, {_QUERY}")

    numbered = queries.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    asked = materialize(numbered.groupBy("dim", "block").applyInArrow(pack, f"dim int, block long, width int, {_QUERY}"))
    box = F.struct("tile", "low", "high", "least_label", "most_label")
    boxes = tiles.groupBy("dim", F.pmod(F.xxhash64("tile"), F.lit(node_blocks)).alias("nodes")).agg(F.collect_list(box).alias("boxes"))
    # Both sides name the pair of blocks; neither is sent whole.
    pairs = asked.withColumn("nodes", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(node_blocks - 1).cast("long")))).join(
        boxes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))), ["dim", "block", "nodes"]
    )
    unit = f"tile long, part long, dim int, width int, {_QUERY}"

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                anchors, parts = _queries(row)
                boxes = row["boxes"].values
                low, high = (np.array([np.frombuffer(x, dtype=np.int32) for x in boxes.field(c).to_pylist()]) for c in ("low", "high"))
                least, most = (boxes.field(c).to_numpy() for c in ("least_label", "most_label"))
                below, above = intervals(anchors, low, high)
                for t, tile in enumerate(boxes.field("tile").to_pylist()):
                    need = wanted(below[:, t], above[:, t], parts["lows"], parts["highs"], parts["labels"], least[t], most[t], same)
                    if need.any():
                        yield _arrow([_one_row(
                            tile=tile, part=row["block"].as_py() % groups, dim=row["dim"].as_py(), width=row["width"].as_py(),
                            rows=anchors[need], **{c: x[need] for c, x in parts.items()},
                        )], unit).to_batches()[0]

    def compare(key, tile, units):
        found = []
        if tile.num_rows:
            rows, ids, labels = _tile({c: tile[c][0] for c in tile.column_names})
            for i in range(units.num_rows):
                anchors, q = _queries({c: units[c][i] for c in units.column_names})
                a, w, r, score = best_first(anchors, q["ids"], q["labels"], q["lows"], q["highs"], rows, ids, labels, k, same)
                found.append((q["numbers"][a], q["ids"][a], q["lows"][a, w], q["highs"][a, w], ids[r], score))
        arrays = map(np.concatenate, zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 6
        return pa.table(dict(zip(["number", "anchor_id", "low", "high", "vec_id", "score"], map(pa.array, arrays))))

    with records_per_batch(spark, 8):
        units = materialize(pairs.mapInArrow(prune, unit))
        named = units.select(F.col("tile").alias("their_tile"), F.col("part").alias("their_part")).distinct()
        met = tiles.join(named, tiles["tile"] == named["their_tile"]).drop("tile")
        return materialize(
            met.groupBy("their_tile", "their_part").cogroup(units.groupBy("tile", "part"))
            .applyInArrow(compare, "number long, anchor_id long, low long, high long, vec_id long, score long")
        )


def _queries(row: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    dim, width = row["dim"].as_py(), row["width"].as_py()
    parts = {c: _ints(row[c]) for c in ("numbers", "ids", "labels")}
    parts |= {c: _ints(row[c]).reshape(-1, width) for c in ("lows", "highs")}
    return _ints(row["rows"], np.int32).reshape(len(parts["ids"]), dim), parts


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows where ``is_anchor`` holds.

    A negative's score is from ``low`` to ``high`` percent of the positive's.
    """
    rows = whole_rows(vectors, is_anchor, scale)
    tiles = tiles_of(rows, rows.count())
    anchors = rows.where("anchor").select("number", "vec_id", "label", "v", "dim")
    with records_per_batch(rows.sparkSession, 8):
        bounds = materialize(own_bounds(tiles, positives))
    asked = anchors.join(bounds, "number").withColumn("lows", F.array("low")).withColumn("highs", F.array(F.lit(_TOP)))
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    near = search(tiles, asked.drop("low"), positives, True)
    best = materialize(
        near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
        .select("number", "n", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    # Whole numbers s with low * p <= 100 * s <= high * p.
    p = F.col("positive_score").cast("decimal(20,0)")
    best = best.withColumn("low", F.ceil(p * low / 100).cast("long")).withColumn("high", F.floor(p * high / 100).cast("long"))
    ends = best.where("low <= high").groupBy("number").agg(F.sort_array(F.collect_set(F.struct("high", "low"))).alias("w"))
    # All anchors have as many windows; those added are empty.
    filled = lambda c, value: F.concat(F.col(f"w.{c}"), F.array_repeat(F.lit(value).cast("long"), positives - F.size("w")))
    asked = anchors.join(ends, "number").withColumn("lows", filled("low", _TOP)).withColumn("highs", filled("high", _NONE)).drop("w")
    far = search(tiles, asked, negatives, False)
    order = Window.partitionBy("number", "low", "high").orderBy(F.desc("score"), "vec_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return best.join(ranked, ["number", "low", "high"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
