"""Comparing shingle sets of pairs, and finding all similar pairs without comparing all.

Pairs are dealt to units of bounded size. A text's sketch, or the text itself, is sent once to every group of units
that has a pair with it, not once per pair. Its set is made there: eight bytes per shingle that do not compress are several times
the text. Where only pairs at or above a threshold count, sketches come first and sets only for what they leave.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions import shingle_sets
from twinfold.functions import similarity as sim
from twinfold.functions.shingle_sets import common, ids_of, most_common, similarity
from twinfold.operators.components import connected_components
from twinfold.operators.features import with_normalized
from twinfold.operators.joins import join_groups
from twinfold.params import DEFAULT, Params
from twinfold.session import materialize, records_per_batch

# Workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 128  # partners of one text that are compared in one unit
FAMILY = 1_000  # texts of a part of a family whose pairs are many
DENSE = 8  # pairs a text beyond which sets are sent by families
HOT_GROUPS = 1_000  # groups that one task sends a text to
GROUP = 4_000_000  # shingles, or so, of the pairs of units that a task holds at a time
CHUNK = 2_000  # texts of a block of sketches, at most or so
SKETCH_BYTES = 4_000_000  # bytes of the sketches of a block
_WORDS = 64  # 64-bit words of sketches in one matrix product

# A bounded sample of shingles whose frequencies put frequent ones last. It changes the work, not the result.
SAMPLE = 2_000_000
FREQUENT = 200_000


def with_units(pairs: DataFrame) -> DataFrame:
    """Pairs with ``unit``: those of one smaller id together, ``UNIT`` or so at a time."""
    degree = pairs.groupBy("article_id_a").agg(F.count("*").alias("_degree"))
    known = join_groups(pairs, degree, ["article_id_a"], "_degree")
    part = F.pmod(F.xxhash64("article_id_b"), F.ceil(F.col("_degree") / UNIT))
    return known.withColumn("unit", F.xxhash64("article_id_a", part)).drop("_degree")


def family_units(pairs: DataFrame) -> DataFrame:
    """Stored pairs with ``unit``: texts that pairs connect are cut into parts, and the pairs of two parts are one unit.

    A text is sent to as many units as its family has parts, not to one for every few partners.
    """
    nodes = connected_components(pairs.select(F.col("article_id_a").alias("u"), F.col("article_id_b").alias("v")))
    sizes = nodes.groupBy("component").agg(F.count("*").alias("n"))
    placed = join_groups(nodes, sizes, ["component"], "n")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / FAMILY))
    placed = materialize(placed.select("node", "component", part.alias("part")))
    rows = pairs.drop("unit")
    for end in "ab":
        rows = rows.join(placed.select(F.col("node").alias(f"article_id_{end}"), "component", F.col("part").alias(f"_{end}")).drop(*["component"] * (end == "b")), f"article_id_{end}")
    unit = F.xxhash64("component", F.least("_a", "_b"), F.greatest("_a", "_b"))
    return materialize(rows.withColumn("unit", unit).select(*pairs.columns))


def per_unit(pairs: DataFrame, values: DataFrame, judge: Callable[[list[bytes], list[bytes]], np.ndarray], keep: bool, size: int = 0) -> DataFrame:
    """``pairs`` with what ``judge`` says of the values of their two ends.

    ``values`` has ``article_id`` and one binary column, one row per id; ``pairs`` has ``unit``. ``judge``
    gets the values of all first and all second ends of some units' pairs. With ``keep`` it says which
    pairs stay, else it gives a ``score`` each. With ``size`` the column has ``packed`` texts, and the value is the shingle set, made where the text arrives.
    """
    column = next(c for c in values.columns if c != "article_id")
    # Units are dealt to groups of about equal work; a unit is bounded, so a group is.
    work = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("n_shingles_a").cast("long") + F.col("n_shingles_b")), F.lit(0)).alias("size")).first()
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    groups = max(work["size"] // GROUP, min(cores, work["n"] // UNIT), 1)
    pairs = pairs.withColumn("_group", F.pmod("unit", F.lit(groups)))
    ends = pairs.select("_group", F.explode(F.array("article_id_a", "article_id_b")).alias("article_id")).distinct()
    if groups > HOT_GROUPS:
        # A text of very many groups is repeated by salts, so that no task sends it to all of them.
        units = ends.groupBy("article_id").agg(F.count("*").alias("_units"))
        sent = join_groups(ends, values.join(units, "article_id"), ["article_id"], "_units", hot_rows=HOT_GROUPS)
    else:
        sent = ends.join(values, "article_id")
    sent = sent.select(
        F.col("_group").alias("_unit"), F.col("article_id").alias("_id"), F.col(column).alias("_value")
    )
    fields = [f for f in pairs.schema.fields if f.name != "_group" and (keep or f.name != "unit")]
    schema = T.StructType(fields if keep else [*fields, T.StructField("score", T.DoubleType())])
    names = [f.name for f in fields]

    def compare(key, sent, pairs):
        place = {
            i: ids_of(zlib.decompress(value).decode(), size).tobytes() if size else value
            for i, value in zip(sent["_id"].to_pylist(), sent["_value"].to_pylist())
        }
        sides = [[place[i] for i in pairs[f"article_id_{end}"].to_pylist()] for end in "ab"]
        found = judge(*sides)
        rows = pairs.select(names)
        return rows.filter(pa.array(found, type=pa.bool_())) if keep else rows.append_column("score", pa.array(found, type=pa.float64()))

    return sent.groupBy("_unit").cogroup(pairs.groupBy("_group")).applyInArrow(compare, schema)


def possible(least: float) -> Callable[[list[bytes], list[bytes]], np.ndarray]:
    """Which sketches leave a similarity of ``least`` or more possible; a sketch follows its set's size, and none rules out nothing."""

    def judge(left: list[bytes | None], right: list[bytes | None]) -> np.ndarray:
        keep = np.ones(len(left), dtype=bool)
        for i, (a, b) in enumerate(zip(left, right)):
            if a is None or b is None:
                continue
            n_a, n_b = (int.from_bytes(x[:4], "little") for x in (a, b))
            keep[i] = similarity(most_common(a[4:], n_a, b[4:], n_b), n_a, n_b) >= least
        return keep

    return judge


def scores(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Jaccard similarity of sets of sorted ids."""
    found = np.zeros(len(left))
    for i, (a, b) in enumerate(zip(left, right)):
        x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
        found[i] = similarity(common(x, y), len(x), len(y))
    return found


def possible_pairs(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs with ``unit`` whose ``sketches(article_id, sketch)`` do not rule out a similarity of ``least``."""
    return per_unit(pairs, sketches.select("article_id", "sketch"), possible(least), keep=True)


def packed(normalized: Column) -> Column:
    """Texts compressed one by one, once for all units that they are sent to; shuffles compress less."""

    @F.pandas_udf("binary")
    def value(texts: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress((text or "").encode(), 1) for text in texts], dtype=object)

    return value(normalized)


def text_rows(pairs: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored keys of all articles in stored ``pairs``, and their texts as ``(article_id, normalized)``.

    When pairs know the stored ``batch`` of their articles, only those batches are read.
    """
    keys = ["article_id", "batch"] if "batch_a" in pairs.columns else ["article_id"]
    ends = [F.struct(*[F.col(f"{k}_{end}").alias(k) for k in keys]) for end in "ab"]
    wanted = materialize(pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*").distinct())
    found = articles.select(*keys, "title", "content").join(wanted, keys, "left_semi")
    return wanted, with_normalized(found).select("article_id", "normalized")


def set_rows(pairs: DataFrame, articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(article_id, ids)``: the shingle set of every article in stored ``pairs``."""
    _, texts = text_rows(pairs, articles)
    return texts.select("article_id", shingle_sets.shingle_ids(F.col("normalized"), params.shingle_size).alias("ids"))


def score_pairs(
    pairs: DataFrame, articles: DataFrame, params: Params = DEFAULT, sketches: DataFrame | None = None, least: float = 0.0
) -> DataFrame:
    """Stored pairs with their Jaccard ``score``, stored.

    With ``sketches`` only pairs at or above ``least`` are given, and sets are made only for pairs
    that the sketches leave.
    """
    cut = pairs if "unit" in pairs.columns else with_units(pairs)
    if sketches is not None and least > 0:
        cut = materialize(possible_pairs(cut, sketches, least))
    wanted, texts = text_rows(cut, articles)
    if "unit" not in pairs.columns and cut.count() > DENSE * wanted.count():
        # It decides on the way of the texts, not on the result.
        cut = family_units(materialize(cut))
    sent = texts.select("article_id", packed(F.col("normalized")).alias("text"))
    scored = per_unit(cut, sent, scores, keep=False, size=params.shingle_size)
    return materialize(scored.where(F.col("score") >= least) if least > 0 else scored)


# --- all similar pairs --------------------------------------------------------


def frequent_shingles(texts: DataFrame, params: Params = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Ids of shingles in several of a sample of the texts ``(normalized, n_shingles)``, with their counts.

    The sample holds about ``SAMPLE`` shingles, and the driver gets at most ``FREQUENT`` ids.
    """
    total = texts.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    some = texts.where(F.pmod(F.xxhash64("normalized"), F.lit(max(int(total) // SAMPLE, 1))) == 0).select("normalized")
    size = params.shingle_size

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counted per task first; what a task holds is bounded by the sample.
        held, rows = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(ids_of(text or "", size))
                rows += len(held[-1])
                if rows >= 4_000_000:
                    yield counted(held)
                    held, rows = [], 0
        if held:
            yield counted(held)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["id", "n"])

    often = some.mapInArrow(ids, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).where("n > 1")
    rows = often.orderBy(F.desc("n"), "id").limit(FREQUENT).toArrow()
    found, counts = rows["id"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(found)
    return found[order], counts[order]


def prefix_rows(articles: DataFrame, sizes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(article_id, n, i, shingle)``: the elements, rarest first, of which similar texts share one.

    ``sizes(article_id, n_shingles)`` is stored and names the articles. One Arrow pass makes a text's
    elements; only they are exploded.
    """
    texts = with_normalized(articles.select("article_id", "title", "content").join(sizes, "article_id"))
    texts = texts.select("article_id", "n_shingles", "normalized")
    found, counts = frequent_shingles(texts, params)
    chosen = shingle_sets.prefix(F.col("normalized"), params.shingle_size, params.threshold, found, counts)
    rows = texts.select("article_id", chosen.alias("p"))
    return rows.select("article_id", F.col("p.n").alias("n"), F.posexplode("p.prefix").alias("i", "shingle"))


def pair_bounds(left: list[bytes], n_left: np.ndarray, right: list[bytes], n_right: np.ndarray) -> np.ndarray:
    """A bound of the similarity of each set of ``left`` with each of ``right``, from their sketches and sizes.

    Sketches are folded to the narrowest of them and multiplied as 0/1 matrices, some columns at a time.
    """
    words = min(map(len, (*left, *right))) // 8

    def folded(sketches: list[bytes]) -> np.ndarray:
        rows = [np.frombuffer(s, dtype=np.uint64).reshape(-1, words) for s in sketches]
        return np.stack([r[0] if len(r) == 1 else np.bitwise_or.reduce(r, axis=0) for r in rows])

    a, b = folded(left), folded(right)
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, words, _WORDS):
        bits = [np.unpackbits(np.ascontiguousarray(x[:, at : at + _WORDS]).view(np.uint8), axis=1).astype(np.float32) for x in (a, b)]
        both += bits[0] @ bits[1].T
    own = [np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b)]
    common = np.minimum((n_left - own[0])[:, None], (n_right - own[1])[None, :]) + both.astype(np.float64)
    return common / (n_left[:, None] + n_right[None, :] - common)


def sketched_pairs(texts: DataFrame, least: float) -> DataFrame:
    """Pairs of stored ``(article_id, n_shingles, sketch)`` that sizes and sketches leave at or above ``least``.

    Every pair of like sizes is bounded, none is listed before. Sizes are classed so that similar texts are in one class or in
    neighbouring ones, classes are cut into blocks of bounded texts and bytes, and tasks read two blocks each from the stored table.
    """
    # The margin keeps a pair exactly at the threshold in neighbouring classes.
    kind = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(-np.log(least)) * (1 + 1e-9))).cast("int") if least < 1 else F.col("n_shingles")
    rows = texts.select("article_id", "n_shingles", "sketch", kind.alias("kind"))
    sizes = rows.groupBy("kind").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(F.length("sketch")) / SKETCH_BYTES)).cast("int").alias("blocks"),
        F.count("*").alias("n"),
    )
    cores = texts.sparkSession.sparkContext.defaultParallelism
    placed = join_groups(rows, sizes, ["kind"], "n").withColumn("block", F.pmod(F.xxhash64("article_id"), "blocks").cast("int"))
    member = F.struct("article_id", "n_shingles", "sketch")
    blocks = materialize(
        placed.repartition(2 * cores, "kind", "block").groupBy("kind", "block").agg(F.collect_list(member).alias("members"))
    )
    left = blocks.select(F.col("kind").alias("k"), F.col("block").alias("i"), F.col("members").alias("a"))
    right = blocks.select(F.col("kind").alias("l"), F.col("block").alias("j"), F.col("members").alias("b"))
    pair = ((F.col("k") == F.col("l")) & (F.col("i") <= F.col("j"))) | (F.col("k") + 1 == F.col("l"))
    same = ((F.col("k") == F.col("l")) & (F.col("i") == F.col("j"))).alias("same")
    units = left.hint("shuffle_replicate_nl").join(right, pair).select(same, "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, counts, sketches = [], [], []
                for c in ("a", "b"):
                    held = batch.column(c)[at].values
                    counts.append(held.field("n_shingles").to_numpy().astype(np.int64))
                    ids.append(held.field("article_id").to_pylist())
                    # A sketch follows its set's size.
                    sketches.append([x[4:] for x in held.field("sketch").to_pylist()])
                near = pair_bounds(sketches[0], counts[0], sketches[1], counts[1]) >= least
                if batch.column("same")[at].as_py():
                    near &= np.arange(len(ids[0]))[:, None] < np.arange(len(ids[1]))[None, :]
                i, j = np.nonzero(near)
                found = [(ids[0][x], ids[1][y], n, m) for x, y, n, m in zip(i.tolist(), j.tolist(), counts[0][i].tolist(), counts[1][j].tolist())]
                found = [f if f[0] < f[1] else (f[1], f[0], f[3], f[2]) for f in found]
                for some in range(0, len(found), 100_000):
                    columns = list(zip(*found[some : some + 100_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=fields)

    fields = pa.schema([("article_id_a", pa.string()), ("article_id_b", pa.string()), ("n_shingles_a", pa.int32()), ("n_shingles_b", pa.int32())])
    with records_per_batch(texts.sparkSession, 4):
        return materialize(units.mapInArrow(compare, "article_id_a string, article_id_b string, n_shingles_a int, n_shingles_b int"))


def similar_text_pairs(texts: DataFrame, articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """All pairs of distinct texts with a Jaccard similarity at or above the threshold, stored, with ``score``.

    Nothing is left to chance: the sketches of all pairs of like sizes bound their similarity, and the sets of
    those that may reach the threshold are compared.
    """
    sizes = materialize(texts.where("n_shingles > 0").select("article_id", "n_shingles", "sketch"))
    return score_pairs(sketched_pairs(sizes, params.threshold), articles, params, sizes, params.threshold)


def found_by(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of articles with ``found``: whether they share a bucket. Buckets are joined to pairs by id, nothing is listed."""
    buckets = texts.select("article_id", "buckets")
    rows = pairs
    for end in "ab":
        rows = rows.join(buckets.select(F.col("article_id").alias(f"article_id_{end}"), F.col("buckets").alias(f"buckets_{end}")), f"article_id_{end}")
    return rows.withColumn("found", F.arrays_overlap("buckets_a", "buckets_b")).drop("buckets_a", "buckets_b")
