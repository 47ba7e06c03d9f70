"""Candidate pairs from equal bands, and their verification by exact Jaccard similarity."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions import shingle_sets
from twinfold.functions import similarity as sim
from twinfold.operators.block_join import similar_in_buckets
from twinfold.operators.bucket_units import near_texts, possible_pairs
from twinfold.operators.features import with_normalized
from twinfold.operators.joins import join_groups, split_pairs
from twinfold.operators.set_join import UNIT, score_pairs
from twinfold.params import DEFAULT, Params
from twinfold.session import materialize

# Members of one bucket compared within one task.
CHUNK = 2_000
# Texts of a bucket whose pairs are listed; it decides on the way, not on the result.
LISTED = 256
# SimHash values of one block whose pairs are compared; it decides on the way, not on the result.
LISTED_VALUES = 256


def bucket_rows(texts: DataFrame, *extra: str) -> DataFrame:
    """One row per (bucket, distinct text)."""
    return texts.select(F.explode("buckets").alias("bucket"), "article_id", "simhash", "n_shingles", *extra)


def bucket_members(rows: DataFrame, total: int | None = None) -> DataFrame:
    """Rows of buckets with two or more texts, with ``members``, the number of texts.

    Buckets are counted first, from numbers alone: most have one text, and their rows
    end in the join. ``total`` bounds the number of rows. With a boolean ``fresh`` column, only buckets with a fresh text are kept.
    """
    fresh = F.max("fresh") if "fresh" in rows.columns else F.lit(True)
    stats = (
        rows.groupBy("bucket")
        .agg(F.count("*").alias("members"), fresh.alias("wanted"))
        .where("members >= 2 AND wanted")
        .drop("wanted")
    )
    return join_groups(rows, stats, ["bucket"], "members", total=total)


def stored_members(texts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Bucket members of stored text groups, stored."""
    return materialize(bucket_members(bucket_rows(texts), texts.count() * params.bands))


def pair_columns(rows: DataFrame) -> list[str]:
    """The columns that describe a pair made of two member rows."""
    names = [c for c in rows.columns if c not in ("bucket", "members")]
    return [f"{name}_{end}" for name in names for end in "ab"]


def bucket_pairs(members: DataFrame, threshold: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """Pairs of distinct texts per shared bucket; ``unit`` names a bounded part of the bucket that holds both.

    Pairs whose sizes rule ``threshold`` out are left out, and so are pairs without a fresh text.
    """
    pairs = split_pairs(members, ["bucket"], "members", "article_id", chunk)
    if threshold > 0:
        pairs = pairs.where(sim.size_ratio(F.col("n_shingles_a"), F.col("n_shingles_b")) >= threshold)
    if "fresh" in members.columns:
        pairs = pairs.where("fresh_a OR fresh_b")
    parts = F.ceil(F.col("members_a") / UNIT)
    part = [F.pmod(F.xxhash64(f"article_id_{end}"), parts) for end in "ab"]
    return pairs.withColumn("unit", F.xxhash64("bucket", *part)).drop("members_a", "members_b")


def candidate_pairs(members: DataFrame, threshold: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """Distinct candidate pairs with the number of bands they share and one ``unit`` for their comparison."""
    pairs = bucket_pairs(members, threshold, chunk)
    return pairs.groupBy(*pair_columns(members)).agg(F.count("*").alias("shared_bands"), F.min("unit").alias("unit"))


def candidates(texts: DataFrame) -> DataFrame:
    """All pairs of distinct texts sharing a band, from text groups."""
    return candidate_pairs(stored_members(texts))


def hamming_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("distance", sim.hamming(F.col("simhash_a"), F.col("simhash_b")))


def scores_against(pairs: DataFrame, articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Stored ``(article_id, rep_id)`` rows with the Jaccard ``score`` of the two texts, stored.

    An article's text travels once, and that of a representative once per salt. When pairs know the stored
    ``batch`` and ``rep_batch``, only those batches are read.
    """
    keys = ["article_id", "batch"] if "batch" in pairs.columns else ["article_id"]
    rep_keys = ["rep_id", "rep_batch"][: len(keys)]
    read = articles.select(*keys, "title", "content")
    sizes = materialize(pairs.groupBy(*rep_keys).agg(F.count("*").alias("size")))

    def normalized(rows: DataFrame) -> DataFrame:
        """Texts of the rows alone: the others are left out before anything is made of them."""
        return with_normalized(read.join(rows.select(*keys), keys, "left_semi")).select(*keys, "normalized")

    own = pairs.join(normalized(pairs).withColumnRenamed("normalized", "own"), keys).select("article_id", "rep_id", "own")
    named = sizes.select(*[F.col(r).alias(k) for r, k in zip(rep_keys, keys)])
    reps = sizes.join(normalized(named).toDF(*rep_keys, "rep"), rep_keys).select("rep_id", "rep", "size")
    joined = join_groups(own, reps, ["rep_id"], "size")
    score = shingle_sets.text_similarity(F.col("own"), F.col("rep"), params.shingle_size)
    return materialize(joined.select("article_id", "rep_id", score.alias("score")))


def similar_pairs(texts: DataFrame, articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Candidate pairs with Jaccard at or above the threshold, stored.

    Buckets of up to ``LISTED`` texts give the pairs that sketches leave; larger ones are compared block by block, which writes
    similar pairs only.
    """
    members = stored_members(texts, params)
    small = F.col("members") <= LISTED
    pairs = materialize(possible_pairs(members.where(small), texts, params.threshold))
    scored = score_pairs(pairs, articles, params, least=params.threshold)
    large = members.where(~small)
    if large.isEmpty():
        return scored
    ids = ["article_id_a", "article_id_b"]
    found = similar_in_buckets(large, articles, params, sketches=texts)
    found = materialize(scored.select(*ids, "score").unionByName(found.join(scored.select(*ids), ids, "left_anti")))
    for end in "ab":
        found = found.join(
            texts.select(*[F.col(c).alias(f"{c}_{end}") for c in ("article_id", "simhash", "n_shingles", "buckets")]), f"article_id_{end}"
        )
    # A pair may share small and large buckets, so they are counted again.
    shared = F.size(F.array_intersect("buckets_a", "buckets_b")).cast("bigint")
    return materialize(found.withColumn("shared_bands", shared).select(*scored.columns))


def both_ways(pairs: DataFrame, *values: str) -> DataFrame:
    """Each pair seen from either end: ``(article_id, other_id, values...)``."""
    ends = F.array(
        F.struct(F.col("article_id_a").alias("article_id"), F.col("article_id_b").alias("other_id")),
        F.struct(F.col("article_id_b").alias("article_id"), F.col("article_id_a").alias("other_id")),
    )
    return pairs.select(F.explode(ends).alias("end"), *values).select("end.*", *values)


def first_ids(features: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest article ids of each text; cut per task before the shuffle."""
    order = Window.partitionBy("text_key").orderBy("article_id")
    ranked = features.select("text_key", "article_id", F.row_number().over(order).alias("copy_no"))
    return ranked.where(F.col("copy_no") <= k)


def lsh_topk(features: DataFrame, texts: DataFrame, k: int = 50) -> DataFrame:
    """Up to ``k`` candidates per article: most shared bands first, then article id.

    Copies of one text share the same number of bands with any article, so only the
    first k + 1 ids of each text can appear in a list; lists stay exact without
    pairing the copies of two texts with each other.
    """
    keys = texts.select("article_id", "text_key", "copies", F.size("buckets").alias("n_bands"))
    near = both_ways(candidates(texts), "shared_bands")
    own = keys.where("n_bands > 0 and copies > 1").select(
        "article_id", F.col("article_id").alias("other_id"), F.col("n_bands").cast("bigint").alias("shared_bands")
    )
    # A text's links are named by its smallest id, so what the first k + 1 links of a list hold precedes all other links.
    first_links = Window.partitionBy("article_id").orderBy(F.desc("shared_bands"), "other_id")
    links = near.unionByName(own).withColumn("_rank", F.row_number().over(first_links)).where(F.col("_rank") <= k + 1)
    links = materialize(links.drop("_rank"))
    first = first_ids(features, k + 1).groupBy("text_key").agg(F.collect_list("article_id").alias("ids"))
    degree = links.groupBy("other_id").agg(F.count("*").alias("degree"))
    partners = materialize(
        keys.select(F.col("article_id").alias("other_id"), "text_key").join(degree, "other_id").join(first, "text_key").drop("text_key")
    )
    listed = join_groups(links, partners, ["other_id"], "degree").select(
        "article_id", F.explode("ids").alias("candidate_id"), "shared_bands"
    )
    best = Window.partitionBy("article_id").orderBy(F.desc("shared_bands"), "candidate_id")
    short = listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = short.groupBy("article_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "shared_bands"))).alias("listed")
    )
    per_text = keys.join(lists, "article_id").select("text_key", "copies", "listed")
    per_article = join_groups(features.select("article_id", "text_key"), per_text, ["text_key"], "copies")
    others = F.filter("listed", lambda c: c["candidate_id"] != F.col("article_id"))
    ranked = per_article.select("article_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "c"))
    return ranked.select(
        "article_id", "c.candidate_id", "c.shared_bands", (F.col("pos") + 1).alias("rank")
    )


def _free_bits(mask: int) -> list[int]:
    return [i for i in range(64) if not mask >> i & 1]


def _deeper(mask: int, distance: int, blocks: int) -> list[int]:
    """``mask`` with each choice of ``blocks - distance`` of the blocks that its free bits are cut into."""
    free = _free_bits(mask)
    cuts = [free[len(free) * i // blocks : len(free) * (i + 1) // blocks] for i in range(blocks)]
    return sorted({
        mask | sum(1 << bit for cut in chosen for bit in cut) for chosen in combinations(cuts, blocks - distance)
    })


def near_blocks(values: DataFrame, distance: int, blocks: int, listed: int = LISTED_VALUES) -> list[DataFrame]:
    """Groups (``mask, bits``) of at most ``listed`` of the distinct ``simhash`` values, equal in the bits of the mask, stored.

    Values that differ in at most ``distance`` bits share a group. A larger group is cut again by the bits that its mask leaves free:
    of their blocks, too, only ``distance`` can differ. Each step fixes about half of the free bits, so it ends
    where they can tell no more than ``listed`` values apart, after three steps with the values given here.
    """
    if not 0 <= distance < blocks:
        raise ValueError("distance must be below the number of blocks")
    signed = lambda mask: mask - (1 << 64) if mask >= 1 << 63 else mask
    schema = "mask bigint, deeper array<bigint>"
    todo, groups = values.withColumn("mask", F.lit(0).cast("long")), []
    masks = [0]
    while masks:
        # One row per mask: it depends on the number of blocks and steps, not on the data.
        steps = values.sparkSession.createDataFrame([(signed(m), [signed(d) for d in _deeper(m, distance, blocks)]) for m in masks], schema)
        keyed = todo.join(F.broadcast(steps), "mask").select(F.explode("deeper").alias("mask"), "simhash", "articles")
        keyed = keyed.withColumn("bits", F.col("simhash").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("members")).where("members >= 2")
        shared = materialize(join_groups(keyed, sizes, ["mask", "bits"], "members"))
        free = F.lit(64) - F.bit_count("mask")
        small = (F.col("members") <= listed) | (free < blocks)
        groups.append(shared.where(small))
        todo = shared.where(~small).select("mask", "simhash", "articles")
        masks = [r.mask & (1 << 64) - 1 for r in todo.select("mask").distinct().collect()]
    return groups


def near_simhash(texts: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs of SimHash values that differ in 1 to ``distance`` bits, exactly.

    With ``blocks`` blocks and at most ``distance`` differing bits, some
    ``blocks - distance`` blocks are equal. Each choice of that many blocks is one
    join key: about half of all bits, so keys stay selective for billions of values; keys that many values share are
    cut by further bits (``near_blocks``).
    Works on distinct values; ``articles_a`` and ``articles_b`` give their weight.
    """
    values = materialize(texts.groupBy("simhash").agg(F.sum("copies").alias("articles")))
    groups = reduce(DataFrame.unionByName, near_blocks(values, distance, blocks))
    pairs = split_pairs(groups, ["mask", "bits"], "members", "simhash", CHUNK)
    pairs = pairs.withColumn("distance", sim.hamming(F.col("simhash_a"), F.col("simhash_b")))
    return (
        pairs.where(F.col("distance") <= distance)
        .select("simhash_a", "simhash_b", "distance", "articles_a", "articles_b")
        .distinct()
    )


def classify_articles(
    features: DataFrame, texts: DataFrame, articles: DataFrame, params: Params = DEFAULT
) -> DataFrame:
    """Verdict per article against its candidates: duplicate 1.0, similar with best score, or unique 0.0."""
    members = stored_members(texts, params)
    near = materialize(near_texts(members, params.hamming)).withColumn("near", F.lit(True))
    copied = (F.col("copies") > 1) & (F.size("buckets") > 0)
    known = texts.join(near, "article_id", "left").withColumn("duplicate", copied | F.coalesce("near", F.lit(False)))
    known = materialize(known.select("article_id", "text_key", "copies", "duplicate"))
    # A score changes no verdict of a duplicate, and none below the threshold changes any, so only pairs that may are compared.
    open_ = materialize(members.join(known.select("article_id", (~F.col("duplicate")).alias("fresh")), "article_id"))
    small = F.col("members") <= LISTED
    scored = score_pairs(
        materialize(possible_pairs(open_.where(small), texts, params.threshold)), articles, params, least=params.threshold
    ).select("article_id_a", "article_id_b", "score")
    large = open_.where(~small)
    if not large.isEmpty():
        scored = scored.unionByName(similar_in_buckets(large, articles, params, sketches=texts))
    best = both_ways(scored, "score").groupBy("article_id").agg(F.max("score").alias("best"))
    similar = F.coalesce(F.col("best") >= params.threshold, F.lit(False))
    per_text = known.join(best, "article_id", "left").select(
        "text_key", "copies",
        F.when(F.col("duplicate"), "duplicate").when(similar, "similar").otherwise("unique").alias("verdict"),
        F.when(F.col("duplicate"), 1.0).when(similar, F.col("best")).otherwise(0.0).alias("score"),
    )
    rows = features.select("article_id", "text_key")
    return join_groups(rows, per_text, ["text_key"], "copies").select("article_id", "verdict", "score")
