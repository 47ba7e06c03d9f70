"""Edges inside LSH buckets without comparing a bucket's texts pair by pair.

Only connectivity matters for clusters, so a bucket of n texts does not need its
n(n-1)/2 comparisons:

1. every member is compared with the bucket's smallest id (n comparisons);
2. members in one component by now need no comparison with each other;
3. members of different components are compared where their sketches leave them possible (``bucket_units``), in
   larger buckets block by block (``block_join``), which writes similar pairs only.

All candidate pairs at or above the threshold end up in one component, exactly as
if every pair had been compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions import similarity as sim
from twinfold.operators.block_join import similar_in_buckets
from twinfold.operators.bucket_units import possible_pairs
from twinfold.operators.candidates import pair_columns
from twinfold.operators.joins import join_groups
from twinfold.params import Params
from twinfold.session import materialize

# Members of a bucket whose pairs across components are listed where sketches leave them.
LISTED = 256


def pivot_pairs(hot: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Each member of a bucket with the bucket's smallest id, as candidate pairs that sizes do not rule out."""
    values = [c for c in hot.columns if c not in ("bucket", "members")]
    smallest = hot.groupBy("bucket").agg(F.min(F.struct(*values)).alias("p"), F.first("members").alias("members"))
    pivots = smallest.select("bucket", "members", *[F.col(f"p.{c}").alias(f"{c}_a") for c in values])
    rest = hot.select("bucket", *[F.col(c).alias(f"{c}_b") for c in values])
    pairs = join_groups(rest, pivots, ["bucket"], "members").where("article_id_a <> article_id_b")
    pairs = pairs.where(sim.size_ratio(F.col("n_shingles_a"), F.col("n_shingles_b")) >= threshold)
    if "fresh" in hot.columns:
        pairs = pairs.where("fresh_a OR fresh_b")
    return pairs.select(*pair_columns(hot)).distinct()


def open_pairs(
    hot: DataFrame, labels: DataFrame, done: DataFrame, articles: DataFrame, params: Params, sketches: DataFrame | None = None
) -> DataFrame:
    """Candidate pairs across components that can still be similar by their ``sketches``, without the pairs ``done``.

    ``labels(article_id, label)`` gives the component of each member so far. Buckets of up to ``LISTED`` members list
    such pairs, which is linear in their rows; larger ones are compared block by block, and of those only pairs that are
    similar and connect something are given. Either way what similar pairs connect is connected, so the choice changes the work only.
    """
    values = [c for c in hot.columns if c not in ("bucket", "members")]
    member = hot.groupBy(*values).agg(F.collect_set("bucket").alias("buckets"))
    member = materialize(
        member.join(labels, "article_id", "left").withColumn("label", F.coalesce("label", "article_id"))
    )
    mixed = (
        member.select(F.explode("buckets").alias("bucket"), "label")
        .groupBy("bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"))
        .where("low <> high")
        .select("bucket", "members")
    )
    rows = materialize(join_groups(hot.drop("members"), mixed, ["bucket"], "members"))
    label = member.select("article_id", "label")
    described = [F.col(c) for c in pair_columns(hot)]
    listed = possible_pairs(rows.where(F.col("members") <= LISTED), sketches, params.threshold, label).select(*described)
    large = rows.where(F.col("members") > LISTED)
    if not large.isEmpty():
        more = similar_in_buckets(large, articles, params, label, sketches).select("article_id_a", "article_id_b")
        for end in "ab":
            more = more.join(member.select(*[F.col(c).alias(f"{c}_{end}") for c in values]), f"article_id_{end}")
        listed = listed.unionByName(more.select(*described)).distinct()
    return listed.join(done.select("article_id_a", "article_id_b"), ["article_id_a", "article_id_b"], "left_anti").select(*described)
