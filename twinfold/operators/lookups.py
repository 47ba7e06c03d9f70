"""Reading results: article with its cluster, similar articles, cluster with its members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.operators.joins import join_groups, keep_ids, rank_within
from twinfold.session import materialize

# Members of a cluster that one task joins.
CHUNK = 10_000


def cluster_members(articles: DataFrame, size: int | None = None) -> DataFrame:
    """Articles of each cluster with their ``rank``, newest first.

    With ``size`` only the first ones; each task cuts its own before the shuffle.
    """
    order = [F.desc("publish_time"), F.asc("article_id")]
    rows = articles.where("cluster_id IS NOT NULL")
    if size is None:
        return rank_within(rows, "cluster_id", order)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= size)


def article_detail(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Articles (without text) with their cluster record, null when there is none."""
    head = clusters.select(
        "cluster_id", "size", F.struct("size", "representative_article_id", "top_terms", "last_updated").alias("cluster")
    )
    return join_groups(articles, head, ["cluster_id"], "size", how="left").drop("size").withColumns(
        {
            "state": F.coalesce("state", F.lit(1)),
            "top": F.coalesce("top", F.lit(0)),
            "cluster_status": F.coalesce("cluster_status", F.lit("pending")),
        }
    )


def similar_articles(articles: DataFrame, ids: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """For each matched article (of ``ids``) the other members of its cluster, newest first.

    All members, or those among the cluster's first ``size``. Only the clusters of the
    asked articles are read; asked articles meet their cluster's members chunk by chunk.
    """
    matched = articles.where("cluster_id IS NOT NULL")
    ready = matched.where("cluster_status <> 'pending'").select("article_id", "cluster_id")
    if ids is not None:
        ready = materialize(keep_ids(ready, ids))
        matched = keep_ids(matched, materialize(ready.select("cluster_id").distinct()), "cluster_id")
    members = materialize(cluster_members(matched, size).select(
        "cluster_id", "rank", F.col("article_id").alias("similar_id"), "title",
        F.coalesce("similarity_score", F.lit(0.0)).alias("similarity_score"),
    ))
    chunk = F.floor((F.col("rank") - 1) / F.lit(CHUNK)).cast("int")
    sizes = members.groupBy("cluster_id").agg(F.max(chunk).alias("last"))
    own = members.select(F.col("similar_id").alias("article_id"), F.col("rank").alias("own_rank"))
    asked = ready.join(own, "article_id", "left").join(sizes, "cluster_id").select(
        "article_id", "cluster_id", "own_rank", F.explode(F.sequence(F.lit(0), "last")).alias("_c")
    )
    rows = asked.join(members.withColumn("_c", chunk), ["cluster_id", "_c"]).where("article_id <> similar_id")
    own_before = F.coalesce((F.col("own_rank") < F.col("rank")).cast("int"), F.lit(0))
    return rows.select(
        "article_id", "cluster_id", (F.col("rank") - own_before).alias("rank"), "similar_id", "title", "similarity_score"
    )


def similar_members(articles: DataFrame) -> DataFrame:
    """One row per matched article with its cluster and ``rank``, newest first.

    The rows of a cluster are the similar articles of each of its articles, without listing them per article.
    """
    score = F.coalesce("similarity_score", F.lit(0.0))
    return cluster_members(articles).select("article_id", "cluster_id", "rank", "title", score.alias("similarity_score"))


def cluster_detail(clusters: DataFrame, articles: DataFrame, ids: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Cluster records (of the ``cluster_id``s in ``ids``) with a row per member, newest first, or the first ``size``."""
    if ids is not None:
        clusters, articles = (keep_ids(rows, ids, "cluster_id") for rows in (clusters, articles))
    shown = cluster_members(articles, size).select("cluster_id", "rank", "article_id", "similarity_score", "cluster_status")
    heads = clusters.withColumn("members", F.col("size"))
    return join_groups(shown, heads, ["cluster_id"], "members").drop("members")
