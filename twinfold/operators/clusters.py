"""Clusters: exact and verified edges, components, per-article result, cluster records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions import fingerprints as fp
from twinfold.functions import text as tx
from twinfold.operators import candidates as cand
from twinfold.operators import bucket_units, hot_buckets
from twinfold.operators.components import connected_components
from twinfold.operators.features import extract_features, simhash_groups, text_groups
from twinfold.operators.joins import join_groups, keep_ids
from twinfold.params import DEFAULT, Params
from twinfold.session import materialize

# Texts of a bucket whose pairs are listed; it decides on the way, not on the result.
LISTED = 64


def cluster_name(article_id: Column) -> Column:
    return F.concat(F.lit("cluster_"), article_id)


def simhash_star(texts: DataFrame) -> DataFrame:
    """Equal-SimHash links, each text to the smallest id of its group: linear, not all pairs."""
    groups = simhash_groups(texts)
    rows = texts.select("article_id", "simhash")
    return join_groups(rows, groups, ["simhash"], "texts").where("article_id <> root").select(
        F.col("article_id").alias("u"), F.col("root").alias("v")
    )


def verified_edges(
    rows: DataFrame, articles: DataFrame, params: Params, links: DataFrame | None = None, total: int | None = None,
    sketches: DataFrame | None = None,
) -> DataFrame:
    """Verified pairs of distinct texts that connect all that their buckets connect, with their ``score``.

    ``rows`` are bucket rows; with a ``fresh`` column only pairs with a fresh text count.
    Not every similar pair is among them, but their components are those of all similar pairs. Buckets of up to
    ``LISTED`` texts give the pairs that sketches leave; in larger ones texts are compared with one of them first, and only what that
    leaves open with each other. ``links(u, v)`` are connections between
    article ids that are known already and need no comparison. ``total`` bounds the rows;
    ``sketches(article_id, sketch)`` spare the comparison of texts that they show to be too different.
    """
    members = materialize(cand.bucket_members(rows, total))
    small = F.col("members") <= LISTED
    listed = materialize(bucket_units.possible_pairs(members.where(small), sketches, params.threshold))
    edges = cand.score_pairs(listed, articles, params, least=params.threshold)
    larger = members.where(~small)
    if larger.isEmpty():
        return edges
    columns = cand.pair_columns(members)
    pairs = hot_buckets.pivot_pairs(larger, params.threshold).join(listed, ["article_id_a", "article_id_b"], "left_anti")
    pairs = materialize(pairs.select(*columns))
    edges = edges.select(*columns, "score").unionByName(cand.score_pairs(pairs, articles, params, sketches, params.threshold))
    known = edges.select(F.col("article_id_a").alias("u"), F.col("article_id_b").alias("v"))
    if links is not None:
        known = known.unionByName(keep_ids(links, members.select(F.col("article_id").alias("u")), "u"))
    labels = connected_components(known).select(F.col("node").alias("article_id"), F.col("component").alias("label"))
    done = listed.select(*columns).unionByName(pairs)
    more = materialize(hot_buckets.open_pairs(larger, labels, done, articles, params, sketches))
    return edges.unionByName(cand.score_pairs(more, articles, params, least=params.threshold))


@dataclass
class Clustering:
    """Stored intermediate tables and the per-article result."""

    features: DataFrame
    texts: DataFrame
    edges: DataFrame
    assigned: DataFrame


def node_results(
    texts: DataFrame, edges: DataFrame, articles: DataFrame, params: Params = DEFAULT, verify_exact: bool = False
) -> DataFrame:
    """Cluster and score per clustered node: ``(node key, articles, cluster_id, similarity_score)``.

    The score is 1.0 for a node of several articles, otherwise the Jaccard similarity with the
    cluster's representative, its smallest article id: one comparison per node.

    A node is a group of articles taken as duplicates: equal SimHash, or equal
    text when ``verify_exact``. Groups are contracted before the component search,
    so a group with very many copies is one node in it.
    """
    key = "text_key" if verify_exact else "simhash"
    nodes = texts.where("n_shingles > 0") if verify_exact else texts
    nodes = nodes.groupBy(key).agg(F.min("article_id").alias("root"), F.sum("copies").alias("articles"))
    if verify_exact:
        ids = texts.select("article_id", "text_key")
        for end in "ab":
            edges = edges.join(
                ids.select(F.col("article_id").alias(f"article_id_{end}"), F.col("text_key").alias(f"text_key_{end}")),
                f"article_id_{end}",
            )
    links = edges.select(F.col(f"{key}_a").alias("u"), F.col(f"{key}_b").alias("v"))
    labels = connected_components(links)
    # Most nodes are single articles without an edge: they leave here, before the next shuffle.
    clustered = (
        nodes.join(labels.select(F.col("node").alias(key), "component"), key, "left")
        .where("component IS NOT NULL OR articles > 1")
        .withColumn("component", F.coalesce("component", key))
    )
    sizes = clustered.groupBy("component").agg(F.min("root").alias("first_id"), F.count("*").alias("nodes"))
    placed = materialize(join_groups(clustered, sizes, ["component"], "nodes"))
    alone = placed.where("articles = 1 AND root <> first_id")
    compared = cand.scores_against(
        materialize(alone.select(F.col("root").alias("article_id"), F.col("first_id").alias("rep_id"))), articles, params
    )
    return placed.join(compared.select(F.col("article_id").alias("root"), "score"), "root", "left").select(
        key, "articles",
        cluster_name(F.col("first_id")).alias("cluster_id"),
        F.coalesce("score", F.lit(1.0)).alias("similarity_score"),
    )


def cluster_scores(rows: DataFrame, articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``(article_id, score)`` of stored ``(article_id, simhash, cluster_id)`` rows that hold whole clusters.

    1.0 with another article of equal SimHash in the cluster, otherwise the Jaccard similarity
    with the cluster's smallest article id (1.0 for that one).
    """
    heads = rows.groupBy("cluster_id").agg(F.min("article_id").alias("rep_id"), F.count("*").alias("size"))
    same = rows.groupBy("cluster_id", "simhash").agg(F.count("*").alias("alike"))
    placed = join_groups(rows, heads, ["cluster_id"], "size")
    placed = join_groups(placed, same, ["cluster_id", "simhash"], "alike")
    placed = materialize(
        placed.select("article_id", "rep_id", ((F.col("alike") > 1) | (F.col("article_id") == F.col("rep_id"))).alias("exact"))
    )
    compared = cand.scores_against(placed.where("NOT exact").select("article_id", "rep_id"), articles, params)
    return placed.where("exact").select("article_id", F.lit(1.0).alias("score")).unionByName(compared.select("article_id", "score"))


def assign_clusters(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Final state per article: matched with cluster and score, or unique with nulls."""
    key = "text_key" if "text_key" in nodes.columns else "simhash"
    return join_groups(features, nodes, [key], "articles", how="left", total=features.count()).withColumn(
        "cluster_status", F.when(F.col("cluster_id").isNull(), "unique").otherwise("matched")
    ).drop("articles")


def cluster(articles: DataFrame, params: Params = DEFAULT, verify_exact: bool = False) -> Clustering:
    features = materialize(extract_features(articles, params))
    texts = materialize(text_groups(features))
    links = None if verify_exact else simhash_star(texts)
    edges = verified_edges(cand.bucket_rows(texts), articles, params, links, texts.count() * params.bands, texts)
    nodes = node_results(texts, edges, articles, params, verify_exact)
    return Clustering(features, texts, edges, assign_clusters(features, nodes))


def cluster_articles(articles: DataFrame, params: Params = DEFAULT, verify_exact: bool = False) -> DataFrame:
    """Article rows without text, with features, ``cluster_id``, ``cluster_status``, ``similarity_score``."""
    return cluster(articles, params, verify_exact).assigned


def duplicate_clusters(features: DataFrame) -> DataFrame:
    """Clusters from equal SimHash alone: every member scores 1.0."""
    groups = simhash_groups(text_groups(features)).where("articles > 1")
    return join_groups(features, groups, ["simhash"], "articles").select(
        "article_id", "simhash", cluster_name(F.col("root")).alias("cluster_id"), F.lit(1.0).alias("similarity_score")
    )


def exact_components(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """Components over article ids of distinct texts: equal-SimHash links and verified pairs."""
    links = edges.select(F.col("article_id_a").alias("u"), F.col("article_id_b").alias("v"))
    return connected_components(links.unionByName(simhash_star(texts)))


def article_components(features: DataFrame, texts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(article_id, component)`` of every article with another one: copies too, and texts that only have copies."""
    found = exact_components(texts, edges).select(F.col("node").alias("article_id"), "component")
    grouped = (
        texts.select("article_id", "text_key", "copies").join(found, "article_id", "left")
        .where("component IS NOT NULL OR copies > 1")
        .select("text_key", "copies", F.coalesce("component", "article_id").alias("component"))
    )
    return join_groups(features.select("article_id", "text_key"), grouped, ["text_key"], "copies").select("article_id", "component")


def build_clusters(assigned: DataFrame, articles: DataFrame) -> DataFrame:
    """One record per cluster. Its members are the rows of ``assigned`` with its ``cluster_id``."""
    rows = assigned.where("cluster_id IS NOT NULL").select(
        "cluster_id", "article_id", "publish_time", "created_at", "updated_at"
    )
    head = materialize(
        rows.groupBy("cluster_id").agg(
            F.count("*").alias("size"),
            F.min(F.struct("publish_time", "article_id")).alias("first"),
            F.max("updated_at").alias("last_updated"),
            F.min("created_at").alias("created_at"),
        ).select("cluster_id", "size", F.col("first.article_id").alias("representative_article_id"), "last_updated", "created_at")
    )
    reps = head.select(F.col("representative_article_id").alias("article_id")).distinct()
    terms = keep_ids(articles.select("article_id", "title", "content"), reps).select(
        F.col("article_id").alias("representative_article_id"), fp.top_terms(tx.full_text()).alias("top_terms")
    )
    return head.join(terms, "representative_article_id", "left").select(
        "cluster_id", "size", "representative_article_id", "top_terms", "last_updated", "created_at"
    )


def merge_members(members: DataFrame, additions: DataFrame) -> DataFrame:
    """Add ``(cluster_id, article_id)`` rows without repeats; returns the members of all clusters."""
    return members.select("cluster_id", "article_id").unionByName(additions.select("cluster_id", "article_id")).distinct()


def member_sizes(members: DataFrame) -> DataFrame:
    """Stored distinct membership rows with the ``size`` of their cluster."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return join_groups(members, sizes.withColumn("rows", F.col("size")), ["cluster_id"], "rows").drop("rows")


def unmatched_articles(assigned: DataFrame) -> DataFrame:
    """Articles without any similar one: each needs a cluster of its own."""
    return assigned.where("cluster_status = 'unique'").select("article_id")


def best_cluster(similar: DataFrame) -> DataFrame:
    """Best existing cluster per article: highest average score, over similar articles.

    ``similar`` has ``(article_id, cluster_id, score)`` rows; with ``copies`` a row stands for that many articles.
    """
    copies = F.col("copies") if "copies" in similar.columns else F.lit(1)
    averages = similar.where("cluster_id IS NOT NULL").groupBy("article_id", "cluster_id").agg(
        F.round(F.sum(F.col("score") * copies) / F.sum(copies), 9).alias("avg_score"), F.sum(copies).alias("articles")
    )
    order = Window.partitionBy("article_id").orderBy(F.desc("avg_score"), "cluster_id")
    return averages.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def split_left(kept: DataFrame, left: DataFrame, articles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``kept`` with the clusters in stored ``left``, which have lost members, computed again from those that remain.

    Only those clusters are compared. Members that nothing else connects fall apart: the part with the
    cluster's smallest remaining article id keeps the cluster's id, another one is named after its own smallest
    article id, and an article alone has no cluster.
    """
    rest = materialize(keep_ids(kept.where("cluster_id IS NOT NULL"), left, "cluster_id"))
    if rest.isEmpty():
        return kept
    texts = materialize(text_groups(rest))
    edges = verified_edges(cand.bucket_rows(texts), articles, params, simhash_star(texts), None, texts)
    found = article_components(rest, texts, edges)
    parts = materialize(rest.select("article_id", "cluster_id").join(found, "article_id", "left"))
    # A part lies in one cluster: parts are not merged here.
    heads = parts.groupBy("cluster_id", "component").agg(F.min("article_id").alias("first_id"), F.count("*").alias("size"))
    heads = materialize(heads.where("component IS NOT NULL AND size > 1"))
    firsts = parts.groupBy("cluster_id").agg(F.min("article_id").alias("cluster_first"))
    named = heads.join(firsts, "cluster_id").select(
        "cluster_id", "component", "size",
        F.when(F.col("first_id") == F.col("cluster_first"), F.col("cluster_id")).otherwise(cluster_name(F.col("first_id"))).alias("part_id"),
    )
    renamed = materialize(join_groups(parts, materialize(named), ["cluster_id", "component"], "size", how="left").select("article_id", "part_id"))
    moved = rest.join(renamed, "article_id").withColumn("cluster_id", F.col("part_id"))
    moved = moved.withColumn("similarity_score", F.when(F.col("part_id").isNotNull(), F.col("similarity_score"))).drop("part_id")
    others = kept.join(rest.select("article_id"), "article_id", "left_anti")
    return materialize(others.unionByName(moved.select(*others.columns)))


def recheck(
    assigned: DataFrame, articles: DataFrame, ids: DataFrame, params: Params = DEFAULT, split: bool = False
) -> DataFrame:
    """Cluster the articles in ``ids`` again from their current text; the new state of every article.

    The given articles leave their clusters, get new fingerprints and candidates among
    all articles, and join or merge the clusters of the verified ones. The equal-SimHash
    shortcut is not taken. Other articles keep their cluster unless it is merged; with ``split`` a cluster
    that the leaving articles held together falls into its parts first. Scores follow
    ``cluster_scores``; only clusters that lost, got or merged articles are scored. ``assigned`` must be stored.
    """
    fields = ["article_id", "text_key", "simhash", "n_shingles", "buckets", "sketch"]
    fresh = materialize(extract_features(keep_ids(articles, ids), params).select(*fields))
    kept = assigned.join(ids.select("article_id"), "article_id", "left_anti").select(
        *fields, "cluster_id", "similarity_score"
    )
    left = materialize(
        keep_ids(assigned.where("cluster_id IS NOT NULL").select("article_id", "cluster_id"), ids).select("cluster_id").distinct()
    )
    before = kept
    if split:
        kept = split_left(kept, left, articles, params)
    # Only articles that share a bucket with a rechecked one can be concerned.
    wanted = materialize(fresh.select(F.explode("buckets").alias("bucket")).distinct())
    near = keep_ids(kept.select(F.explode("buckets").alias("bucket"), "article_id"), wanted, "bucket")
    near_rows = keep_ids(kept, materialize(near.select("article_id").distinct()))
    rows = materialize(
        fresh.select(
            *fields, F.lit(None).cast("string").alias("cluster_id"), F.lit(None).cast("double").alias("similarity_score"),
            F.lit(True).alias("again"),
        ).unionByName(near_rows.withColumn("again", F.lit(False)))
    )
    total = rows.count()
    again = rows.groupBy("text_key").agg(F.max("again").alias("fresh"))
    texts = materialize(text_groups(rows).where("n_shingles > 0").join(again, "text_key"))
    by_cluster = near_rows.where("cluster_id IS NOT NULL").select(F.col("article_id").alias("u"), F.col("cluster_id").alias("v"))
    edges = verified_edges(cand.bucket_rows(texts, "fresh"), articles, params, by_cluster, total * params.bands, texts)
    ends = F.array(
        F.struct(F.col("article_id_a").alias("article_id"), "score"),
        F.struct(F.col("article_id_b").alias("article_id"), "score"),
    )
    paired = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("article_id").agg(F.max("score").alias("score"))
    touched = materialize(
        texts.join(paired, "article_id", "left")
        .withColumn("best", F.when(F.col("fresh") & (F.col("copies") > 1), 1.0).otherwise(F.col("score")))
        .where("best IS NOT NULL")
        .select("text_key", "copies", "best", F.col("article_id").alias("text_id"))
    )
    # Components over texts, existing clusters and single articles. Names of existing
    # clusters sort before "~", so a merged component takes the smallest of them.
    member = F.coalesce("cluster_id", F.concat(F.lit("~"), F.col("article_id")))
    in_texts = join_groups(rows, touched, ["text_key"], "copies", total=total)
    text_node = F.concat(F.lit("~~"), F.col("text_id"))
    links = in_texts.select(text_node.alias("u"), member.alias("v")).distinct()
    across = edges.select(
        F.concat(F.lit("~~"), F.col("article_id_a")).alias("u"), F.concat(F.lit("~~"), F.col("article_id_b")).alias("v")
    )
    labels = connected_components(links.unionByName(across))
    single = F.when(F.col("node").startswith("~") & ~F.col("node").startswith("~~"), F.substring("node", 2, 1 << 30))
    names = labels.groupBy("component").agg(F.min(single).alias("first_id")).select(
        "component",
        F.when(F.col("component").startswith("~"), cluster_name(F.col("first_id"))).otherwise(F.col("component")).alias("new_id"),
    )
    named = materialize(labels.join(names, "component").select("node", "new_id"))
    by_text = touched.join(named, text_node == F.col("node")).select("text_key", "copies", "best", "new_id")
    found = materialize(
        join_groups(rows, by_text, ["text_key"], "copies", total=total).select("article_id", "best", "new_id")
    )
    merged = materialize(
        named.where("node <> new_id AND NOT startswith(node, '~')").select(
            F.col("node").alias("cluster_id"), F.col("new_id").alias("merged_id")
        )
    )
    sizes = keep_ids(kept, merged, "cluster_id").groupBy("cluster_id").agg(F.count("*").alias("size"))
    renamed = materialize(merged.join(sizes, "cluster_id"))
    empty = [F.lit(None).cast("string").alias("cluster_id"), F.lit(None).cast("double").alias("similarity_score")]
    state = join_groups(kept, renamed, ["cluster_id"], "size", how="left").drop("size").unionByName(
        fresh.select(*fields, *empty, F.lit(None).cast("string").alias("merged_id"))
    )
    state = materialize(
        state.join(found.select("article_id", "new_id"), "article_id", "left")
        .withColumn("cluster_id", F.coalesce("new_id", "merged_id", "cluster_id")).select(*fields, "cluster_id", "similarity_score")
    )
    if split:  # the parts of a cluster that fell apart are scored too
        was = before.select("article_id", F.col("cluster_id").alias("was"))
        new = kept.join(was, "article_id").where("cluster_id IS NOT NULL AND cluster_id <> was").select("cluster_id")
        left = left.unionByName(new)
    changed = materialize(
        left.unionByName(found.select(F.col("new_id").alias("cluster_id"))).unionByName(merged.select(F.col("merged_id").alias("cluster_id"))).distinct()
    )
    rows = keep_ids(state.select("article_id", "simhash", "cluster_id"), changed, "cluster_id")
    scores = cluster_scores(materialize(rows), articles, params)
    return state.join(scores, "article_id", "left").select(
        *fields, "cluster_id",
        F.when(F.col("cluster_id").isNull(), "unique").otherwise("matched").alias("cluster_status"),
        F.coalesce("score", "similarity_score").alias("similarity_score"),
    )
