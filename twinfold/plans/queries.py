"""Named jobs over the test tables: ``name -> f(spark, sf_dir) -> DataFrame``.

Results have flat columns: times as epoch seconds, lists joined into text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import fingerprints as fp
from twinfold.functions import similarity as sim
from twinfold.functions import text as tx
from twinfold.operators import candidates as cand
from twinfold.operators import clusters as cl
from twinfold.operators import features as ft
from twinfold.operators import lookups, reports, search, set_join
from twinfold.operators.joins import join_groups, keep_ids
from twinfold.params import DEFAULT
from twinfold.session import configure, materialize, shared_folder
from twinfold.sources import articles as src
from twinfold.sources import tables
from twinfold.streaming.incremental import IncrementalClusters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Tables derived once per session and folder, as a stored article table would be.
_STORED: dict[tuple, object] = {}


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[job.__name__] = job
    return job


def forget() -> None:
    """Drop the derived tables, so that the next query computes them again."""
    _STORED.clear()


def once(job):
    def stored(spark: SparkSession, sf_dir: str):
        key = (job.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _STORED:
            _STORED[key] = job(spark, sf_dir)
        return _STORED[key]

    return stored


# --- inputs -----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus. A file with fewer splits than cores is spread; a larger one is read as it lies."""
    rows = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.articles_from_documents(documents(spark, sf_dir))


def with_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.with_normalized(articles(spark, sf_dir)).select("article_id", "normalized")


@once
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(ft.extract_features(src.with_id_lists(articles(spark, sf_dir))))


@once
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(ft.text_groups(features(spark, sf_dir)))


@once
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(cand.candidates(texts(spark, sf_dir)))


@once
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(cand.similar_pairs(texts(spark, sf_dir), articles(spark, sf_dir)))


@once
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs that connect all that ``pairs`` connect; in large buckets a spanning part of them."""
    rows = texts(spark, sf_dir)
    total = rows.count() * DEFAULT.bands
    return cl.verified_edges(cand.bucket_rows(rows), articles(spark, sf_dir), DEFAULT, cl.simhash_star(rows), total, rows)


@once
def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored article table: metadata, fingerprints, cluster, status and score."""
    return materialize(cl.cluster_articles(src.with_id_lists(articles(spark, sf_dir))))


@once
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(cl.build_clusters(assigned(spark, sf_dir), articles(spark, sf_dir)))


def epoch(name: str) -> Column:
    return F.unix_seconds(name)


def joined(column: str | Column, by: str = ",") -> Column:
    return F.concat_ws(by, column)


def ids_and_state(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select("article_id", "cluster_id", "cluster_status", "similarity_score", *more)


# --- sources, updates, validation -------------------------------------------


@query
def articles_scan(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "article_id", "title", F.length("content").cast("bigint").alias("n_chars"),
        epoch("publish_time").alias("publish_epoch"), "source",
        F.col("state").cast("bigint").alias("state"), F.col("top").cast("bigint").alias("top"),
        joined("tags.name").alias("tag_names"), joined("topic.id").alias("topics"),
        epoch("created_at").alias("created_epoch"),
    )


@query
def derive_title(spark, sf_dir):
    return articles(spark, sf_dir).select("article_id", "title")


@query
def merge_updates(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("article_id"),
        (F.col("toxic") * 2).alias("state"), F.col("quality").alias("top"),
    )
    base = articles(spark, sf_dir).select("article_id", "source", "state", "top")
    merged, unknown = tables.merge_updates(base, marks, "article_id")
    return merged.select(
        "article_id", "source", F.col("state").cast("bigint").alias("state"), F.col("top").cast("bigint").alias("top"),
        F.lit("stored").alias("kind"),
    ).unionByName(unknown.select(
        "article_id", F.lit(None).cast("string").alias("source"), F.col("state").cast("bigint").alias("state"),
        F.col("top").cast("bigint").alias("top"), F.lit("rejected").alias("kind"),
    ))


def _submitted(article_id: Column, text: Column, minute: Column, source: Column, state: Column, top: Column) -> list[Column]:
    time = F.timestamp_seconds(F.lit(1709251200) + minute * 60)  # from 2024-03-01 00:00 UTC
    return [
        article_id.alias("article_id"), tx.derive_title(text, article_id).alias("title"), text.alias("content"),
        time.alias("publish_time"), source.alias("source"), state.cast("int").alias("state"), top.cast("int").alias("top"),
        F.array().cast("array<struct<id:bigint,name:string>>").alias("tags"),
        F.array().cast("array<struct<id:string,name:string>>").alias("topic"),
        time.alias("created_at"), time.alias("updated_at"),
    ]


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known ids sent several times (one per conversation turn), and new ids."""
    turns = table(spark, sf_dir, "conversations").select(
        *_submitted(F.col("conv_id").cast("string"), F.col("text"), F.col("turn"), F.col("role"), F.lit(1), F.lit(0))
    )
    items = table(spark, sf_dir, "benchmark").select(
        *_submitted(F.concat(F.lit("item_"), F.col("item_id")), F.col("text"), F.col("item_id"), F.lit("benchmark"), F.lit(1), F.lit(1))
    )
    return turns.unionByName(items)


@query
def upsert_articles(spark, sf_dir):
    result = tables.upsert_articles(articles(spark, sf_dir), _submissions(spark, sf_dir), [F.desc("publish_time")])
    return result.select(
        "article_id", "title", F.length("content").cast("bigint").alias("n_chars"), "source",
        F.col("state").cast("bigint").alias("state"), epoch("publish_time").alias("publish_epoch"),
        epoch("created_at").alias("created_epoch"), epoch("updated_at").alias("updated_epoch"), "is_new", "text_changed",
    )


@query
def lookup_articles(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("article_id"))
    return keep_ids(articles(spark, sf_dir), ids).select("article_id", "title", "source")


@query
def validate_articles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(*_submitted(
        F.concat_ws("-", "conv_id", "turn"), F.col("text"), F.col("turn"),
        F.when(F.col("role") != "system", F.col("role")), F.col("turn") - 1, F.col("turn"),
    ))
    checked = src.check_articles(articles(spark, sf_dir).unionByName(turns))
    return checked.select("article_id", joined("reasons").alias("reasons"))


@query
def valid_cluster_ids(spark, sf_dir):
    values = F.array(F.concat(F.lit("cluster_"), F.col("article_id")), F.col("source"), F.lit("cluster_"))
    rows = articles(spark, sf_dir).select("article_id", F.explode(values).alias("cluster_id"))
    return rows.withColumns({"ok_article": tx.is_article_id(F.col("article_id")), "ok_cluster": tx.is_cluster_id(F.col("cluster_id"))})


@query
def sanitize_text(spark, sf_dir):
    clean = tx.sanitize_text(F.col("content"))
    return articles(spark, sf_dir).select(
        "article_id", F.length(clean).cast("bigint").alias("n_chars"), F.md5(clean).alias("digest")
    )


@query
def normalize_source(spark, sf_dir):
    name = F.concat(F.lit(" "), F.upper("source"), F.lit(" - "), F.col("lang"), F.lit(".News "))
    return documents(spark, sf_dir).groupBy(tx.normalize_source(name).alias("source")).agg(F.count("*").alias("articles"))


@query
def valid_languages(spark, sf_dir):
    codes = F.array(F.col("lang"), F.concat_ws("-", "lang", F.upper("lang")), F.concat_ws("_", "lang", "lang"), F.col("source"))
    rows = documents(spark, sf_dir).select(F.explode(codes).alias("code"))
    return rows.groupBy("code", tx.is_language_code(F.col("code")).alias("ok")).agg(F.count("*").alias("articles"))


@query
def valid_ranges(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"], "left")
    ok = tx.is_date_range(F.col("o_orderdate"), F.col("l_shipdate"))
    return rows.groupBy("l_linestatus", ok.alias("ok")).agg(F.count("*").alias("ranges"))


@query
def tag_ids(spark, sf_dir):
    return src.with_id_lists(articles(spark, sf_dir)).select(
        "article_id", joined("tag_ids").alias("tag_ids"), joined("topic_ids").alias("topic_ids")
    )


# --- text features ----------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    return with_norm(spark, sf_dir).select(
        "article_id", F.length("normalized").cast("bigint").alias("n_chars"), F.md5("normalized").alias("digest")
    )


@query
def shingles(spark, sf_dir):
    rows = with_norm(spark, sf_dir).select("article_id", sim.shingles(F.col("normalized")).alias("s"))
    return rows.select(
        "article_id", F.size("s").cast("bigint").alias("n_shingles"),
        F.size(F.array_distinct("s")).cast("bigint").alias("n_distinct"),
        F.get("s", F.lit(0)).alias("first_shingle"), F.get("s", F.size("s") - 1).alias("last_shingle"),
        F.array_min("s").alias("low_shingle"), F.array_max("s").alias("high_shingle"),
    )


@query
def simhash(spark, sf_dir):
    value = fp.simhash(F.col("normalized"))
    return with_norm(spark, sf_dir).select("article_id", sim.simhash_hex(value).alias("simhash"))


@query
def minhash_values(spark, sf_dir):
    rows = with_norm(spark, sf_dir).select("article_id", F.posexplode(fp.minhash(F.col("normalized"))).alias("position", "value"))
    return rows.select("article_id", F.col("position").cast("bigint").alias("position"), "value")


@query
def minhash_bands(spark, sf_dir):
    rows = features(spark, sf_dir).select("article_id", F.explode("buckets").alias("bucket"))
    return rows.select(
        "article_id", sim.band_index(F.col("bucket")).cast("bigint").alias("band"), sim.band_hex(F.col("bucket")).alias("band_hash")
    )


@query
def extract_features(spark, sf_dir):
    return ft.public_features(ft.extract_features(articles(spark, sf_dir))).select(
        "article_id", "simhash", joined("minhash_signature").alias("minhash_signature"),
        F.col("n_shingles").cast("bigint").alias("n_shingles"),
    )


@query
def top_terms(spark, sf_dir):
    rows = articles(spark, sf_dir).select("article_id", F.posexplode(fp.top_terms(tx.full_text())).alias("pos", "t"))
    return rows.select("article_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "t.term", "t.weight")


# --- candidates and similarity ----------------------------------------------


@query
def simhash_duplicates(spark, sf_dir):
    groups = ft.simhash_groups(texts(spark, sf_dir)).where("articles > 1")
    rows = join_groups(features(spark, sf_dir).select("article_id", "simhash"), groups, ["simhash"], "articles")
    return rows.select(
        "article_id", sim.simhash_hex(F.col("simhash")).alias("simhash"), F.col("root").alias("first_id"),
        F.col("articles").alias("group_size"),
    )


@query
def lsh_candidates(spark, sf_dir):
    return candidate_pairs(spark, sf_dir).select("article_id_a", "article_id_b", "shared_bands")


@query
def lsh_topk(spark, sf_dir):
    rows = cand.lsh_topk(features(spark, sf_dir), texts(spark, sf_dir))
    return rows.select("article_id", "candidate_id", "shared_bands", F.col("rank").cast("bigint").alias("rank"))


@query
def hamming_pairs(spark, sf_dir):
    rows = cand.hamming_pairs(candidate_pairs(spark, sf_dir))
    return rows.select("article_id_a", "article_id_b", F.col("distance").cast("bigint").alias("distance"))


@query
def simhash_near(spark, sf_dir):
    a, b = sim.simhash_hex(F.col("simhash_a")), sim.simhash_hex(F.col("simhash_b"))
    return cand.near_simhash(texts(spark, sf_dir)).select(
        F.least(a, b).alias("simhash_low"), F.greatest(a, b).alias("simhash_high"),
        F.col("distance").cast("bigint").alias("distance"),
        (F.col("articles_a") * F.col("articles_b")).alias("article_pairs"),
    )


@query
def jaccard_pairs(spark, sf_dir):
    rows = cand.score_pairs(candidate_pairs(spark, sf_dir), articles(spark, sf_dir))
    return rows.select("article_id_a", "article_id_b", "score")


@query
def similar_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("article_id_a", "article_id_b", "shared_bands", "score")


@query
def classify_articles(spark, sf_dir):
    return cand.classify_articles(features(spark, sf_dir), texts(spark, sf_dir), articles(spark, sf_dir))


# --- clustering -------------------------------------------------------------


@query
def components(spark, sf_dir):
    rows = cl.exact_components(texts(spark, sf_dir), links(spark, sf_dir))
    return rows.select(F.col("node").alias("article_id"), "component")


@query
def article_components(spark, sf_dir):
    """``components`` for every article: copies too, and texts that only have exact copies."""
    return cl.article_components(features(spark, sf_dir), texts(spark, sf_dir), links(spark, sf_dir))


@query
def text_members(spark, sf_dir):
    """The articles of each text that the pair queries list under its smallest article id."""
    groups = texts(spark, sf_dir).select("text_key", F.col("article_id").alias("representative"), "copies")
    rows = join_groups(features(spark, sf_dir).select("article_id", "text_key"), groups, ["text_key"], "copies")
    return rows.select("article_id", "representative", "copies")


@query
def cluster_articles(spark, sf_dir):
    return ids_and_state(assigned(spark, sf_dir))


@query
def cluster_articles_exact(spark, sf_dir):
    """Clusters of equal texts and verified pairs alone, without the equal-SimHash shortcut."""
    return ids_and_state(cl.cluster_articles(src.with_id_lists(articles(spark, sf_dir)), verify_exact=True))


@query
def clusters(spark, sf_dir):
    terms = F.transform("top_terms", lambda t: F.concat_ws("=", t["term"], F.format_number(t["weight"], 3)))
    return cluster_table(spark, sf_dir).select(
        "cluster_id", "size", "representative_article_id", joined(terms, " ").alias("top_terms"),
        epoch("created_at").alias("created_epoch"), epoch("last_updated").alias("updated_epoch"),
    )


@query
def duplicate_clusters(spark, sf_dir):
    rows = cl.duplicate_clusters(features(spark, sf_dir))
    return rows.select("article_id", "cluster_id", "similarity_score")


def _similar_with_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts similar to each distinct text, with the cluster that equal SimHash gave them and their number of articles.

    A text with copies is similar to itself, by its other articles.
    """
    rows = texts(spark, sf_dir)
    groups = ft.simhash_groups(rows).where("articles > 1").select("simhash", cl.cluster_name(F.col("root")).alias("cluster_id"), "texts")
    each = materialize(
        join_groups(rows.select("article_id", "simhash", "n_shingles", "copies"), groups, ["simhash"], "texts", how="left").drop("texts")
    )
    other = each.select(F.col("article_id").alias("other_id"), "cluster_id", "copies")
    links = cand.both_ways(pairs(spark, sf_dir), "score").join(other, "other_id")
    own = each.where("copies > 1 AND n_shingles > 0").select(
        F.col("article_id").alias("other_id"), "article_id", F.lit(1.0).alias("score"), "cluster_id", (F.col("copies") - 1).alias("copies")
    )
    return links.unionByName(own)


def _text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("article_id", "text_key", F.col("copies").alias("size"))


@query
def merge_members(spark, sf_dir):
    members = cl.duplicate_clusters(features(spark, sf_dir))
    by_text = _similar_with_clusters(spark, sf_dir).where("cluster_id IS NOT NULL").select("article_id", "cluster_id").distinct()
    by_text = by_text.join(_text_keys(spark, sf_dir), "article_id").select("text_key", "cluster_id", "size")
    # A text may belong to several clusters and have any number of copies.
    additions = join_groups(features(spark, sf_dir).select("article_id", "text_key"), by_text, ["text_key"], "size", repeated=True)
    return cl.member_sizes(materialize(cl.merge_members(members, additions))).select("cluster_id", "article_id", "size")


@query
def best_cluster(spark, sf_dir):
    best = cl.best_cluster(_similar_with_clusters(spark, sf_dir)).join(_text_keys(spark, sf_dir), "article_id").drop("article_id")
    rows = join_groups(features(spark, sf_dir).select("article_id", "text_key"), best, ["text_key"], "size")
    return rows.select("article_id", "cluster_id", "avg_score", "articles")


@query
def unmatched_articles(spark, sf_dir):
    return cl.unmatched_articles(assigned(spark, sf_dir))


@query
def recheck(spark, sf_dir):
    """Every article again, which is the case with the most work."""
    stored = assigned(spark, sf_dir)
    return ids_and_state(cl.recheck(stored, articles(spark, sf_dir), stored.select("article_id")))


@query
def recheck_some(spark, sf_dir):
    """The articles that have labels again; the others keep their clusters unless these are merged."""
    ids = materialize(table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("article_id")).distinct())
    return ids_and_state(cl.recheck(assigned(spark, sf_dir), articles(spark, sf_dir), ids))


# --- statistics -------------------------------------------------------------


@query
def corpus_totals(spark, sf_dir):
    return reports.corpus_totals(assigned(spark, sf_dir))


@query
def size_distribution(spark, sf_dir):
    return reports.size_distribution(cluster_table(spark, sf_dir))


@query
def status_counts(spark, sf_dir):
    return reports.status_counts(assigned(spark, sf_dir))


@query
def stale_pending(spark, sf_dir):
    waiting = articles(spark, sf_dir).withColumn("cluster_status", F.lit("pending"))
    as_of = F.timestamp_seconds(F.lit(1704067200 + 15 * 86400))
    return reports.stale_pending(waiting, as_of, 5 * 86400).select("article_id", "age_seconds")


# --- search -----------------------------------------------------------------


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select(
        "article_id", F.col("state").cast("bigint").alias("state"), F.col("top").cast("bigint").alias("top"), "source",
        epoch("publish_time").alias("publish_epoch"),
    )


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("position", "article_id", "cluster_id", epoch("publish_time").alias("publish_epoch"))


@query
def search_articles(spark, sf_dir):
    return _hits(search.search_articles(
        assigned(spark, sf_dir), state=1, title="the", start_time="2024-01-05T00:00:00Z", end_time="2024-01-25T00:00:00Z",
        topic_ids=["topic_en", "topic_fr"],
    ))


@query
def search_state(spark, sf_dir):
    return _hits(search.search_articles(assigned(spark, sf_dir), state=0, top=0))


@query
def search_source(spark, sf_dir):
    return _hits(search.search_articles(assigned(spark, sf_dir), source="src3"))


@query
def search_tag(spark, sf_dir):
    return _hits(search.search_articles(assigned(spark, sf_dir), tag_id="1003"))


@query
def search_topics(spark, sf_dir):
    return _hits(search.search_articles(assigned(spark, sf_dir), topic_ids=["topic_de", "topic_es"]))


@query
def search_time_range(spark, sf_dir):
    found = search.search_articles(
        assigned(spark, sf_dir), start_time="2024-01-10T00:00:00Z", end_time="2024-01-20T00:00:00Z"
    )
    return _hits(found)


@query
def search_title(spark, sf_dir):
    return _hits(search.search_articles(assigned(spark, sf_dir), title="THE, and"))


@query
def search_sort(spark, sf_dir):
    return _ranked(search.paginate(assigned(spark, sf_dir), search.sort_order("updated_at:asc"), 1, 100))


@query
def search_page(spark, sf_dir):
    rows = search.search_articles(assigned(spark, sf_dir), state=1)
    page = _ranked(search.paginate(rows, search.sort_order(), 2, 20))
    return page.crossJoin(F.broadcast(search.page_totals(rows, 2, 20).select("total", "total_pages")))  # one row of totals


@query
def search_ranked_page(spark, sf_dir):
    """The page in the middle of all articles, read from its place in the ranked rows."""
    ranked = search.RankedRows(assigned(spark, sf_dir), search.sort_order("created_at:desc"))
    page = max(1, ranked.total // 50 // 2)
    return _ranked(ranked.page(page, 50))


@query
def paginate(spark, sf_dir):
    page = search.paginate(cluster_table(spark, sf_dir), [F.desc("size"), F.asc("cluster_id")], 2, 25)
    return page.select("position", "cluster_id", "size")


@query
def search_collapse(spark, sf_dir):
    hits = search.paginate(assigned(spark, sf_dir), search.sort_order(), 1, 100)
    return _ranked(search.collapse(hits))


@query
def search_similar_ids(spark, sf_dir):
    page = search.search_page(assigned(spark, sf_dir), page=1, page_size=100)
    return page.select("position", "article_id", F.col("rank").cast("bigint").alias("rank"), "similar_article_id")


# --- answers ----------------------------------------------------------------


@query
def article_detail(spark, sf_dir):
    rows = lookups.article_detail(assigned(spark, sf_dir), cluster_table(spark, sf_dir))
    return ids_and_state(
        rows, F.col("state").cast("bigint").alias("state"), F.col("top").cast("bigint").alias("top"),
        F.col("cluster.size").alias("cluster_size"), F.col("cluster.representative_article_id").alias("representative"),
    )


def _similar(rows: DataFrame) -> DataFrame:
    return rows.select("article_id", "similar_id", "title", "similarity_score", F.col("rank").cast("bigint").alias("rank"))


@query
def similar_articles(spark, sf_dir):
    """The answer as it is served: the others among the first 100 of the cluster."""
    return _similar(lookups.similar_articles(assigned(spark, sf_dir), size=100))


@query
def similar_members(spark, sf_dir):
    """The whole answer, linear: each article's cluster and own rank; similar to it are the cluster's other rows."""
    rows = lookups.similar_members(assigned(spark, sf_dir))
    return rows.select("article_id", "cluster_id", F.col("rank").cast("bigint").alias("rank"), "title", "similarity_score")


@query
def similar_articles_by_id(spark, sf_dir):
    """All other members of the cluster, for the ids marked toxic."""
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("article_id"))
    return _similar(lookups.similar_articles(assigned(spark, sf_dir), ids))


@query
def cluster_detail(spark, sf_dir):
    rows = lookups.cluster_detail(cluster_table(spark, sf_dir), assigned(spark, sf_dir))
    return rows.select(
        "cluster_id", "size", "representative_article_id", F.col("rank").cast("bigint").alias("rank"), "article_id",
        "cluster_status", "similarity_score",
    )


@query
def cluster_members(spark, sf_dir):
    rows = lookups.cluster_members(assigned(spark, sf_dir))
    return rows.select("cluster_id", F.col("rank").cast("bigint").alias("rank"), "article_id", epoch("publish_time").alias("publish_epoch"))


# --- streaming --------------------------------------------------------------


@query
def incremental_clusters(spark, sf_dir):
    """The whole corpus as four micro-batches in order of publish time."""
    import uuid

    week = F.floor((epoch("publish_time") - 1704067200) / (8 * 86400))
    week = F.least(F.greatest(F.coalesce(week, F.lit(0)), F.lit(0)), F.lit(3))  # earlier times belong to the first, later ones to the last
    rows = articles(spark, sf_dir).withColumn("week", week)
    state = IncrementalClusters(spark, f"{shared_folder(spark)}/twinfold/{uuid.uuid4().hex}")
    for batch in range(4):
        state.apply(rows.where(F.col("week") == batch), batch)
    return state.assigned()


@query
def stream_rejects(spark, sf_dir):
    """Turns sent as articles: what the stream's gate keeps out, and why."""
    import uuid

    state = IncrementalClusters(spark, f"{shared_folder(spark)}/twinfold/{uuid.uuid4().hex}")
    turns = table(spark, sf_dir, "conversations").select(*_submitted(
        F.concat_ws("-", "conv_id", "turn"), F.col("text"), F.col("turn"),
        F.when(F.col("role") != "system", F.col("role")), F.col("turn") - 1, F.col("turn"),
    ))
    state.apply(turns, 0)
    return state.table("rejects").select("article_id", joined("reasons").alias("reasons"))


# --- quality reports --------------------------------------------------------


@query
def peer_recall(spark, sf_dir):
    labelled = articles(spark, sf_dir).select("article_id", F.md5("content").alias("group"))
    return reports.peer_recall(labelled, assigned(spark, sf_dir)).select("article_id", "expected", "found", "passed")


@query
def cluster_consistency(spark, sf_dir):
    return reports.cluster_consistency(assigned(spark, sf_dir), cluster_table(spark, sf_dir))


@query
def lsh_recall(spark, sf_dir):
    """What the bands miss: all similar pairs of distinct texts, found without them, against the candidates."""
    similar = set_join.similar_text_pairs(texts(spark, sf_dir), articles(spark, sf_dir))
    return reports.lsh_recall(set_join.found_by(similar, texts(spark, sf_dir)))


@query
def title_self_search(spark, sf_dir):
    return reports.title_self_search(articles(spark, sf_dir))
