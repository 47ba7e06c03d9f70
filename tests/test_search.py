"""Search, lookups and reports on a small stored table."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests import brute
from twinfold.operators import lookups, reports, search
from twinfold.operators.clusters import best_cluster, member_sizes, merge_members

# id, title, minute, source, state, top, tags, topics, cluster, status, score
ROWS = [
    ("a", "Storm hits the coast", 5, "x", 1, 0, ["1"], ["t1"], "cluster_a", "matched", 1.0),
    ("b", "Storm hits the coast again", 4, "x", 1, 1, ["1", "2"], ["t1", "t2"], "cluster_a", "matched", 0.9),
    ("c", "The coast", 3, "y", 0, 0, [], [], None, "unique", None),
    ("d", "新闻聚类系统发布", 2, "y", 2, 0, ["2"], ["t3"], None, "pending", None),
    ("e", "Storm", 2, "z", 1, 0, ["3"], ["t2"], "cluster_e", "matched", 0.85),
    ("f", "Calm", 1, "z", 1, 0, ["3"], [], "cluster_e", "matched", None),
    ("g", "Storm pending", 0, "z", 1, 0, [], [], "cluster_e", "pending", None),
]


@pytest.fixture(scope="module")
def table(spark):
    data = [(*r[:2], brute.START + timedelta(minutes=r[2]), *r[3:]) for r in ROWS]
    rows = spark.createDataFrame(
        data,
        "article_id string, title string, publish_time timestamp, source string, state int, top int, tag_ids array<string>, "
        "topic_ids array<string>, cluster_id string, cluster_status string, similarity_score double",
    )
    return rows.withColumns({"created_at": F.col("publish_time"), "updated_at": F.col("publish_time")}).cache()


def ids(rows):
    return "".join(sorted(r.article_id for r in rows.collect()))


def test_filters(table):
    find = lambda **kw: ids(search.search_articles(table, **kw))
    assert find() == "abcdefg"
    assert find(state=0) == "c" and find(top=0) == "acdefg"
    assert find(source="") == "abcdefg" and find(topic_ids=[]) == "abcdefg"
    assert find(source="x") == "ab" and find(tag_id="2") == "bd" and find(topic_ids=["t2", "t3"]) == "bde"
    early, late = brute.START + timedelta(minutes=2), brute.START + timedelta(minutes=4)
    assert find(start_time=early, end_time=late) == "bcde"
    assert find(start_time="2024-01-01T00:03:00Z") == "abc"
    assert find(title="COAST storm") == "ab" and find(title="聚类") == "d" and find(title="新聚") == ""
    assert find(title="—") == ""
    assert find(title="storm", state=1, source="x", top=1) == "b"


@pytest.mark.parametrize("sort", ["title:asc", "publish_time", "publish_time:up", "publish_time:asc:x", ":"])
def test_bad_sort(sort):
    with pytest.raises(ValueError):
        search.sort_order(sort)


def test_pages(table):
    order = search.sort_order()
    pages = [search.paginate(table, order, page, 3).orderBy("position").collect() for page in (1, 2, 3, 4)]
    assert [[r.article_id for r in page] for page in pages] == [list("abc"), list("def"), ["g"], []]
    assert [r.position for r in pages[1]] == [4, 5, 6]
    assert search.page_totals(table, 2, 3).first().asDict() == {"total": 7, "page": 2, "page_size": 3, "total_pages": 3}
    up = search.paginate(table, search.sort_order("created_at:asc"), 1, 10).orderBy("position").collect()
    assert "".join(r.article_id for r in up) == "gfdecba"
    with pytest.raises(ValueError):
        search.paginate(table, order, 0, 3)
    with pytest.raises(ValueError):
        search.search_page(table, page_size=101)


@pytest.fixture(scope="module")
def many(spark):
    """Rows with ties and nulls in the sort field."""
    minute = F.when(F.col("id") % 10 != 0, F.pmod(F.col("id") * 37, F.lit(50)))
    rows = spark.range(0, 3_000, numPartitions=7).select(F.format_string("%05d", "id").alias("article_id"), minute.alias("m"))
    return rows.withColumn("publish_time", F.timestamp_seconds(F.col("m") * 60)).drop("m").cache()


def in_order(rows, sort):
    """Null is the smallest; ties by id."""
    rows = sorted(rows.collect(), key=lambda r: r.article_id)
    key = lambda r: (r.publish_time is not None, r.publish_time or 0)
    return [r.article_id for r in sorted(rows, key=key, reverse=sort.endswith("desc"))]


@pytest.mark.parametrize("sort", ["publish_time:asc", "publish_time:desc"])
def test_deep_pages(many, sort, monkeypatch):
    expected = in_order(many, sort)
    ranked = search.RankedRows(many, search.sort_order(sort), parts=5)
    assert ranked.total == len(expected) and len(ranked.parts) > 1
    for page, size in ((1, 20), (100, 20), (150, 20), (151, 20), (2, 1_700), (1, 5_000)):
        found = sorted((r.position, r.article_id) for r in ranked.page(page, size).collect())
        first = (page - 1) * size
        assert found == [(first + i + 1, key) for i, key in enumerate(expected[first : first + size])]
    # The stored order is used: nothing is sorted or shuffled, and the place is filtered in the scan.
    plan = ranked.page(120, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "PushedFilters" in plan and "_place" in plan.split("PushedFilters")[1]
    monkeypatch.setattr(search, "DEEP", 100)
    page = search.paginate(many, search.sort_order(sort), 50, 7).orderBy("position").collect()
    assert [r.article_id for r in page] == expected[343:350]


@pytest.mark.parametrize("sort", ["publish_time:asc", "publish_time:desc"])
def test_pages_by_their_last_row(many, sort):
    expected, after, seen = in_order(many, sort), None, []
    for _ in range(7):
        rows = search.page_after(many, sort, after, 500).collect()
        seen += [r.article_id for r in rows]
        after = (rows[-1].publish_time, rows[-1].article_id) if rows else after
    assert seen == expected


def test_ranked_rows_of_nothing(many):
    ranked = search.RankedRows(many.where("false"), search.sort_order())
    assert ranked.total == 0 and ranked.page(1, 10).collect() == []


def test_page_is_collapsed(table):
    page = {}
    for r in search.search_page(table, page_size=6).orderBy("position", "rank").collect():
        page.setdefault(r.article_id, []).append(r.similar_article_id)
    assert page == {"a": ["a", "b"], "c": ["c"], "d": ["d"], "e": ["e", "f", "g"]}
    second = search.search_page(table, page=2, page_size=1).orderBy("rank").collect()
    assert [(r.article_id, r.similar_article_id) for r in second] == [("b", "b"), ("b", "a")]


def test_members_and_similar(table):
    assert ids(lookups.cluster_members(table, 1)) == "ae"
    found = {}
    for r in lookups.similar_articles(table).orderBy("article_id", "rank").collect():
        found.setdefault(r.article_id, []).append((r.similar_id, r.similarity_score))
    assert found == {"a": [("b", 0.9)], "b": [("a", 1.0)], "e": [("f", 0.0), ("g", 0.0)], "f": [("e", 0.85), ("g", 0.0)]}


def test_details_and_reports(spark, table):
    clusters = spark.createDataFrame(
        [("cluster_a", 2, "a", None), ("cluster_e", 2, "f", None)],
        "cluster_id string, size bigint, representative_article_id string, top_terms array<struct<term:string,weight:double>>",
    ).withColumn("last_updated", F.current_timestamp())
    detail = {r.article_id: r for r in lookups.article_detail(table, clusters).collect()}
    assert len(detail) == 7 and detail["c"].cluster is None
    assert (detail["b"].cluster.size, detail["g"].cluster.representative_article_id) == (2, "f")
    for size, last in ((2, []), (None, ["g"])):
        shown = {}
        for r in lookups.cluster_detail(clusters, table, size=size).orderBy("cluster_id", "rank").collect():
            shown.setdefault(r.cluster_id, []).append(r.article_id)
        assert shown == {"cluster_a": ["a", "b"], "cluster_e": ["e", "f", *last]}
    checks = {r.cluster_id: (r.claimed, r.listed, r.missing) for r in reports.cluster_consistency(table, clusters).collect()}
    assert checks == {"cluster_a": (2, 2, 0), "cluster_e": (3, 2, 1)}
    assert reports.corpus_totals(table).first().asDict() == {"total_articles": 7, "total_clusters": 2}
    assert [tuple(r) for r in reports.size_distribution(clusters).collect()] == [(2, 2)]
    assert {tuple(r) for r in reports.status_counts(table).collect()} == {("matched", 4), ("unique", 1), ("pending", 2)}
    as_of = F.lit(brute.START + timedelta(minutes=4)).cast("timestamp")
    assert ids(reports.stale_pending(table, as_of, 180)) == "g"


def test_peers(spark, table):
    groups = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("e", "2"), ("d", "3")], "article_id string, group string")
    found = {r.article_id: (r.expected, r.found, r.passed) for r in reports.peer_recall(groups, table).collect()}
    assert found == {"a": (2, 1, False), "b": (2, 1, False), "c": (2, 0, False), "e": (0, 0, True), "d": (0, 0, True)}


@pytest.mark.parametrize("k", [1, 2, 50])
def test_title_self_search(table, k):
    found = {r.article_id: (r.found, r["rank"]) for r in reports.title_self_search(table, k).collect()}
    tokens = {r[0]: set(r[1].lower().split()) if r[0] != "d" else {"d"} for r in ROWS}
    order = [r[0] for r in sorted(ROWS, key=lambda r: (-r[2], r[0]))]
    for key in tokens:
        hits = [x for x in order if tokens[key] <= tokens[x]]
        rank = hits.index(key) + 1
        assert found[key] == ((True, rank) if rank <= k else (False, None))


def test_titles_that_share_a_hot_token(spark, monkeypatch):
    monkeypatch.setattr(reports, "TITLES", 7)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(9)]
    titles = [" ".join(["news", *rng.sample(words, rng.randint(0, 3))]) for _ in range(120)]
    rows = spark.createDataFrame([(f"{i:03d}", t, rng.randrange(40)) for i, t in enumerate(titles)], "article_id string, title string, m int")
    rows = rows.withColumn("publish_time", F.timestamp_seconds("m")).cache()
    listed = [(r.article_id, set(r.title.split()), r.m) for r in rows.collect()]
    listed.sort(key=lambda r: (-r[2], r[0]))
    found = {r.article_id: r["rank"] for r in reports.title_self_search(rows, 5).collect()}
    for key, tokens, _ in listed:
        rank = [x for x, other, _ in listed if tokens <= other].index(key) + 1
        assert found[key] == (rank if rank <= 5 else None)


def test_best_cluster(spark):
    rows = [("a", "c2", 0.9), ("a", "c1", 1.0), ("a", "c1", 0.8), ("a", None, 1.0), ("b", "c3", 0.8), ("b", "c4", 0.95), ("d", None, 1.0)]
    found = best_cluster(spark.createDataFrame(rows, "article_id string, cluster_id string, score double"))
    assert {r.article_id: r.cluster_id for r in found.collect()} == {"a": "c1", "b": "c4"}


def test_merge_members(spark):
    one = spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "9")], "cluster_id string, article_id string")
    two = spark.createDataFrame([("c", "2"), ("c", "3")], "cluster_id string, article_id string")
    found = {tuple(r) for r in member_sizes(merge_members(one, two)).select("cluster_id", "article_id", "size").collect()}
    assert found == {("c", "1", 3), ("c", "2", 3), ("c", "3", 3), ("d", "9", 1)}


def test_all_members_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(lookups, "CHUNK", 7)
    rows = spark.range(250).select(
        F.format_string("m%03d", "id").alias("article_id"), F.lit("cluster_m000").alias("cluster_id"), F.lit("t").alias("title"),
        F.lit("matched").alias("cluster_status"), F.lit(1.0).alias("similarity_score"),
        F.timestamp_seconds(F.floor(F.col("id") / 3)).alias("publish_time"),
    )
    order = [f"m{i:03d}" for i in sorted(range(250), key=lambda i: (-(i // 3), i))]
    members = {r["rank"]: r.article_id for r in lookups.cluster_members(rows.repartition(5)).collect()}
    assert members == {i + 1: key for i, key in enumerate(order)}
    asked = spark.createDataFrame([("m100",), ("none",)], "article_id string")
    found = {r["rank"]: r.similar_id for r in lookups.similar_articles(rows, asked).collect()}
    assert found == {i + 1: key for i, key in enumerate(k for k in order if k != "m100")}


def test_similar_members_beyond_100(spark, tmp_path):
    from twinfold.plans.queries import QUERIES

    rows = [(i, "one text of which there are more than a hundred copies " * 3, "en", "s", 165) for i in range(130)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["similar_members"](spark, str(tmp_path)).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 131))
    assert {r.article_id for r in found} == {str(i) for i in range(130)}
    assert {(r.cluster_id, r.similarity_score) for r in found} == {("cluster_0", 1.0)}
