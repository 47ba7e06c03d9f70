"""Sources, validation, updates, stored tables, joins."""

import os

import pytest
from pyspark.sql import functions as F

from tests import brute
from twinfold.operators.joins import join_chunks, join_groups, keep_ids, split_pairs
from twinfold.schemas import ARTICLE
from twinfold.sources import articles as src
from twinfold.sources import tables


def test_text_groups(spark, tmp_path):
    for path, text in {"doc_group1/1.txt": "\n Title one \nbody", "doc_group1/2.txt": " \n", "doc_group1/empty.txt": "", "doc_group2/1.txt": "y" * 130, "other/3.txt": "no"}.items():
        file = tmp_path / path
        file.parent.mkdir(exist_ok=True)
        file.write_text(text, encoding="utf-8")
    rows = {r.article_id: r for r in src.read_text_groups(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["doc_group1_1", "doc_group1_2", "doc_group2_1"]
    assert rows["doc_group1_1"].title == "Title one" and rows["doc_group1_1"].group == "doc_group1"
    assert rows["doc_group1_1"].content == "\n Title one \nbody"
    assert rows["doc_group1_2"].title == "2"
    assert rows["doc_group2_1"].title == "y" * 117 + "..."


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_read_articles(spark, tmp_path, format):
    rows = brute.frame(spark, [("1", "t", "c")]).withColumn("tags", F.array(F.struct(F.lit(2**40).alias("id"), F.lit("n").alias("name"))))
    rows.write.format(format).save(str(tmp_path / "in"))
    back = src.with_id_lists(src.read_articles(spark, str(tmp_path / "in"), format))
    assert back.select(*ARTICLE.names).schema == ARTICLE
    assert back.first().tag_ids == [str(2**40)]


def test_validation(spark):
    data = [
        ("1", "t", "c", brute.START, "s", 1, 0, [], []),
        (" ", "t", "c", brute.START, "s", 0, 1, [], []),
        ("3", None, "x" * 200_001, None, None, 3, 2, None, None),
        ("4", "t", "\U0001f600" * 200_000, brute.START, "s", 2, 1, [], []),
    ]
    valid, rejected = src.validate_articles(spark.createDataFrame(data, ARTICLE))
    assert sorted(r.article_id for r in valid.collect()) == ["1", "4"]
    reasons = {r.article_id: r.reasons for r in rejected.collect()}
    assert reasons == {
        " ": ["article_id"],
        "3": ["title_missing", "publish_time_missing", "source_missing", "content_too_long", "state_range", "top_range"],
    }


def test_merge_updates(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    updates = spark.createDataFrame([("b", None), ("c", 5)], "id string, n int")
    merged, unknown = tables.merge_updates(base, updates, "id")
    assert sorted(map(tuple, merged.collect())) == [("a", 1, "x"), ("b", None, "y")]
    assert list(map(tuple, unknown.collect())) == [("c", 5)]


def test_upsert_keeps_features_and_cluster(spark):
    base = spark.createDataFrame(
        [("1", "old", "text", "s", "hash1", "cluster_1", 10, 10), ("2", "two", "text2", "s", "hash2", None, 10, 10)],
        "article_id string, title string, content string, source string, simhash string, cluster_id string, created_at int, updated_at int",
    )
    incoming = spark.createDataFrame(
        [("1", "first", "new text", "s2", 20, 20), ("1", "last", "new text", "s3", 30, 30), ("2", "two", "text2", "s", 40, 40), ("3", "three", "t", "s", 50, 50)],
        "article_id string, title string, content string, source string, created_at int, updated_at int",
    )
    rows = {r.article_id: r for r in tables.upsert_articles(base, incoming, [F.desc("updated_at")]).collect()}
    one = rows["1"]
    assert (one.title, one.content, one.source, one.updated_at) == ("last", "new text", "s3", 30)
    assert (one.simhash, one.cluster_id, one.created_at, one.is_new, one.text_changed) == ("hash1", "cluster_1", 10, False, True)
    assert (rows["2"].text_changed, rows["2"].updated_at, rows["2"].created_at) == (False, 40, 10)
    assert (rows["3"].is_new, rows["3"].simhash, rows["3"].created_at, rows["3"].text_changed) == (True, None, 50, False)


def test_versioned_table(spark, tmp_path):
    schema = brute.frame(spark, []).select("article_id", "title").schema
    table = tables.Table(spark, str(tmp_path / "t"), schema)
    assert table.version() == -1 and table.read().count() == 0
    table.write(brute.frame(spark, [("1", "a", "b"), ("2", "c", "d")]), 0)
    table.write(brute.frame(spark, [("1", "z", "b")]), 1)
    table.write(brute.frame(spark, [("1", "z", "b")]), 1)  # a replay
    assert [r.title for r in table.read().collect()] == ["z"]
    assert tables.lookup(table.read(), "article_id", "1").count() == 1
    with pytest.raises(ValueError):
        table.clear()
    table.clear(confirm=True)
    assert table.read().count() == 0 and table.version() == 2
    assert os.path.isdir(tmp_path / "t" / "version=0")


def _files(folder) -> dict[str, tuple[int, int]]:
    found = {}
    for at, _, names in os.walk(folder):
        for name in names:
            state = os.stat(os.path.join(at, name))
            found[os.path.join(at, name)] = (state.st_mtime_ns, state.st_size)
    return found


def test_two_writers_and_a_crash(spark, tmp_path):
    """Every appended row stays, numbers are not shared, and nothing that a commit names is written again."""
    from concurrent.futures import ThreadPoolExecutor

    schema = brute.frame(spark, []).select("article_id", "title").schema
    path = str(tmp_path / "t")
    table = tables.Table(spark, path, schema)
    table.write(brute.frame(spark, [("start", "a", "b")]), 0)

    def writer(name):
        own = tables.Table(spark, path, schema)
        return [own.append(brute.frame(spark, [(f"{name}{i}", "t", "c")])) for i in range(4)]

    with ThreadPoolExecutor(2) as pool:
        numbers = sum(pool.map(writer, "xy"), [])
    assert sorted(numbers) == list(range(1, 9)) == table.versions()[1:]
    everything = {"start", *(f"{n}{i}" for n in "xy" for i in range(4))}
    assert {r.article_id for r in table.read().collect()} == everything

    # A writer that dies before its commit leaves data that nobody reads, and blocks no number.
    dead = tables.Table(spark, path, schema)
    dead._publish = lambda version, folders: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        dead.append(brute.frame(spark, [("lost", "t", "c")]))
    assert {r.article_id for r in table.read().collect()} == everything

    # One that saw an older state does not overwrite a newer one.
    with pytest.raises(tables.Conflict):
        table.replace(brute.frame(spark, [("old", "t", "c")]), 5)
    before = _files(path)
    version = table.compact("article_id", files=3)
    assert version == 9 and len(table.folders()) == 1
    assert {r.article_id for r in table.read().collect()} == everything
    assert {r.article_id for r in table.read(8).collect()} == everything
    assert len({r.f for r in table.read().select(F.input_file_name().alias("f")).collect()}) == 3
    table.write(brute.frame(spark, [("other", "t", "c")]), 9)  # a replay of a committed version
    assert {r.article_id for r in table.read().collect()} == everything
    after = _files(path)
    assert all(after[name] == state for name, state in before.items())


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_groups_with_hot_and_null_keys(spark, hot_rows, how):
    keys = ["hot"] * 500 + ["warm"] * 3 + ["cold", "alone"] + [None] * 50
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    groups = rows.where("k <> 'alone'").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    plain = rows.join(groups, "k", how)
    salted = join_groups(rows, groups, ["k"], "n", how, hot_rows=hot_rows)
    assert sorted(salted.columns) == sorted(plain.columns)
    names = plain.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.select(*names).collect()))


def test_join_groups_with_repeated_groups(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 40 else "cold") for i in range(42)], "i int, k string")
    groups = spark.createDataFrame([("hot", 40, "x"), ("hot", 40, "y"), ("cold", 2, "z")], "k string, n int, g string")
    found = sorted((r.i, r.g) for r in join_groups(rows, groups, ["k"], "n", hot_rows=5, repeated=True).collect())
    assert found == sorted((i, g) for i in range(42) for g in ("xy" if i < 40 else "z"))


@pytest.mark.parametrize("chunk", [3, 1_000])
def test_join_chunks(spark, chunk):
    left = spark.createDataFrame([(i, "hot" if i < 20 else f"k{i % 4}") for i in range(30)] + [(99, None)], "a int, k string")
    right = spark.createDataFrame([(i, "hot" if i < 31 else f"k{i % 3}") for i in range(40)] + [(99, None)], "b int, k string")
    even = (F.col("a") + F.col("b")) % 2 == 0
    for condition in (None, even):
        plain = left.join(right, "k") if condition is None else left.join(right, "k").where(condition)
        found = join_chunks(left, right, "k", "a", "b", chunk, condition)
        assert sorted(map(tuple, found.select("k", "a", "b").collect())) == sorted(map(tuple, plain.select("k", "a", "b").collect()))


def test_split_pairs(spark):
    rows = spark.createDataFrame([("k", i, 30) for i in range(30)] + [("l", i, 2) for i in range(2)], "k string, id int, n int")
    for chunk in (1, 4, 100):
        pairs = [(r.k, r.id_a, r.id_b) for r in split_pairs(rows, ["k"], "n", "id", chunk).collect()]
        assert sorted(pairs) == sorted([("k", i, j) for i in range(30) for j in range(i + 1, 30)] + [("l", 0, 1)])


def test_keep_ids(spark):
    rows = brute.frame(spark, [(str(i), "t", "c") for i in range(5)])
    ids = spark.createDataFrame([("1",), ("9",), ("3",)], "article_id string")
    assert sorted(r.article_id for r in keep_ids(rows, ids).collect()) == ["1", "3"]
