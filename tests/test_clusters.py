"""Clustering against brute force, with large buckets, and as a stream."""

import shutil
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from tests.corpus import as_texts, corpus
from twinfold.operators import candidates as cand
from twinfold.operators import clusters as cl
from twinfold.operators import features as ft
from twinfold.operators import joins
from twinfold.operators.components import connected_components
from twinfold.session import materialize
from twinfold.sources.articles import with_id_lists
from twinfold.streaming import incremental
from twinfold.streaming.incremental import IncrementalClusters, article_stream

ROWS = corpus(template=40)
TEXTS = as_texts(ROWS)


@pytest.fixture(scope="module")
def articles(spark):
    return materialize(brute.frame(spark, ROWS))


@pytest.fixture(scope="module")
def features(articles):
    return materialize(ft.extract_features(articles))


@pytest.fixture(scope="module")
def texts(features):
    return materialize(ft.text_groups(features))


def state(df):
    return {r.article_id: (r.cluster_id, r.similarity_score) for r in df.collect()}


def labels(result):
    return {key: cluster for key, (cluster, _) in result.items()}


def test_fingerprints(features):
    for row in ft.public_features(features).collect():
        text = TEXTS[row.article_id]
        assert row.simhash == f"{brute.simhash(text):016x}"
        assert row.minhash_signature == brute.bands(text)
        assert row.n_shingles == len(brute.shingles(text))


def test_candidates_of_distinct_texts(texts):
    first = {}
    for key in sorted(TEXTS):
        first.setdefault(TEXTS[key], key)
    expected = brute.candidates({key: text for text, key in first.items()})
    found = {(r.article_id_a, r.article_id_b): r.shared_bands for r in cand.candidates(texts).collect()}
    assert found == expected


def test_bands_find_nearly_all_similar_pairs():
    sets = {key: brute.shingles(text) for key, text in TEXTS.items()}
    keys = sorted(k for k in sets if sets[k])
    similar = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if brute.jaccard(sets[a], sets[b]) >= 0.8}
    found = similar & set(brute.candidates(TEXTS))
    assert len(similar) > 500 and len(found) / len(similar) > 0.99


def test_buckets_cut_into_chunks_give_the_same_pairs(texts):
    members = materialize(cand.bucket_members(cand.bucket_rows(texts)))
    whole = cand.candidate_pairs(members, chunk=10_000)
    cut = cand.candidate_pairs(members, chunk=7)
    assert whole.count() == cut.count() > 500
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_clusters_equal_brute_force(articles):
    assert state(cl.cluster_articles(articles)) == brute.clusters(TEXTS)


def test_scores_of_a_large_bucket(spark):
    """One bucket of 2,000 texts that differ in a number or two: clusters and scores as by brute force."""
    filler = " ".join(f"word{i}" for i in range(60))
    rows = [(f"p{i:04d}", "page", f"{filler} {i * 7919} {filler} {i % 13}") for i in range(2000)]
    texts = as_texts(rows)
    found = state(cl.cluster_articles(materialize(brute.frame(spark, rows))))
    first = brute.shingles(texts["p0000"])
    hashes = Counter(brute.simhash(t) for t in texts.values())
    for key, text in texts.items():
        exact = key == "p0000" or hashes[brute.simhash(text)] > 1
        assert found[key] == ("cluster_p0000", 1.0 if exact else brute.jaccard(brute.shingles(text), first))


def test_hot_keys_are_salted(articles, monkeypatch):
    monkeypatch.setattr(joins.join_groups, "__defaults__", ("inner", 3, None))
    assert state(cl.cluster_articles(articles)) == brute.clusters(TEXTS)


def test_verify_exact(articles):
    found = state(cl.cluster_articles(articles, verify_exact=True))
    assert found == brute.clusters(TEXTS, exact=False)


def test_row_order_and_partitions_do_not_matter(spark, articles):
    one = state(cl.cluster_articles(articles.orderBy(F.desc("article_id")).coalesce(1)))
    many = state(cl.cluster_articles(articles.repartition(13)))
    assert one == many


def test_stream_equals_batch(spark, articles, tmp_path):
    state_of = IncrementalClusters(spark, str(tmp_path / "state"))
    slices = [articles.where(F.pmod(F.xxhash64("article_id"), F.lit(2)) == i) for i in range(2)]
    for batch, rows in enumerate(slices):
        state_of.apply(rows, batch)
    found = state(state_of.assigned())
    assert found == brute.clusters(TEXTS)
    # A replayed batch with an old article sent again changes nothing.
    state_of.apply(slices[1].unionByName(slices[0].limit(1)), 1)
    assert state(state_of.assigned()) == found
    assert state_of.articles().count() == len(ROWS)
    # Rows that break a rule are kept apart, with the reasons.
    state_of.apply(articles.limit(1).withColumns({"article_id": F.lit("bad"), "content": F.lit(None).cast("string")}), 2)
    assert [(r.article_id, r.reasons) for r in state_of.table("rejects").collect()] == [("bad", ["content_missing"])]
    assert state(state_of.assigned()) == found


def test_state_without_an_index(spark, tmp_path):
    """A state whose index is missing gets it from its tables."""
    words = "one two three four five six seven eight nine ten".split()
    rows = brute.frame(spark, [("1", "", " ".join(words)), ("2", "", " ".join(words)), ("3", "", "something else entirely")])
    first = IncrementalClusters(spark, str(tmp_path / "state"))
    first.apply(rows.where("article_id <> '2'"), 0)
    moved = IncrementalClusters(spark, str(tmp_path / "copy"))
    for name in ("articles", "updates", "features", "texts", "scores", "aliases", "rejects"):
        shutil.copytree(tmp_path / "state" / name, tmp_path / "copy" / name, dirs_exist_ok=True)
    assert moved.index.runs() == []
    again = IncrementalClusters(spark, str(tmp_path / "copy"))
    assert again._finished() == [0] and [(r.first, r.last) for r in again.index.runs()] == [(0, 0)]
    again.apply(rows.where("article_id = '2'"), 1)
    found = {r.article_id: (r.cluster_id, r.similarity_score) for r in again.assigned().collect()}
    assert found == {"1": ("cluster_1", 1.0), "2": ("cluster_1", 1.0), "3": (None, None)}


@pytest.mark.parametrize("kept", [True, False])
def test_stream_compares_by_sketches(spark, tmp_path, monkeypatch, kept):
    """A batch knows the sketches of all texts that it compares; a state from before they were kept gives the same clusters."""
    words = [f"word{i}" for i in range(40)]
    variants = [("1", "", " ".join(words)), ("2", "", " ".join(words[:-1] + ["other"])), ("3", "", " ".join(words[::-1])), ("4", "", "something else")]
    rows = brute.frame(spark, variants)
    state_of = IncrementalClusters(spark, str(tmp_path / "state"))
    state_of.apply(rows.where("article_id <> '2'"), 0)
    if not kept:
        folder = tmp_path / "state" / "texts" / "batch=0"
        before = materialize(spark.read.parquet(str(folder)).drop("sketch"))
        before.write.mode("overwrite").parquet(str(folder))
    asked = []

    def compared(members, articles, params, links, total=None, sketches=None):
        ids = {r.article_id for r in members.select("article_id").distinct().collect()}
        asked.append((ids, {r.article_id: r.sketch for r in sketches.collect()}))
        return cl.verified_edges(members, articles, params, links, total, sketches)

    monkeypatch.setattr(incremental, "verified_edges", compared)
    state_of.apply(rows.where("article_id = '2'"), 1)
    [(ids, sketches)] = asked
    assert {"1", "2"} <= ids <= set(sketches)
    assert sketches["2"] is not None and (sketches["1"] is not None) == kept
    assert state(state_of.assigned()) == brute.clusters(as_texts(variants))


def test_file_stream(spark, articles, tmp_path):
    inbox = str(tmp_path / "inbox")
    articles.repartition(2).write.parquet(inbox)
    state_of = IncrementalClusters(spark, str(tmp_path / "state"))
    query = state_of.run(article_stream(spark, inbox, files_per_batch=1), str(tmp_path / "checkpoint"))
    query.awaitTermination(300)
    assert state(state_of.assigned()) == brute.clusters(TEXTS)


def test_recheck_of_some(spark, articles):
    stored = materialize(cl.cluster_articles(articles))
    again = [key for i, key in enumerate(sorted(TEXTS)) if i % 4 == 0]
    ids = materialize(spark.createDataFrame([(i,) for i in again], "article_id string"))
    found = {r.article_id: r for r in cl.recheck(stored, articles, ids).collect()}
    assert len(found) == len(TEXTS)
    # The model: rechecked articles start alone, others with their cluster; verified pairs
    # with at least one rechecked article connect.
    old = brute.clusters(TEXTS)
    pairs = {p: s for p, s in brute.edges(TEXTS, exact=False).items() if p[0] in again or p[1] in again}
    node = {k: f"~{k}" if k in again or not old[k][0] else old[k][0] for k in TEXTS}
    root = brute.components([(node[a], node[b]) for a, b in pairs])
    members = {}
    for key in TEXTS:
        members.setdefault(root.get(node[key], node[key]), []).append(key)
    for name, keys in members.items():
        for key in keys:
            if not name.startswith("~"):
                expected = name
            elif node[key] in root:
                expected = f"cluster_{min(keys)}"
            else:
                expected = None
            assert found[key].cluster_id == expected
    inside = {k: r.cluster_id for k, r in found.items() if r.cluster_id}
    scores = brute.cluster_scores({k: TEXTS[k] for k in inside}, inside)
    assert {k: r.similarity_score for k, r in found.items()} == {k: scores.get(k) for k in TEXTS}


def test_recheck_splits_a_cluster_without_its_bridge(spark):
    """a ~ b ~ c ~ d in a chain and an equal-SimHash pair: without b and e the rest falls apart, and b joins a again."""
    import random

    rnd = random.Random(12)

    def words(n):
        return ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]

    def near(first, changes, at):
        return first[:at] + words(changes) + first[at + changes :]

    a = words(100)
    b = near(a, 6, 10)
    c = near(b, 6, 40)
    d = near(c, 2, 70)
    other = words(60)
    turned = list(reversed(other))
    texts = {"a": a, "b": b, "c": c, "d": d, "e": other, "f": turned, "g": words(50)}
    rows = [(k, "", " ".join(v)) for k, v in texts.items()]
    plain = {k: f" {v}".strip() for k, _, v in rows}
    assert set(brute.edges(plain, exact=False)) >= {("a", "b"), ("b", "c"), ("c", "d")}
    assert ("a", "c") not in brute.edges(plain, exact=False) and ("a", "d") not in brute.edges(plain, exact=False)
    articles = materialize(brute.frame(spark, rows))
    stored = materialize(cl.cluster_articles(articles))
    assert {r.article_id: r.cluster_id for r in stored.collect()} == {
        "a": "cluster_a", "b": "cluster_a", "c": "cluster_a", "d": "cluster_a", "e": "cluster_e", "f": "cluster_e", "g": None}
    # b is now a text of its own.
    changed = materialize(brute.frame(spark, [r if r[0] != "b" else ("b", "", " ".join(words(90))) for r in rows]))
    ids = materialize(spark.createDataFrame([("b",), ("e",)], "article_id string"))
    whole = {r.article_id: r.cluster_id for r in cl.recheck(stored, changed, ids).collect()}
    assert whole == {"a": "cluster_a", "b": None, "c": "cluster_a", "d": "cluster_a", "e": None, "f": "cluster_e", "g": None}
    found = {r.article_id: r for r in cl.recheck(stored, changed, ids, split=True).collect()}
    assert {k: r.cluster_id for k, r in found.items()} == {
        "a": None, "b": None, "c": "cluster_c", "d": "cluster_c", "e": None, "f": None, "g": None}
    near_cd = brute.jaccard(brute.shingles(plain["c"]), brute.shingles(plain["d"]))
    assert {k: r.similarity_score for k, r in found.items()} == {
        "a": None, "b": None, "c": 1.0, "d": near_cd, "e": None, "f": None, "g": None}
    assert {k: r.cluster_status for k, r in found.items()} == {k: "matched" if k in "cd" else "unique" for k in texts}


def test_cluster_records(articles):
    stored = materialize(cl.cluster_articles(with_id_lists(articles).withColumns(
        {"created_at": F.col("publish_time"), "updated_at": F.col("publish_time")}
    )))
    expected = Counter(name for name, _ in brute.clusters(TEXTS).values() if name)
    found = [(r.cluster_id, r.size) for r in cl.build_clusters(stored, articles).collect()]
    assert len(found) == len(expected) and dict(found) == expected


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(70)]
    pairs += [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(60)] + [("x", "x")]
    found = connected_components(spark.createDataFrame(pairs, "u string, v string"))
    expected = brute.components(pairs)
    expected.pop("x")  # a node without a link to another one
    loners = {k for k, v in expected.items() if list(expected.values()).count(v) == 1}
    assert {r.node: r.component for r in found.collect()} == {k: v for k, v in expected.items() if k not in loners}


def test_topk_lists(features, texts):
    everything = brute.candidates(TEXTS)
    for k in (3, 50):
        lists = {}
        for r in cand.lsh_topk(features, texts, k).collect():
            lists.setdefault(r.article_id, []).append((r["rank"], r.candidate_id, r.shared_bands))
        for key in TEXTS:
            others = [(-n, b if a == key else a) for (a, b), n in everything.items() if key in (a, b)]
            expected = [(i + 1, other, -n) for i, (n, other) in enumerate(sorted(others)[:k])]
            assert sorted(lists.get(key, [])) == expected


def test_near_simhash(texts):
    values = {brute.simhash(t) for t in TEXTS.values()}
    unsigned = {(min(a, b), max(a, b)) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    mask = (1 << 64) - 1
    found = {tuple(sorted((r.simhash_a & mask, r.simhash_b & mask))) for r in cand.near_simhash(texts).collect()}
    assert found == unsigned


def test_near_simhash_of_many_values_in_one_block(spark):
    rng = np.random.default_rng(3)
    # 20,000 values with equal upper halves, 300 of them copied with one to four bits changed.
    low = np.unique(rng.integers(0, 1 << 32, 20_000, dtype=np.uint64))
    near = low[:300].copy()
    for i in range(300):
        for bit in rng.choice(32, i % 4 + 1, replace=False):
            near[i] ^= np.uint64(1 << int(bit))
    all_ = np.unique(np.concatenate([low, near])) | np.uint64(0xABCDEF01 << 32)
    rows = spark.createDataFrame([(int(v),) for v in all_.view(np.int64)], "simhash bigint").withColumn("copies", F.lit(1).cast("long"))
    expected = set()
    for i, v in enumerate(all_):
        for j in np.flatnonzero(np.bitwise_count(all_[i + 1 :] ^ v) <= 3):
            expected.add(frozenset((int(v), int(all_[i + 1 + j]))))
    mask = (1 << 64) - 1
    found = cand.near_simhash(rows).collect()
    assert {frozenset((r.simhash_a & mask, r.simhash_b & mask)) for r in found} == expected
    assert len(found) == len(expected) >= 200
    groups = cand.near_blocks(rows.withColumnRenamed("copies", "articles"), 3, 6)
    sizes = [r.members for g in groups for r in g.select("mask", "bits", "members").distinct().collect()]
    assert len(groups) > 1 and max(sizes) <= cand.LISTED_VALUES
    assert sum(n * (n - 1) // 2 for n in sizes) < len(all_) ** 2 / 20


def test_classify(features, texts, articles):
    hashes = {k: brute.simhash(t) for k, t in TEXTS.items()}
    sets = {k: brute.shingles(t) for k, t in TEXTS.items()}
    expected = {k: ("unique", 0.0) for k in TEXTS}
    for a, b in brute.candidates(TEXTS):
        score = brute.jaccard(sets[a], sets[b])
        for end in (a, b):
            verdict, best = expected[end]
            if (hashes[a] ^ hashes[b]).bit_count() <= 3:
                expected[end] = ("duplicate", 1.0)
            elif verdict != "duplicate" and score >= 0.8:
                expected[end] = ("similar", max(best, score))
    found = {r.article_id: (r.verdict, r.score) for r in cand.classify_articles(features, texts, articles).collect()}
    assert found == expected


def test_components_hold_every_copy(spark, tmp_path):
    from twinfold.plans.queries import QUERIES

    copies = [(i, "one text that has only exact copies of itself " * 3) for i in range(4)]
    more = [(10, "another page about rivers and the towns beside them"), (11, "nothing else in here is like this one at all")]
    rows = [(i, t, "en", "s", len(t)) for i, t in copies + more]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in QUERIES["article_components"](spark, str(tmp_path)).collect()}
    assert found == {(str(i), "0") for i in range(4)}
    members = {tuple(r) for r in QUERIES["text_members"](spark, str(tmp_path)).collect()}
    assert members == {(str(i), "0", 4) for i in range(4)} | {("10", "10", 1), ("11", "11", 1)}
