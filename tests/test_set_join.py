"""Shingle ids, sketches, prefixes and the joins built on them, against plain sets."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.brute import edges, frame, jaccard, norm, shingles
from tests.corpus import corpus
from twinfold.functions import shingle_sets as ss
from twinfold.operators import candidates as cand
from twinfold.operators import clusters as cl
from twinfold.operators import block_join, hot_buckets, set_join
from twinfold.operators.features import extract_features, text_groups
from twinfold.session import materialize

ODD = ["", "a", "abcd", "abcde", "新闻聚类系统新闻聚类系统", "\U0001f600" * 7, "aaaaaaaaaaaa", "naïve café " * 3]


def texts_of(seed: int) -> list[str]:
    rnd = random.Random(seed)
    base = "".join(rnd.choices("abcdefgh ", k=400))
    found = list(ODD)
    for changes in (0, 1, 3, 10, 30, 100):
        text = list(base)
        for at in rnd.sample(range(len(text)), changes):
            text[at] = rnd.choice("ijklmn")
        found.append("".join(text))
    return found + [base[:200], base * 3, "".join(rnd.choices("xyz", k=3000))]


def test_ids_sketches_and_overlaps():
    texts = texts_of(1)
    ids = [ss.ids_of(t, 5) for t in texts]
    for text, own in zip(texts, ids):
        assert len(own) == len(shingles(text)) and (np.diff(own.astype(object)) > 0).all()
    for (t, a), (u, b) in combinations(zip(texts, ids), 2):
        both = len(shingles(t) & shingles(u))
        assert ss.common(a, b) == both
        assert both <= ss.most_common(ss.sketch_of(a), len(a), ss.sketch_of(b), len(b))
        assert ss.similarity(both, len(a), len(b)) == pytest.approx(jaccard(shingles(t), shingles(u)))


def test_sketches_rule_out_half_alike_texts():
    """Texts of any size with two thirds of their words in common need no comparison of sets."""
    rnd = random.Random(2)
    for n in (60, 400, 4000, 40_000):
        shared = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(n * 2 // 3)]
        one, other = (" ".join(shared + ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(n // 3)]) for _ in range(2))
        a, b = ss.ids_of(one, 5), ss.ids_of(other, 5)
        bound = ss.similarity(ss.most_common(ss.sketch_of(a), len(a), ss.sketch_of(b), len(b)), len(a), len(b))
        assert ss.similarity(ss.common(a, b), len(a), len(b)) <= bound < 0.8


def test_similar_sets_share_a_prefix_element():
    rnd = random.Random(3)
    frequent = np.sort(np.array([rnd.getrandbits(64) for _ in range(50)], dtype=np.uint64))
    counts = np.array([rnd.randint(2, 90) for _ in range(50)])
    for _ in range(300):
        pool = [*frequent.tolist(), *(rnd.getrandbits(64) for _ in range(30))]
        a = set(rnd.sample(pool, rnd.randint(1, 60)))
        b = {x for x in a if rnd.random() < 0.93} | set(rnd.sample(pool, rnd.randint(0, 3)))
        if not b or len(a & b) / len(a | b) < 0.8:
            continue
        chosen = [set(ss.prefix_of(np.array(sorted(s), dtype=np.uint64), frequent, counts, 0.8).tolist()) for s in (a, b)]
        assert chosen[0] & chosen[1]


def corpus_tables(spark, template=0, seed=7):
    rows = corpus(seed, template=template)
    articles = materialize(frame(spark, rows))
    texts = materialize(text_groups(materialize(extract_features(articles))))
    return rows, articles, texts


def distinct_texts(rows) -> dict[str, str]:
    first: dict[str, str] = {}
    for key, title, content in rows:
        text = norm(title, content)
        first[text] = min(key, first.get(text, key))
    return {key: text for text, key in first.items()}


def brute_pairs(rows) -> dict[tuple[str, str], float]:
    sets = {k: shingles(t) for k, t in distinct_texts(rows).items()}
    found = {(a, b): jaccard(sets[a], sets[b]) for a, b in combinations(sorted(sets), 2)}
    return {pair: score for pair, score in found.items() if score >= 0.8}


@pytest.mark.parametrize("small", [False, True])
def test_all_similar_pairs(spark, monkeypatch, small):
    if small:  # many chunks, units and groups
        for name, value in (("UNIT", 2), ("GROUP", 500), ("CHUNK", 3), ("HOT_GROUPS", 2), ("FREQUENT", 10), ("SAMPLE", 2000)):
            monkeypatch.setattr(set_join, name, value)
    rows, articles, texts = corpus_tables(spark, template=12)
    found = set_join.similar_text_pairs(texts, articles)
    want = brute_pairs(rows)
    got = {(r.article_id_a, r.article_id_b): r.score for r in found.collect()}
    assert got == pytest.approx(want)
    assert len(want) > 60
    shared = {(r.article_id_a, r.article_id_b) for r in set_join.found_by(found, texts).where("found").collect()}
    assert shared == set(edges(distinct_texts(rows), exact=False)) & set(want)
    assert set_join.similar_text_pairs(texts.where("false"), articles).count() == 0


def test_no_text_travels_with_pairs(spark):
    _, articles, texts = corpus_tables(spark)
    pairs = materialize(cand.candidate_pairs(cand.stored_members(texts), 0.8))
    scored = set_join.per_unit(pairs, materialize(set_join.set_rows(pairs, articles)), set_join.scores, keep=False)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "normalized" not in plan
    kept = set_join.possible_pairs(pairs, texts, 0.8).columns
    assert kept == pairs.columns


def test_sets_are_made_where_texts_arrive(spark, monkeypatch):
    """No stored or shuffled row holds a shingle set, which is several times its text; small groups give the same scores."""
    rows, articles, texts = corpus_tables(spark)
    pairs = materialize(cand.candidate_pairs(cand.stored_members(texts)))
    stored, write = [], set_join.materialize
    monkeypatch.setattr(set_join, "materialize", lambda df: stored.append(df) or write(df))
    got = {(r.article_id_a, r.article_id_b): r.score for r in set_join.score_pairs(pairs, articles).collect()}
    assert stored and not any(f.dataType.simpleString() == "binary" for df in stored for f in df.schema.fields)
    plan = stored[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "ids" not in plan.replace("article_ids", "")
    text = {i: (t or "") for i, t in articles.transform(set_join.with_normalized).select("article_id", "normalized").collect()}
    sets = {i: ss.ids_of(t, 5) for i, t in text.items()}
    assert got == pytest.approx({(a, b): ss.similarity(ss.common(sets[a], sets[b]), len(sets[a]), len(sets[b])) for a, b in got})
    assert len(got) == pairs.count() > 0
    for name, value in (("GROUP", 500), ("HOT_GROUPS", 2)):
        monkeypatch.setattr(set_join, name, value)
    assert {(r.article_id_a, r.article_id_b): r.score for r in set_join.score_pairs(pairs, articles).collect()} == got


def test_sketches_change_no_result(spark):
    _, articles, texts = corpus_tables(spark, template=20)
    pairs = materialize(cand.candidate_pairs(cand.stored_members(texts)))
    every = set_join.score_pairs(pairs, articles).where("score >= 0.8").select("article_id_a", "article_id_b", "score")
    some = set_join.score_pairs(pairs, articles, sketches=texts, least=0.8).select("article_id_a", "article_id_b", "score")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))


def test_pair_bounds():
    """No bound is below a similarity; sketches of several widths."""
    ids = [x for x in map(lambda t: ss.ids_of(t, 5), texts_of(4)) if len(x)]
    sketches, sizes = [ss.sketch_of(x) for x in ids], np.array([len(x) for x in ids])
    bounds = set_join.pair_bounds(sketches, sizes, sketches[::-1], sizes[::-1])
    for i, a in enumerate(ids):
        for j, b in enumerate(ids[::-1]):
            assert bounds[i, j] >= ss.similarity(ss.common(a, b), len(a), len(b))


def test_dense_families_are_sent_once(spark, monkeypatch):
    """Near copies of one text: all are pairs, and one unit holds them instead of one for each text."""
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdef", k=6)) for _ in range(200)]
    rows = [(str(i), "", " ".join(words) + f" {i}") for i in range(40)]
    articles = frame(spark, rows)
    texts = materialize(text_groups(extract_features(articles)))
    units, per_unit = [], set_join.per_unit
    monkeypatch.setattr(set_join, "per_unit", lambda pairs, *a, **k: units.append(pairs) or per_unit(pairs, *a, **k))
    found = set_join.similar_text_pairs(texts, articles)
    assert found.count() == 40 * 39 // 2
    assert units[-1].select("unit").distinct().count() == 1
    monkeypatch.setattr(set_join, "FAMILY", 15)
    again = set_join.similar_text_pairs(texts, articles)
    assert found.exceptAll(again.select(found.columns)).count() == 0 and units[-1].select("unit").distinct().count() > 1


def test_frequent_shingles_list_no_pairs(spark, monkeypatch):
    """Texts of the same few words share all their shingles' holders, but hardly a pair is similar: none is stored."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdef", k=6)) for _ in range(60)]
    rows = [(str(i), "", " ".join(rnd.sample(words, 30))) for i in range(300)]
    rows += [(f"{i}x", "", text + " end") for i, _, text in rows[:3]]
    articles = frame(spark, rows)
    texts = materialize(text_groups(extract_features(articles)))
    stored, keep = [], set_join.materialize
    monkeypatch.setattr(set_join, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    found = set_join.similar_text_pairs(texts, articles)
    want = {(a[0], b[0]) for a, b in combinations(sorted(rows), 2) if jaccard(shingles(a[2]), shingles(b[2])) >= 0.8}
    assert {(r.article_id_a, r.article_id_b) for r in found.collect()} == want and len(want) >= 3
    assert max(df.count() for df in stored) <= 303


@pytest.mark.parametrize("listed", [(1, 1), (1, 1000), (1000, 1000)])
def test_bucket_size_does_not_decide(spark, monkeypatch, listed):
    """All buckets through listing, through pivots, and through the prefix filter: the same components."""
    monkeypatch.setattr(cl, "LISTED", listed[0])
    monkeypatch.setattr(hot_buckets, "LISTED", listed[1])
    rows, articles, texts = corpus_tables(spark, template=25, seed=9)
    found = cl.verified_edges(cand.bucket_rows(texts), articles, cl.DEFAULT, None, None, texts)
    links = found.select(F.col("article_id_a").alias("u"), F.col("article_id_b").alias("v"))
    got = {r.node: r.component for r in cl.connected_components(links).collect()}
    pairs = edges(distinct_texts(rows), exact=False)
    label: dict[str, str] = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    assert got == {x: root(x) for x in label}


@pytest.mark.parametrize("block", [2_000, 8_000_000])
def test_large_buckets_are_compared_by_blocks(spark, monkeypatch, block):
    """No dissimilar pair is listed, whatever the buckets hold, and similar pairs have their scores and shared bands."""
    rows, articles, texts = corpus_tables(spark, template=25, seed=9)
    want = cand.similar_pairs(texts, articles)
    columns = sorted(want.columns)
    monkeypatch.setattr(cand, "LISTED", 1)
    monkeypatch.setattr(block_join, "BLOCK", block)
    stored = []
    monkeypatch.setattr(cand, "materialize", lambda df: stored.append(materialize(df)) or stored[-1])
    got = cand.similar_pairs(texts, articles)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert want.count() > 60
    pairs = {(r.article_id_a, r.article_id_b) for s in stored if "article_id_b" in s.columns for r in s.collect()}
    assert pairs == {(r.article_id_a, r.article_id_b) for r in want.collect()}


def test_common_counts():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.zipf(1.3, size=rnd.integers(1, 200)) % 5_000).astype(np.uint64) for _ in range(150)]
    left, right = sets[:90], sets[90:]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert block_join.common_counts(left, right).tolist() == want
    assert block_join.common_counts([np.array([1], dtype=np.uint64)], [np.array([2], dtype=np.uint64)]).tolist() == [[0]]


def test_texts_are_sent_packed(spark, monkeypatch):
    """What units are sent is compressed text by text: less than the text, and the scores are those of the text."""
    words = ["one", "two", "three", "four", "新闻", "\U0001f600"]
    rows = [(str(i), "", " ".join(words * 60) + f" {i}" * (i % 3)) for i in range(6)]
    articles = frame(spark, rows)
    texts = materialize(text_groups(extract_features(articles)))
    sent, per_unit = [], set_join.per_unit
    monkeypatch.setattr(set_join, "per_unit", lambda pairs, values, *a, **k: sent.append(values) or per_unit(pairs, values, *a, **k))
    pairs = materialize(cand.candidate_pairs(cand.stored_members(texts)))
    found = {(r.article_id_a, r.article_id_b): r.score for r in set_join.score_pairs(pairs, articles).collect()}
    sets = {key: shingles(text) for key, _, text in rows}
    assert found == {pair: jaccard(sets[pair[0]], sets[pair[1]]) for pair in found} and found
    [values] = sent
    sizes = {r.article_id: len(r[1]) for r in values.collect()}
    assert sizes and all(n < len(rows[int(key)][2].encode()) / 4 for key, n in sizes.items())
