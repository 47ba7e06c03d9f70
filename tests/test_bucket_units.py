"""Pairs of buckets that sketches leave, found without listing a bucket's pairs."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.brute import frame, jaccard, shingles
from twinfold.operators import block_join, bucket_units
from twinfold.operators import candidates as cand
from twinfold.operators import clusters as cl
from twinfold.operators.features import extract_features, text_groups
from twinfold.operators.set_join import possible
from twinfold.params import DEFAULT
from twinfold.session import materialize


def bucket_table(spark, seed: int, n: int = 60):
    """Texts of which some are near copies, dealt to buckets of three bands by hand."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefg", k=7)) for _ in range(500)]
    rows = []
    for i in range(n):
        text = rows[-1][2] + f" {i}" if i % 6 == 5 else " ".join(rnd.sample(words, rnd.choice((20, 22, 25, 60))))
        rows.append((f"{i:03d}", "", text))
    articles = materialize(frame(spark, rows))
    dealt = [(key, (band << 32) + rnd.randrange(1 + 2 * band)) for key, _, _ in rows for band in range(3) if rnd.random() < 0.9]
    texts = materialize(text_groups(extract_features(articles)))
    members = spark.createDataFrame(dealt, "article_id string, bucket bigint").join(texts.select("article_id", "simhash", "n_shingles"), "article_id")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("members"))
    return rows, articles, texts, materialize(members.join(sizes, "bucket")), dealt


def left(texts, shared: dict, least: float) -> set:
    """Pairs that share buckets and whose sketches leave ``least`` possible, one by one."""
    sketch = {r.article_id: bytes(r.sketch) for r in texts.collect()}
    size = {key: int.from_bytes(value[:4], "little") for key, value in sketch.items()}
    pairs = [p for p in shared if min(size[p[0]], size[p[1]]) / max(size[p[0]], size[p[1]]) >= least]
    keep = possible(least)([sketch[a] for a, _ in pairs], [sketch[b] for _, b in pairs])
    return {p for p, k in zip(pairs, keep) if k}


def shared_buckets(dealt) -> dict:
    buckets: dict[int, list] = {}
    for key, bucket in dealt:
        buckets.setdefault(bucket, []).append(key)
    shared: dict[tuple, int] = {}
    for keys in buckets.values():
        for pair in combinations(sorted(keys), 2):
            shared[pair] = shared.get(pair, 0) + 1
    return shared


@pytest.mark.parametrize("piece", [7, 2_000])
def test_possible_pairs_of_buckets(spark, monkeypatch, piece):
    monkeypatch.setattr(bucket_units, "WHOLE", 2)
    monkeypatch.setattr(bucket_units, "PIECE", piece)
    monkeypatch.setattr(bucket_units, "GROUP_BYTES", 4_000)
    rows, articles, texts, members, dealt = bucket_table(spark, 3)
    shared = shared_buckets(dealt)
    for least in (0.8, 0.3):
        found = bucket_units.possible_pairs(members, texts, least).collect()
        want = left(texts, shared, least)
        assert len(found) == len(want) and {(r.article_id_a, r.article_id_b): r.shared_bands for r in found} == {p: shared[p] for p in want}
        assert len(want) < len(shared)
    size = {r.article_id: r.n_shingles for r in texts.collect()}
    assert all((r.n_shingles_a, r.n_shingles_b) == (size[r.article_id_a], size[r.article_id_b]) for r in found)
    # Without sketches only sizes rule pairs out; with labels only pairs across them are given.
    every = bucket_units.possible_pairs(members, None, 1e-9).count()
    assert every == len(shared)
    labels = spark.createDataFrame([(key, "x" if int(key) % 2 else "y") for key, _, _ in rows[:40]], "article_id string, label string")
    across = {(r.article_id_a, r.article_id_b) for r in bucket_units.possible_pairs(members, None, 1e-9, labels).collect()}
    assert across == {(a, b) for a, b in shared if int(b) >= 40 or int(a) % 2 != int(b) % 2}


@pytest.mark.parametrize("piece", [7, 2_000])
def test_links_connect_what_pairs_connect(spark, monkeypatch, piece):
    monkeypatch.setattr(bucket_units, "WHOLE", 2)
    monkeypatch.setattr(bucket_units, "PIECE", piece)
    _, _, texts, members, dealt = bucket_table(spark, 5)
    for least in (0.8, 0.2):
        pairs = bucket_units.possible_pairs(members, texts, least).select(F.col("article_id_a").alias("u"), F.col("article_id_b").alias("v"))
        links = materialize(bucket_units.possible_links(members, texts, least))
        want, got = ({(r.node, r.component) for r in cl.connected_components(x).collect()} for x in (pairs, links))
        assert got == want and want
        assert links.count() <= bucket_units.sent_units(members, texts, None).count()


def test_texts_without_a_possible_partner_are_not_read(spark, monkeypatch):
    """A bucket whose texts are alike by chance: sets are made of those that can be similar, not of all of it."""
    rows, articles, texts, _, _ = bucket_table(spark, 7)
    members = materialize(texts.select("article_id", "simhash", "n_shingles", F.lit(0).cast("long").alias("bucket"), F.lit(len(rows)).cast("long").alias("members")))
    stored, keep = [], block_join.materialize
    monkeypatch.setattr(block_join, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    found = {(r.article_id_a, r.article_id_b): r.score for r in block_join.similar_in_buckets(members, articles, DEFAULT, sketches=texts).collect()}
    sets = {key: shingles(text.strip()) for key, _, text in rows}
    want = {(a, b): jaccard(sets[a], sets[b]) for a, b in combinations(sorted(sets), 2)}
    want = {pair: score for pair, score in want.items() if score >= 0.8}
    assert found == pytest.approx(want) and len(want) >= 5
    assert max(df.count() for df in stored if "ids" in df.columns) < len(rows) / 2


def test_sets_are_made_after_the_join(spark, monkeypatch, tmp_path):
    """No filter stands between the articles and the join that picks those whose sets are made."""
    rows, articles, texts, _, _ = bucket_table(spark, 7)
    members = materialize(texts.select("article_id", "simhash", "n_shingles", F.lit(0).cast("long").alias("bucket"), F.lit(len(rows)).cast("long").alias("members")))
    plans, keep = [], block_join.materialize
    monkeypatch.setattr(block_join, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    block_join.similar_in_buckets(members, articles, DEFAULT, sketches=texts)
    [plan] = [p for p in plans if "LeftSemi" in p]
    lines = plan.splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    assert not any("PythonEval" in line or "ArrowEval" in line or "value(" in line for line in lines[semi:])


def test_near_texts_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(bucket_units, "WHOLE", 2)
    monkeypatch.setattr(bucket_units, "PIECE", 9)
    _, _, _, members, dealt = bucket_table(spark, 11)
    rnd = random.Random(2)
    value = {r.article_id: rnd.choice((0, -1, 255)) ^ (1 << rnd.randrange(8) | 1 << rnd.randrange(63)) for r in members.collect()}
    known = spark.createDataFrame(list(value.items()), "article_id string, simhash bigint")
    members = materialize(members.drop("simhash").join(known, "article_id").select(*members.columns))
    for distance in (0, 2):
        near = [p for p in shared_buckets(dealt) if bin((value[p[0]] ^ value[p[1]]) & (1 << 64) - 1).count("1") <= distance]
        found = [r.article_id for r in bucket_units.near_texts(members, distance).collect()]
        assert sorted(found) == sorted({key for pair in near for key in pair}) and found


def test_verdicts_do_not_list_all_candidates(spark, monkeypatch):
    """Pairs of duplicates, which the verdict needs no score of, are not stored; verdicts are those of all candidates."""
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdef", k=6)) for _ in range(60)]
    whole = " ".join(words * 3)
    rows = [(f"{i:03d}", "", whole + f" {i}" if i < 20 else " ".join(rnd.sample(words, 40))) for i in range(40)]
    articles = materialize(frame(spark, rows))
    features = materialize(extract_features(articles))
    texts = materialize(text_groups(features))
    stored, keep = [], cand.materialize
    monkeypatch.setattr(cand, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    found = {r.article_id: (r.verdict, r.score) for r in cand.classify_articles(features, texts, articles).collect()}
    listed = [df.count() for df in stored if "article_id_b" in df.columns]
    pairs = {(r.article_id_a, r.article_id_b): r for r in cand.hamming_pairs(cand.candidates(texts)).collect()}
    sets = {key: shingles(text) for key, _, text in rows}
    for key, _, _ in rows:
        mine = [(p, r) for p, r in pairs.items() if key in p]
        best = max((jaccard(sets[a], sets[b]) for (a, b), _ in mine), default=0.0)
        near = any(r.distance <= DEFAULT.hamming for _, r in mine)
        assert found[key] == (("duplicate", 1.0) if near else ("similar", pytest.approx(best)) if best >= 0.8 else ("unique", 0.0))
    assert sum(v == "duplicate" for v, _ in found.values()) > 10 and max(listed) < len(pairs) / 2
