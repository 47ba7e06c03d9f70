"""Token counts, hard negatives and periodic runs against the library and brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from twinfold.llm import hard_negatives, periodic_runs, queries, token_counts
from twinfold.llm.queries import PIECE_BPE

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ODD = [
    None, "", " ", "  ", "\n", "\n\n", " \n ", "a", "a\nb", "a \n b\n", "é è", "é\nè ", "▁a ▁", "a\0b \0", "<s> </s><unk> [INST]", "\t\tx\ty",
    "x" * 3000, " " * 50, "a" + " " * 40 + "b", "你好 世界", "😀 😀", "İ ΣΑΣ é\x1c b\x85c \xa0 d", "“quotes” — and　wide", "12ab 3½² 1000 000",
    "<0x0A> \n<0x0A>", "\r\n \r\n", "don't ... --- !!! ???", "\x7f \x01", "word " * 60_000,
]


def clashing(frame, *names):
    return frame.select("*", *[F.lit("z").alias(n) for n in names])


def test_token_counts(spark):
    rnd = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "é", "▁", "th", "e", "1", ".", " the", " of", "😀", "\t", "'"]
    texts = ODD + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(400)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(3, texts[9]), (3, texts[9])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "n_tokens", "c", "piece", "n")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))
    want = Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    counts = token_counts.learn(docs, public_tokenizers.path(PIECE_BPE))
    found = docs.select("doc_id", token_counts.token_counts(docs, counts).alias("r")).select("doc_id", "r.*")
    assert Counter(map(tuple, found.collect())) == want
    none = docs.where("false")
    empty = token_counts.learn(none, public_tokenizers.path(PIECE_BPE))
    assert none.select(token_counts.token_counts(none, empty)).count() == 0
    # A table of nothing, then a cache that turns over all the time: the same counts.
    counts.table = token_counts.Table({})
    whole = [(t or "").encode() for _, t in rows]
    expected = [len(library.encode(t or "")) for _, t in rows]
    assert counts.count(whole).tolist() == expected


def test_token_counts_with_small_cache(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counts = token_counts.Counts(public_tokenizers.path(PIECE_BPE))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_BPE))
    rnd = random.Random(4)
    for _ in range(30):
        texts = [" ".join(rnd.choice(["cat", "dog", "house", "tree", "x", "yy", "zzz"]) for _ in range(9)) for _ in range(3)]
        assert counts.count([t.encode() for t in texts]).tolist() == [len(library.encode(t)) for t in texts]


def test_token_table():
    rnd = random.Random(5)
    keys = {bytes(rnd.choices(b"ab \0c", k=rnd.randint(1, 20))): rnd.randrange(9) for _ in range(3000)}
    table = token_counts.Table(keys)
    counts = token_counts.Counts(public_tokenizers.path(PIECE_BPE))
    asked = [*keys, *(bytes(rnd.choices(b"ab \0d", k=rnd.randint(1, 20))) for _ in range(1000))]
    sizes = np.array(list(map(len, asked)))
    low, high = counts._keys(b"".join(asked), np.cumsum(sizes) - sizes, sizes)
    want = [keys.get(k, -1) if len(k) <= 15 else -1 for k in asked]
    assert table.find(low, high).tolist() == want


def vector_rows():
    rnd = np.random.default_rng(3)
    rows = []
    centres = rnd.standard_normal((6, 12))
    for i in range(420):
        v = centres[i % 6] + rnd.standard_normal(12) * 0.3
        rows.append((i, int(rnd.integers(0, 5)), v.tolist()))
    rows += [(1000 + i, i % 3, rows[40][2]) for i in range(60)]  # equal vectors: ties
    rows += [(2000 + i, 1, [0.5, -0.25 * i]) for i in range(30)]  # another length
    rows += [(3000, 1, []), (3010, 1, []), (3020, 2, [])]
    rows += [(4000, None, centres[0].tolist()), (4010, 1, None), (4020, 1, [math.nan] * 12), (4030, 1, [None] * 12), (4040, 1, [math.inf] * 12),
             (4050, 1, [1e200] * 12), (None, 1, centres[0].tolist()), (4060, 2, [0.0] * 12)]
    rows += [rows[20], rows[21]]  # repeated rows; 20 is an anchor
    return rows


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    good = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) > 1e5 for x in v):
            continue
        good.append((i, label, [math.floor(256 * x) for x in v]))
    found = Counter()
    for i, label, v in good:
        if not is_anchor(i):
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good if j != i and len(w) == len(v))
        for s, j, _ in [n for n in near if n[2] == label][:positives]:
            far = [n for n in near if n[2] != label and 30 * -s <= 100 * -n[0] <= 90 * -s][:negatives]
            found.update((i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(far, 1))
    return found


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many tiles, levels, blocks and groups
        for name, value in (("_TILE", 24), ("_LEAF", 4), ("_FANOUT", 2), ("_BLOCK", 8), ("_NODES", 4), ("_GROUP", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    frame = clashing(frame, "number", "v", "dim", "tile", "low", "n", "anchor")
    before = spark.conf.get(BATCH)
    found = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = Counter(map(tuple, found.select(*columns).collect()))
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(got) > 500
    assert spark.conf.get(BATCH) == before
    if not small:
        assert hard_negatives.hard_negatives(frame.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_negatives_search_prunes_and_keeps_ties():
    rnd = np.random.default_rng(8)
    rows = np.repeat(rnd.integers(-300, 300, (40, 3)), 20, axis=0).astype(np.int32)  # far apart groups of equal rows
    labels = rnd.integers(0, 2, len(rows))
    ids = rnd.permutation(len(rows))
    order = hard_negatives.str_order(rows)
    rows, labels, ids = rows[order], labels[order], ids[order]
    tree = hard_negatives.Tree(rows, labels)
    anchors = rows[::50]
    below, above = hard_negatives.intervals(anchors, tree.low, tree.high)
    scores = anchors.astype(np.int64) @ rows.T.astype(np.int64)
    for leaf in range(tree.first_leaf, len(tree.low)):
        at = (leaf - tree.first_leaf) * hard_negatives._LEAF
        inside = scores[:, at : at + hard_negatives._LEAF]
        assert (below[:, leaf] <= inside.min(axis=1)).all() and (inside.max(axis=1) <= above[:, leaf]).all()
    lows, highs = np.full((len(anchors), 1), 1000), np.full((len(anchors), 1), 60_000)
    a, _, r, s = hard_negatives.best_first(anchors, np.full(len(anchors), -1), labels[::50], lows, highs, rows, ids, labels, 7, False)
    for i in range(len(anchors)):
        fits = [(-x, ids[j]) for j, x in enumerate(scores[i]) if labels[j] != labels[::50][i] and 1000 <= x <= 60_000]
        assert sorted(fits)[:7] == [(-x, ids[j]) for x, j in zip(s[a == i], r[a == i])]


def test_large_components_are_exact():
    big = (1 << 26) - 2
    rows = np.array([[big, -big], [big, big - 1], [-big, big]], dtype=np.int32)
    _, _, r, s = hard_negatives.best_first(
        rows[:1], np.array([-1]), np.zeros(1, dtype=np.int64), np.array([[hard_negatives._NONE]]), np.array([[hard_negatives._TOP]]),
        rows, np.arange(3), np.zeros(3, dtype=np.int64), 3, True,
    )
    assert list(zip(r.tolist(), s.tolist())) == [(0, 2 * big * big), (1, big * big - big * (big - 1)), (2, -2 * big * big)]


def brute_runs(words, least=6):
    """All runs with at least four periods, from the definition."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            part = words[at : at + length]
            if length >= max(least, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rnd):
    n, kinds = rnd.randint(0, 70), rnd.choice([1, 2, 2, 3, 6])
    words = [b"w%d" % rnd.randrange(kinds) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):  # periodic stretches, also next to and within each other
        if n:
            a, p, length = rnd.randrange(n), rnd.randint(1, 9), rnd.randint(1, 40)
            for i in range(a + p, min(a + length, n)):
                words[i] = words[i - p]
    return words


def test_runs_against_brute_force():
    rnd = random.Random(6)
    number = 0
    for _ in range(3000):
        words = random_words(rnd)
        want = brute_runs(words)
        number += len(want)
        assert periodic_runs.find_runs(words) == want
        assert periodic_runs.runs_of([int(w[1:]) for w in words]) == want  # without the search for stretches
    assert number > 1500  # the fixture is full of runs


def test_runs_of_long_texts():
    rnd = random.Random(7)
    page = [b"a%d" % rnd.randrange(3000) for _ in range(9000)]
    words = [b"once", *page * 5, b"upon", *page[:100] * 4, *[b"x"] * 5000]
    assert periodic_runs.find_runs(words) == [(1, 45_000, 9000), (45_002, 400, 100), (45_402, 5000, 1)]


def test_periodic_runs(spark):
    rnd = random.Random(8)
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "é　ü " * 4, "x\x0by\x0cx y x\ry x y"]
    texts += [b" ".join(random_words(rnd)).decode() for _ in range(300)]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(7, texts[6]), (7, texts[6])]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "runs", "start", "r", "n_words")
    found = docs.select("doc_id", periodic_runs.periodic_runs(docs).alias("r")).collect()
    want = Counter()
    for i, t in rows:
        words = (t or "").encode().split()
        runs = brute_runs(words)
        out = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i, len(words), tuple(runs), b" ".join(w for k, w in enumerate(words) if k not in out).decode()] += 1
    got = Counter((r.doc_id, r.r.n_words, tuple((x.start, x.length, x.period) for x in r.r.runs), r.r.collapsed) for r in found)
    assert got == want
    none = docs.where("false")
    assert none.select(periodic_runs.periodic_runs(none)).count() == 0


def test_periodic_query(spark, tmp_path):
    """With the tails that the query makes, against plain Python."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 90))) + rnd.choice(["", " ", "\n"])) for i in range(300)]
    rows += [(300 + i, None) for i in range(20)] + [(None, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    tails = 0
    for i, text in rows:
        words = (text or "").encode().split()
        n = len(words)
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
                tails += 1
        runs = brute_runs(words)
        out = {k for s, length, q in runs for k in range(s + q, s + length)}
        r = found[i]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha256("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(b" ".join(w for k, w in enumerate(words) if k not in out)).hexdigest()
        if runs:
            best = min(runs, key=lambda x: (-(x[1] / x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None, None, None, None)
    assert tails > 15
