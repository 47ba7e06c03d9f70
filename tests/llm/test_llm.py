"""The training-data operators against brute force, the tokenizers library and exact round trips."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from twinfold.llm import (
    chat_format, context_mixing, grouping_packer, int8_dedup, one_bit_search, ppm_language, simhash_blocks, simple8b,
    toxic_segments, trie_bpe,
)
from twinfold.llm.common import fold
from twinfold.llm.queries import BYTE_BPE, WORD_BPE

ODD = [
    None, "", " \n\t", "a", "Hello wörld's  <|endoftext|>x <|ENDOFTEXT|>", "你好 İ ΣΑΣ é\x1c b\x85c \xa0 d", "  two  spaces \n x ",
    "!\x1c b", "“quotes” — and　wide", "x" * 3000, "12ab 3½²",
]
WORDS = {
    "en": "the of and to in that is for thing with on was be as".split(),
    "de": "der die und das ist nicht ein mit von auf für keit".split(),
}


def prose(seed: int, language: str = "en", n: int = 60) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices(WORDS[language], k=rnd.randint(1, 2))) for _ in range(n))


def documents():
    rows = [(i, prose(i, "en" if i % 3 else "de"), "en" if i % 3 else "de") for i in range(60)]
    rows += [(100 + i, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    rows += [(5, rows[5][1], "en"), (None, rows[6][1], "en"), (7, prose(900), "en")]  # repeated ids, a null id
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(documents(), "doc_id long, text string, lang string").repartition(3)
    # Columns that clash with the names the operators use.
    return frame.select("*", *[F.lit("z").alias(c) for c in ("fp", "score", "ids", "row", "length", "_item")])


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("false")


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, links):
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(a) for a in range(n)]


def test_simhash(docs, no_docs):
    found = simhash_blocks.near_duplicates(docs).collect()
    rows = documents()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = components(len(rows), links)
    first = {}
    for (i, _, _), g in zip(rows, group):
        if i is not None:
            first[g] = min(i, first.get(g, i))
    want = Counter((i, f"{p:016x}", first[g]) for (i, _, _), p, g in zip(rows, prints, group))
    assert Counter(map(tuple, found)) == want
    assert simhash_blocks.near_duplicates(no_docs).count() == 0
    kept = simhash_blocks.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_simhash_hot_keys(spark):
    """Chunks of a key: many fingerprints near each other, and chains, against brute force."""
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    prints = {base}
    while len(prints) < 400:
        prints.add(rnd.choice(list(prints)[:40]) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    prints = sorted(prints) + [rnd.getrandbits(64) for _ in range(100)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash_blocks.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), chunk=32).collect()
    place = {s: i for i, s in enumerate(signed)}
    assert all((prints[place[r.u]] ^ prints[place[r.v]]).bit_count() <= 4 * 400 for r in links)
    all_links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert components(len(prints), [(place[r.u], place[r.v]) for r in links]) == components(len(prints), all_links)


def test_trie_bpe(docs, no_docs):
    path = public_tokenizers.path(WORD_BPE)
    library = Tokenizer.from_file(path)
    want = Counter()
    for doc_id, text, _ in documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter(map(tuple, trie_bpe.round_trip(docs, path).collect())) == want
    digests = {(d, n, sha256(i.encode()).hexdigest(), sha256(t.encode()).hexdigest()) for d, n, i, t in want}
    assert set(map(tuple, trie_bpe.round_trip_digests(docs, path).collect())) == digests
    assert trie_bpe.round_trip(no_docs, path).count() == 0


def test_simple8b_round_trip():
    rnd = np.random.default_rng(1)
    cases = [
        np.zeros(1000), rnd.integers(0, 49408, 5000), rnd.integers(0, 2**63, 700).astype(np.uint64) * np.uint64(2), np.zeros(0),
        np.r_[np.zeros(500), rnd.integers(0, 3, 700), rnd.integers(0, 2**20, 300)], np.array([7]), np.array([2**60, 1, 2**64 - 1], dtype=np.uint64),
    ]
    for case in cases:
        case = case.astype(np.uint64)
        assert (simple8b.unpack(*simple8b.pack(case), len(case)) == case).all()


def test_token_files(spark, docs, no_docs):
    path = public_tokenizers.path(WORD_BPE)
    library = Tokenizer.from_file(path)
    found = simple8b.read_ids(spark, simple8b.write_ids(docs, path, 2)).collect()
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found)
    want = Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 2)) for i, t, _ in documents())
    assert got == want
    total = 0
    for row in sorted(found, key=lambda r: r.start):
        assert row.start == total
        total += row.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert simple8b.read_ids(spark, simple8b.write_ids(no_docs, path, 2), digest=True).count() == 0


def test_packing(docs, no_docs):
    path = public_tokenizers.path(BYTE_BPE)
    library = Tokenizer.from_file(path)
    found = grouping_packer.pack_documents(docs, path, 2, 64).collect()
    want = Counter()
    for doc_id, text, _ in documents():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        for k, start in enumerate([0, *range(first, len(ids), 64)]):
            piece = ids[start : first if not k else start + 64]
            want[doc_id, k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    lengths = sorted((r.length for r in found), reverse=True)
    assert len(sequences) <= len(grouping_packer.best_fit_all(lengths, range(len(lengths)), 64).items)
    assert grouping_packer.pack_documents(no_docs, path, 2, 64).count() == 0


def test_genetic_steps_keep_every_piece():
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(30, 70, 400).tolist()
    best = grouping_packer.evolve(lengths, [], 100, 1)
    bins = grouping_packer.from_genome(best, lengths, 100)
    assert sorted(i for items in bins.items for i in items) == list(range(400)) and min(bins.room) >= 0
    plain = grouping_packer.best_fit_all(lengths, sorted(range(400), key=lengths.__getitem__, reverse=True), 100)
    assert len(bins.items) <= len(plain.items)


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\INST]", "\\", "", None, "plain é 你", "[/INST]" * 3, "<<s>>"]
    rows = [(c, t, ["user", "assistant", None, "a</s>"][(c + t) % 4], texts[(c * 3 + t) % len(texts)], "x") for c in range(40) for t in range(c % 30)]
    rows += [(None, 0, "assistant", "nobody", "x"), (3, 0, "assistant", "twice", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    formatted = chat_format.format_conversations(turns)
    whole, masked = {}, {}
    for r in sorted(formatted.collect(), key=lambda r: r.part):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.formatted
        masked.setdefault(r.conv_id, []).extend(r.formatted[s.start : s.start + s.length] for s in r.loss)
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1], r[2] or "", r[2] is not None, r[3] or "") for r in rows if r[0] == conv)
        assert [(r, t) for r, t in chat_format.parse(whole[conv])] == [(r, t) for _, r, _, t in mine]
        said = "".join(t for _, r, _, t in mine if r == "assistant")
        got = back[conv]
        assert (got.n_turns, got.loss_chars, got.formatted_chars) == (len(mine), len(said), len(whole[conv]))
        assert got.loss_sha256 == sha256(said.encode()).hexdigest()
        assert got.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for _, r, _, t in mine).encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_conversations(turns.where("false"))).count() == 0


def vectors():
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((300, 16))
    x[100:160] = x[0] + rnd.standard_normal((60, 16)) * 0.3
    x[200:210] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(400, None), (401, [0.0] * 16), (402, [math.nan] * 16), (403, [None] * 16), (404, []), (405, x[3].tolist()), (406, [1e200] * 16)]


def test_embedding_dedup(spark):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    found = {r.vec_id: r for r in int8_dedup.near_duplicates(frame).collect()}
    good = [(i, np.array(v)) for i, v in vectors() if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.abs(v).max() for _, v in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    group = components(len(good), [(i, j) for i, j in zip(*np.nonzero(near)) if i > j])
    assert len(found) == len(vectors())
    for k, (i, _) in enumerate(good):
        assert (found[i].n_links, found[i].component_id) == (near[k].sum() - 1, good[group[k]][0])
    for i in (400, 401, 402, 403, 404):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert int8_dedup.near_duplicates(frame.where("false")).count() == 0


def test_search(spark):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    found = {}
    for r in one_bit_search.search(frame, F.col("vec_id") % 10 == 0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    good = {i: np.array(v) / np.abs(v).max() for i, v in vectors() if v and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in (i for i in good if i % 10 == 0):
        score = {i: round(float(good[q] @ v / math.sqrt(good[q] @ good[q] * (v @ v))), 12) for i, v in good.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        hits += len(set(best) & set(found[q].values()))
        total += 5
    assert hits / total >= 0.99
    assert one_bit_search.search(frame.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def brute_code_length(samples: list[bytes], text: bytes) -> float:
    counts: dict[bytes, Counter] = {}
    for s in samples:
        s = b"    " + s
        for at in range(4, len(s)):
            for order in range(5):
                counts.setdefault(s[at - order : at], Counter())[s[at]] += 1
    bits, text = 0.0, b"    " + text
    for at in range(4, len(text)):
        for order in range(4, -1, -1):
            seen = counts.get(text[at - order : at])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if text[at] in seen:
                bits -= math.log2(seen[text[at]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_language(docs, no_docs):
    samples = {"de": [prose(i, "de").encode() for i in range(3)], "en": [prose(i).encode() for i in range(3)]}
    trees = ppm_language.Trees(samples)
    texts = [prose(50, "de").encode(), b"xq zz\xc3\xa9", b"", prose(51).encode()]
    want = [[brute_code_length(samples[x], t) for x in ("de", "en")] for t in texts]
    assert np.allclose(trees.totals(texts), want, rtol=1e-5, atol=1e-4)
    learned = ppm_language.learn(docs)
    rows = docs.select("doc_id", "text", "lang", ppm_language.language(docs, learned).alias("p")).collect()
    assert all(r.p.lang_pred == r.lang for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert all(r.p.lang_pred == "und" and r.p.score == 0 for r in rows if not any(c.isalpha() for c in r.text or ""))
    nothing = ppm_language.learn(no_docs)
    assert {r.p.lang_pred for r in docs.select(ppm_language.language(docs, nothing).alias("p")).collect()} == {"und"}


def test_segments_against_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        scores = np.array([rnd.choice([-2, -1, 1, 2, 3]) for _ in range(rnd.randint(0, 14))], dtype=float)

        def best(low, high):
            """The highest segment of a range, then the same left and right of it."""
            spans = [(scores[a:b].sum(), -(b - a), -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
            spans = [s for s in spans if s[0] > 0]
            if not spans:
                return []
            top = max(s[0] for s in spans)
            ties = [(a, b) for s, _, _, a, b in spans if s == top]
            # Of equal ones a segment holds no other: what is left out adds nothing.
            a, b = next((a, b) for a, b in ties if not any((c, d) != (a, b) and a <= c and d <= b for c, d in ties))
            return [*best(low, a), (a, b, top), *best(b, high)]

        got = toxic_segments.maximal_segments(scores)
        assert got == best(0, len(scores))


def test_toxicity(spark):
    bad = "vilewort scumling".split()
    rows, labels = [], []
    for i in range(240):
        words = prose(i, n=40).split()
        if i % 4 == 0:
            for k in range(4):
                words[k * 5 + 3] = bad[k % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(500 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxic_segments.learn(docs.where(~fold(F.col("doc_id"), 4, 2)), marks)
    found = {r.doc_id: r.s for r in docs.select("doc_id", toxic_segments.toxicity(docs, model).alias("s")).collect()}
    assert all((found[i] >= 0.3) == (i % 4 == 0) for i in range(240))
    assert all(0 <= s < 0.3 for i, s in found.items() if i >= 500)
    empty = toxic_segments.learn(docs, marks.where("false"))
    assert docs.where("false").select(toxic_segments.toxicity(docs, empty)).count() == 0


def test_context_mixing(docs, no_docs):
    rows = documents()
    tokens = [((t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t, _ in rows]
    counts = Counter(w for words, out in tokens if not out for w in words)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for (i, _, _), (words, out) in zip(rows, tokens):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[i, out, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)] += 1
    found = context_mixing.score(docs, fold(F.col("doc_id"), 5, 1)).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == want
    assert all(r.score < 0 for r in found)
    assert context_mixing.score(no_docs, fold(F.col("doc_id"), 5, 1)).count() == 0


def test_context_mixing_learns_context(spark):
    """Texts in two languages: single words do not tell them apart, contexts do."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(WORDS["en" if i % 2 else "de"], k=60))) for i in range(400)]
    found = context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string"), fold(F.col("doc_id"), 5, 1)).collect()
    out = [r for r in found if r.held_out]
    gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    assert gain > 0.2  # of at most log10(2) for the language


def test_context_mixing_and_new_words(spark):
    """New words are one symbol of the base; the score is a mixture with it, so never far below, however they are spelled."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(WORDS["en"], k=40))) for i in range(60)]
    out = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1]
    odd = ["q" * 3000, "zzxq", " ".join(f"n{i}xyzzy{i}" for i in range(200)), "of zzxq the", "", None, "日本語" * 500]
    rows += list(zip(out, odd))
    found = context_mixing.score(spark.createDataFrame(rows, "doc_id long, text string"), fold(F.col("doc_id"), 5, 1)).collect()
    assert len(found) == len(rows)
    assert all(math.isfinite(r.score) and r.base_score - math.log10(2) - 1e-9 <= r.score < 0 for r in found)
    # Letters are paid for in the other score.
    spelled = {r.doc_id: r.spelled_score for r in found}
    assert spelled[out[0]] < spelled[out[1]] < 0
    assert all(r.bits_per_byte == pytest.approx(-r.spelled_score * math.log2(10) / len((dict(rows)[r.doc_id] or "").encode())) for r in found if dict(rows)[r.doc_id])


def test_word_classes_count_every_text(spark):
    rows = documents()
    frame = spark.createDataFrame([(i, t or "") for i, t, _ in rows], "doc_id long, text string").repartition(3)
    texts = [(t or "").encode().lower().split() for _, t, _ in rows]
    words = [w for w, _ in Counter(w for t in texts for w in t).most_common(90)]
    want = np.zeros((len(words), context_mixing.MARKERS + 1))
    for text in texts:
        last = context_mixing.MARKERS
        for word in text:
            if word in words:
                want[words.index(word), last] += 1
                last = words.index(word) if words.index(word) < context_mixing.MARKERS else last
    assert (context_mixing.marker_counts(frame, words) == want).all()


def test_first_weights_use_every_text(spark, monkeypatch):
    """With weights held, the parts add up to the sums over the whole corpus."""
    rows = [(i, (t or "").lower()) for i, t, _ in documents()]
    texts = [t.encode() for _, t in rows]
    words = [w.encode() for w in (*WORDS["en"], *WORDS["de"])]
    code = context_mixing.Code(words, list(range(len(words), 0, -1)), 2, 8)
    tables = {k: np.zeros((1 << (context_mixing.SLOT_BITS if k < 2 else context_mixing.SPELL_BITS), 2), dtype=np.float32) for k in range(6)}
    model = context_mixing.Model(code, tables)
    got: dict[int, list] = {}

    def step(self, sums):
        got.setdefault(id(self), []).append(sums.copy())
        return self.now.astype(np.float32)

    monkeypatch.setattr(context_mixing.Newton, "step", step)
    train = spark.createDataFrame(rows, "doc_id long, text string")
    context_mixing.fit(model, train, context_mixing.count_words(train))
    want = [*model.path_sums(texts), model.letter_sums(sorted({w for t in texts for w in t.split()} - set(words)))]
    for own, whole in zip(got.values(), want, strict=True):
        assert len(own) == context_mixing.PARTS
        assert sum(own) == pytest.approx(whole, rel=1e-4, abs=1e-3)


def test_code_is_complete():
    """The probabilities of all code paths of a token add up to one."""
    words = [b"a", b"b", b"c"]
    code = context_mixing.Code(words, [5, 3, 1], 2, 1)
    tables = {k: np.zeros((1 << (context_mixing.SLOT_BITS if k < 2 else context_mixing.SPELL_BITS), 2), dtype=np.float32) for k in range(6)}
    model = context_mixing.Model(code, tables)
    costs = [model.path_costs(context_mixing.Tokens(code, [b"a " + w]))[1] for w in (*words, b"rare", b"")]
    assert sum(math.exp(-c) for c in costs) == pytest.approx(1, abs=1e-5)
    # With an expected word, which may be coded either way.
    costs = [model.path_costs(context_mixing.Tokens(code, [b"a b a " + w]))[3] for w in (*words, b"rare", b"")]
    assert sum(math.exp(-c) for c in costs) == pytest.approx(1, abs=1e-5)


def brute_path_costs(model, text):
    """Nats of each token of one text, a decision at a time."""
    code, words = model.code, [*text.lower().split(), b""]
    found = context_mixing.Tokens(code, [text])
    weights, steps, costs = model.weights.astype(float), np.zeros(model.weights.shape), []
    for t, word in enumerate(words):
        symbol = code.words.get(word, code.escape)
        expected = max((j for j in range(1, t) if words[j - 1] == words[t - 1]), default=None) if t else None
        decisions = context_mixing.Decisions(code, found, np.array([t]))
        assert (decisions.gate[0] > 3) == (expected is not None)
        nats = []
        for x, gate, bit in zip(model.inputs(decisions).astype(float), decisions.gate, decisions.bit):
            p = 1 / (1 + math.exp(-sum(x * weights[gate])))
            nats.append(-math.log(p if bit else 1 - p))
            steps[gate] += context_mixing.RATE * (bit - p) * x
        cost = sum(nats) + code.tail[symbol]
        if expected is not None and words[expected] == word:
            h = math.exp(-nats[0])
            cost = nats[0] if symbol == code.escape else -math.log(h + (1 - h) * math.exp(nats[0] - cost))
        costs.append(cost)
        if (t + 1) % context_mixing.BLOCK == 0:
            weights, steps = weights + steps, np.zeros(steps.shape)
    return costs


def test_path_costs_against_single_decisions():
    """Texts of several lengths side by side, one longer than many blocks, an empty one."""
    rnd = random.Random(3)
    words = [b"a", b"b", b"c", b"dd"]
    code = context_mixing.Code(words, [50, 30, 10, 9], 2, 8, [0, 1, 0, 1])
    draw = np.random.default_rng(3)
    tables = {k: draw.random((1 << (context_mixing.SLOT_BITS if k < 2 else context_mixing.SPELL_BITS), 2)).astype(np.float32) * 9 for k in range(6)}
    model = context_mixing.Model(code, tables)
    texts = [b" ".join(rnd.choices([*words, b"new", b"odd"], k=k)) for k in (3, 0, 400, 40, 16)]
    got = model.path_costs(context_mixing.Tokens(code, texts))
    want = [c for t in texts for c in brute_path_costs(model, t)]
    assert got == pytest.approx(want, abs=1e-3)


def test_pipeline(spark, tmp_path):
    rows = [(i, prose(i, "en" if i % 3 else "de", 80), "en" if i % 3 else "de", "s", 1) for i in range(120)]
    rows += [(200, rows[4][1], "en", "s", 1), (201, "12 34", "en", "s", 1), (202, None, "en", "s", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in names.split(", ")], name
    assert {r.doc_id for r in docs.collect()} == set(range(120))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(120))


def test_keep_one_of_equal_ids_and_rows(spark):
    """Near copies at several distances, repeated ids, rows equal in all cells, null cells, against brute force."""
    rnd = random.Random(11)
    rows = []
    for number in range(30):
        base = prose(5000 + number, n=400).split()
        for changes in (0, 0, 1, 2, 5, 20, 80):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), changes):
                copy[at] = f"w{rnd.randrange(10**9)}"
            rows.append((rnd.randrange(150), " ".join(copy), rnd.choice(["a", "b", None])))
    rows += [(None, rows[3][1], "a"), (None, "alone here", None), (None, "alone here", None), (7, None, "x"), (7, "x", None), (8, " ", "y")]
    rows += [rows[0], rows[0], rows[-2]]
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = components(len(rows), links)
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    kept = simhash_blocks.keep_one(frame).collect()
    of_print = dict(zip(prints, group))
    got = {of_print[brute_fingerprint(r.text)]: r for r in kept}
    assert len(got) == len(kept) == len(set(group))
    smallest = {}
    for (i, _, _), g in zip(rows, group):
        smallest[g] = min((i is None, i or 0), smallest.get(g, (True, 0)))
    assert {g: (r.doc_id is None, r.doc_id or 0) for g, r in got.items()} == smallest
    assert set(map(tuple, kept)) <= set(rows)


def test_arrow_setting_comes_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    int8_dedup.near_duplicates(frame)
    one_bit_search.search(frame, F.col("vec_id") % 10 == 0)
    assert spark.conf.get(key) == before


def test_toxicity_ignores_other_labels(spark):
    """Labels of held-out or missing texts change nothing."""
    rows = [(i, prose(i) + (" awful" * 3 if i % 4 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = [(i, int(i % 4 == 0)) for i in range(80)]
    other = [(1000 + i, 1) for i in range(300)]

    def scores(labels):
        marks = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = toxic_segments.learn(docs, marks)
        return {r.doc_id: r.s for r in docs.select("doc_id", toxic_segments.toxicity(docs, model).alias("s")).collect()}

    assert scores(own + other) == pytest.approx(scores(own), abs=1e-9)


def test_exploded_blocks_are_not_sent_through_the_driver(spark, tmp_path):
    # The planner sees some kilobytes of stored fingerprints, 35 rows each.
    spark.range(2_000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "prints"))
    plan = simhash_blocks.near_links(spark.read.parquet(str(tmp_path / "prints")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tiles_are_not_shuffled_to_their_units(spark, monkeypatch):
    plans = []
    store = int8_dedup.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(int8_dedup, "materialize", noted)
    monkeypatch.setattr(int8_dedup, "_TILE", 4)
    rnd = np.random.default_rng(3)
    rows = np.repeat(rnd.normal(size=(10, 8)), 3, axis=0) + rnd.normal(scale=0.05, size=(30, 8))
    found = int8_dedup.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>"))
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert [r.n_links for r in found.orderBy("vec_id").collect()] == links.tolist()
    compared = next(p for p in plans if "MapInArrow" in p)
    assert "CartesianProduct" in compared and "Exchange" not in compared
