"""Hashes made side by side, and minima from small hashes only."""

from __future__ import annotations

import random
from hashlib import md5

import numpy as np
import pandas as pd

from tests import brute
from twinfold.functions import fingerprints as fp


def test_md5_of_many_pieces_at_once(monkeypatch):
    rnd = random.Random(3)
    pieces = [bytes(rnd.randrange(256) for _ in range(n)) for n in [*range(56), *range(56), 0, 5, 5]]
    sizes = np.array([len(p) for p in pieces])
    for lanes in (7, 10_000):
        monkeypatch.setattr(fp, "_LANES", lanes)
        found = fp._md5_words(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
        assert [w.astype("<u4").tobytes() for w in found.T] == [md5(p).digest() for p in pieces]


def test_tokens_of_any_length(monkeypatch):
    texts = ["", "a", "x" * 55 + " " + "y" * 56, "\U0001f600" * 14 + " 　é\x1fab", "w " * 40 + "é" * 100, "a b b b"]
    for held in (3, 50_000):
        monkeypatch.setattr(fp, "_TOKENS", held)
        found = fp.simhash_values(pd.Series([*texts, None]))
        assert [value & (1 << 64) - 1 for value in found] == [brute.simhash(t) for t in [*texts, ""]]


def test_scaled_values_tell_neighbours_apart():
    """The upper halves are in the order of the values modulo the prime, to its very ends."""
    draw = np.random.default_rng(1)
    a, b = fp.coefficients(120)
    ends = np.array([0, 1, 2, fp.PRIME - 1, fp.PRIME - 2, fp.PRIME // 2], dtype=np.uint64)
    hashes = np.r_[ends, draw.integers(0, fp.PRIME, 3000, dtype=np.uint64)]
    a, b = np.r_[a, ends[1:], ends[1:]], np.r_[b, ends[:-1], ends[1:]]
    want = [[(int(h) * int(x) + int(y)) % fp.PRIME for x, y in zip(a, b)] for h in hashes]
    assert fp.permuted(hashes, a, b).tolist() == want


def test_large_texts_look_at_small_hashes_only(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abcdefgh ", k=n)) for n in (6000, 1500, 40, 0, 900)]
    a, b = fp.coefficients(120)
    asked, scaled = [], fp._scaled
    monkeypatch.setattr(fp, "_scaled", lambda hashes, *rest: asked.append(len(hashes)) or scaled(hashes, *rest))
    want = [brute.minhash(text) for text in texts]
    for limit in (8, 0, 1):  # with none or one expected below the limit, nearly every text has to look at all
        monkeypatch.setattr(fp, "_SMALLEST", limit)
        asked.clear()
        assert [v.tolist() if n else [] for n, v in fp.minhashes(pd.Series(texts), 5, a, b, {})] == want
        assert (sum(asked) < 2000) == (limit == 8)
