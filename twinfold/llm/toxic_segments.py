"""Toxicity by maximum-scoring segments.

Every token, a word or a word's stem, has a log-odds score, toxic against clean, from its counts in
labelled texts with a Dirichlet prior from both classes together; it is shrunk by its standard error, so
that chance counts score nothing. A word scores as its most telling form, lowered by a small drift, so that ordinary text scores negative. A linear
scan finds all maximal scoring segments of a text: the toxic passages. By extreme-value theory a
segment of score S in n tokens of clean text has ``K n exp(-lambda S)`` as its expected number; lambda is the root
of the scores' moment equation and K is fitted to the best segments of clean texts. A text's
features are its best and its summed calibrated segments; a logistic curve makes them a score.

Tokens are hashed into a table of fixed size. Learning uses at most ``sample`` labelled texts of either
class, chosen by a hash of the id; the table, the collected features and the broadcast are bounded by these parameters.

Edge cases: null and empty texts have no segment and get the score of such texts. Null labels teach nothing, a
text with different labels counts as toxic, and labels without a text are ignored. With no labels of
one class every score is the share of toxic labels. Whole texts are scanned. Input columns are kept as they
are; the result is one column of the caller's choice of name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import as_bytes, columns, share, shared, small_batches
from twinfold.session import materialize

SAMPLE = 4000  # labelled texts per class that are learned from
BITS = 20  # of a token's hash
STEMS = (4, 5, 6, 8)  # bytes of a word that are counted as its stems
PRIOR = 500.0  # tokens that the Dirichlet prior weighs
SHRINK = 2.0  # standard errors taken off a token's log-odds
DRIFT = 0.1
_KEEP = 400_000  # words whose scores a worker remembers
_STEP = 0.05  # of the histogram of scores
THRESHOLD = 0.3

_EDGES = b".,;:!?\"'()[]{}<>#*%$&|/\\-_~`=+"


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words without the punctuation around them."""
    return [w for w in (word.strip(_EDGES) for word in text.lower().split()) if w]


def forms(word: bytes) -> list[int]:
    """Hashes of the word and of its stems, its first few bytes."""
    stems = [crc32(word[:n], n) for n in STEMS if len(word) >= n]
    return [h & ((1 << BITS) - 1) for h in (crc32(word), *stems)]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, score)`` of a sequence, in linear time."""
    total = np.cumsum(scores)
    # Of each candidate: where it begins and ends, the sums before it and up to its end, and the
    # last candidate before it that begins lower.
    found: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        high = float(total[at])
        low, first = high - float(scores[at]), at
        while True:
            before = len(found) - 1
            while before >= 0 and found[before][2] >= low:
                before = found[before][4]
            if before < 0 or found[before][3] >= high:
                found.append((first, at + 1, low, high, before))
                break
            first, low = found[before][0], found[before][2]
            del found[before:]
    return [(first, end, high - low) for first, end, low, high, _ in found]


@dataclass
class Model:
    odds: np.ndarray  # shrunk, by hash of a form
    decay: float = 1.0  # lambda
    log_k: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))  # of the logistic curve: constant, features
    centre: np.ndarray = field(default_factory=lambda: np.zeros(2))
    spread: np.ndarray = field(default_factory=lambda: np.ones(2))
    known: dict[bytes, float] = field(default_factory=dict)

    def word_score(self, word: bytes) -> float:
        return float(max(self.odds[forms(word)], key=abs)) - DRIFT

    def scores(self, text: bytes) -> np.ndarray:
        known, words = self.known, tokens(text)
        found = list(map(known.get, words))
        if None in found:
            if len(known) > _KEEP:
                known.clear()
            for i, score in enumerate(found):
                if score is None:
                    word = words[i]
                    score = known.get(word)
                    found[i] = known[word] = self.word_score(word) if score is None else score
        return np.array(found, dtype=np.float64)

    def segments(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the toxic passages as word spans with their scores."""
        scores = self.scores(text)
        return len(scores), maximal_segments(scores)

    def best(self, text: bytes) -> tuple[int, float]:
        n, found = self.segments(text)
        return n, max((s for _, _, s in found), default=0.0)

    def features(self, text: bytes) -> tuple[float, float]:
        """The best calibrated segment, and the sum of those that beat chance."""
        n, found = self.segments(text)
        base = self.log_k + np.log(max(n, 1))
        lifted = self.decay * np.array([s for _, _, s in found]) - base
        if not len(lifted):
            return -base, 0.0
        return float(lifted.max()), float(np.log1p(np.maximum(lifted, 0).sum()))

    def score(self, texts: Iterable[bytes]) -> np.ndarray:
        rows = np.array([self.features(t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (rows - self.centre) / self.spread @ self.weights[1:], -30, 30)))


def shrunk_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds of every hash less some standard errors."""
    both = toxic + clean
    prior = PRIOR * (both + 1e-3) / (both.sum() + 1e-3 * len(both))
    n_toxic, n_clean = toxic.sum() + PRIOR, clean.sum() + PRIOR
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n_toxic - a)) - np.log(b / (n_clean - b))
    error = np.sqrt(1 / a + 1 / b)
    return np.sign(odds) * np.maximum(np.abs(odds) - SHRINK * error, 0)


def decay_of(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of ``sum p exp(x s) = 1``; 1 where there is none."""
    used = weights > 0
    s, p = scores[used], weights[used] / max(weights.sum(), 1)
    if not len(s) or s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    moment = lambda x: float((p * np.exp(np.clip(x * s, -700, 700))).sum())
    while moment(high) < 1 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return (low + high) / 2


def logistic(rows: np.ndarray, labels: np.ndarray, case: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    x = np.c_[np.ones(len(rows)), rows]
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (case * (labels - p)) - 1e-3 * weights
        bend = (x * (case * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from ``doc_id``, ``text`` and the ``toxic`` labels of at most ``sample`` texts of either class.

    Labels of other ids than those of ``docs`` count for nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).join(docs.select("doc_id"), "doc_id", "left_semi")
    marked = materialize(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    kinds = marked.groupBy("toxic").agg(F.count("*").alias("n"))
    total = {row["toxic"]: row["n"] for row in kinds.collect()}
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = marked.join(F.broadcast(kinds), "toxic").where(spread * F.col("n") < sample).select("doc_id", "toxic")
    # ``few`` has about 2 * sample ids, whatever the number of labels.
    chosen = materialize(
        docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    )

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << BITS), dtype=np.int64)
        for frame in frames:
            for kind in (0, 1):
                words = Counter(w for t in as_bytes(frame["text"][frame["toxic"] == kind]) for w in tokens(t))
                for word, n in words.items():
                    sums[kind, forms(word)] += n
        used = np.flatnonzero(sums.sum(axis=0))
        yield pd.DataFrame({"h": used, "clean": sums[0, used], "toxic": sums[1, used]})

    counts = chosen.coalesce(16).mapInPandas(count, "h long, clean long, toxic long")
    summed = columns(counts.groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    clean, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    clean[summed["h"]], toxic[summed["h"]] = summed["clean"], summed["toxic"]
    model = Model(shrunk_odds(toxic, clean).astype(np.float32))

    def histogram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = np.concatenate([np.zeros(0), *map(model.scores, as_bytes(frame["text"]))])
            step, n = np.unique(np.rint(scores / _STEP).astype(np.int64), return_counts=True)
            yield pd.DataFrame({"step": step, "n": n})

    usual = chosen.where("toxic = 0").mapInPandas(histogram, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toPandas()
    model.decay = decay_of(usual["step"].to_numpy() * _STEP, usual["n"].to_numpy())

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [model.best(t) for t in as_bytes(frame["text"])]
            yield pd.DataFrame({"n": [r[0] for r in rows], "s": [r[1] for r in rows]})

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [model.features(t) for t in as_bytes(frame["text"])]
            yield pd.DataFrame({"a": [r[0] for r in rows], "b": [r[1] for r in rows], "toxic": frame["toxic"]})

    null = chosen.where("toxic = 0").mapInPandas(best, "n long, s double").toPandas()
    null = null[null["n"] > 0]
    if len(null):
        # The mean of a Gumbel distribution lies Euler's constant above its mode.
        model.log_k = float((model.decay * null["s"] - np.log(null["n"])).mean() - 0.5772)
    rows = chosen.mapInPandas(features, "a double, b double, toxic int").toPandas()
    share = total.get(1, 0) / max(sum(total.values()), 1)
    if rows["toxic"].nunique() < 2:
        model.weights[0] = np.log((share + 1e-6) / (1 - share + 1e-6))
        return model
    x, y = rows[["a", "b"]].to_numpy(), rows["toxic"].to_numpy()
    model.centre, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    # The sample has other shares of the classes than the labels; weights make up for it.
    case = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    model.weights = logistic((x - model.centre) / model.spread, y, case)
    return model


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of a text column; per row, without a shuffle."""
    small_batches(docs.sparkSession)
    sent = share(docs.sparkSession, model)

    @F.pandas_udf("double")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared(sent)
        for texts in batches:
            yield pd.Series(known.score(as_bytes(texts)))

    return value(F.col(f"`{text}`"))
