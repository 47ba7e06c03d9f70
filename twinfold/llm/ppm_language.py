"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts. A byte is predicted by the longest
context that the tree holds; a byte that was never seen there costs an escape (method C: as
often as the context has different bytes) and is looked for in the next shorter context, at
last among 256 equal bytes. Statistics are frozen after learning, so a text's code length under
every language is exact and no row depends on another. The language with the shortest code
wins, and its share of the probability is the score.

For scoring, the trees of all languages are laid out as one hash table per order: byte string
-> code length in every language, escapes included.

Learning uses at most ``sample`` different texts of a language (texts of up to ``longest`` characters, chosen by
a hash of the text), so the model's size is bounded by these parameters and the number of languages.

Edge cases: a null text or one without letters is ``und`` with score 0, and so is every text when nothing
can be learned. A null language teaches nothing. Of equally good languages the first in
alphabetical order wins. Whole texts are scored, however long, in pieces that carry their context
over. Input columns are kept as they are; the result is one struct column of the caller's choice of name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import as_bytes, share, shared, small_batches

ORDER = 4
SAMPLE = 300  # texts per language that the trees are built from
LONGEST = 50_000  # characters of a text that may be learned from
UNKNOWN = "und"

_CELLS = 4_000_000  # code lengths held at a time
_EMPTY = np.uint64(2**64 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _windows(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The byte at each position and the ``order`` bytes before it, as one number."""
    keys = data[at].astype(np.uint64)
    for back in range(1, order + 1):
        keys |= data[at - back].astype(np.uint64) << np.uint64(8 * back)
    return keys


def _drop_oldest(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * order)) - 1)


class HashTable:
    """Positions of 64-bit keys by open addressing, in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(int(len(keys) * 2).bit_length(), 4)
        self.keys = np.full(1 << self.bits, _EMPTY, dtype=np.uint64)
        self.rows = np.zeros(1 << self.bits, dtype=np.int32)
        left, slots = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slots] == _EMPTY
            self.keys[slots[free]] = keys[left[free]]
            self.rows[slots[free]] = left[free]
            lost = self.keys[slots] != keys[left]
            left, slots = left[lost], (slots[lost] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for keys that are not there."""
        slots = self._slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.rows[slots], -1)
        open_ = np.flatnonzero((held != keys) & (held != _EMPTY))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.rows[slots[open_[same]]]
            open_ = open_[~same & (held != _EMPTY)]
        return out


def _padded(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ``ORDER`` spaces before each, and the positions of their own bytes."""
    texts = list(texts)
    data = np.frombuffer(b"".join(b" " * ORDER + t for t in texts), dtype=np.uint8)
    own = np.ones(len(data), dtype=bool)
    lengths = np.array([len(t) + ORDER for t in texts], dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    for k in range(ORDER):
        own[begin + k] = False
    return data, np.flatnonzero(own)


class Trees:
    """The context trees of all languages with exact code lengths in bits."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        n = len(self.languages)
        counted = []  # per language and order: keys, bits, contexts, escape bits
        for language in self.languages:
            data, at = _padded(samples[language])
            orders = []
            for order in range(ORDER + 1):
                keys, counts = np.unique(_windows(data, at, order), return_counts=True)
                contexts, first, kinds = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
                totals = np.add.reduceat(counts, first) + kinds
                bits = np.log2(np.repeat(totals, kinds) / counts)
                orders.append((keys, bits, contexts, np.log2(totals / kinds)))
            counted.append(orders)
        self.tables: list[tuple[HashTable, np.ndarray, HashTable, np.ndarray]] = []
        for order in range(ORDER + 1 if n else 0):
            keys = np.unique(np.concatenate([c[order][0] for c in counted]))
            contexts = np.unique(np.concatenate([c[order][2] for c in counted]))
            escapes = np.zeros((len(contexts), n), dtype=np.float32)
            for i, c in enumerate(counted):
                escapes[np.searchsorted(contexts, c[order][2]), i] = c[order][3]
            shorter = self.tables[-1][1][self.tables[-1][0].find(_drop_oldest(keys, order))] if order else np.float32(8)
            bits = escapes[np.searchsorted(contexts, keys >> np.uint64(8))] + shorter
            for i, c in enumerate(counted):
                bits[np.searchsorted(keys, c[order][0]), i] = c[order][1]
            self.tables.append((HashTable(keys), bits.astype(np.float32), HashTable(contexts), escapes))

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of the byte at each position, in every language."""
        out = np.zeros((len(at), len(self.languages)), dtype=np.float32)
        left, keys = np.arange(len(at)), _windows(data, at, ORDER)
        for order in range(ORDER, -1, -1):
            table, bits, contexts, escapes = self.tables[order]
            row = table.find(keys)
            met = row >= 0
            out[left[met]] += bits[row[met]]
            left, keys = left[~met], keys[~met]
            context = contexts.find(keys >> np.uint64(8))
            held = context >= 0
            out[left[held]] += escapes[context[held]]
            keys = _drop_oldest(keys, order)
        out[left] += 8
        return out

    def totals(self, texts: Iterable[bytes]) -> np.ndarray:
        """Bits of each text in every language."""
        limit = max(_CELLS // max(len(self.languages), 1), 1000)
        found: list[np.ndarray] = []
        pieces: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if pieces:
                data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
                lengths = np.array([len(p) for p in pieces])
                own = np.ones(len(data), dtype=bool)
                begin = np.cumsum(lengths) - lengths
                for k in range(ORDER):
                    own[begin + k] = False
                bits = self.code_lengths(data, np.flatnonzero(own)).astype(np.float64)
                own_begin = begin - ORDER * np.arange(len(pieces))
                for owner, total in zip(owners, np.add.reduceat(bits, own_begin, axis=0)):
                    found[owner] += total
            pieces.clear()
            owners.clear()
            held = 0

        for text in texts:
            found.append(np.zeros(len(self.languages)))
            text = b" " * ORDER + text.lower()
            for at in range(ORDER, len(text), limit):
                pieces.append(text[at - ORDER : at + limit])
                owners.append(len(found) - 1)
                held += len(pieces[-1])
                if held >= limit:
                    flush()
        flush()
        return np.array(found).reshape(-1, len(self.languages))


def learn(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Trees:
    """Trees from ``text`` and ``lang`` of at most ``sample`` texts per language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest)).select(
        "lang", "text", F.xxhash64("text").alias("h")
    )
    spread = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    # A few more than wanted are let through; the best ranked ones are taken.
    few = rows.join(F.broadcast(kinds), "lang").where(spread * F.col("n") < 1.3 * sample + 20).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "text").collect()
    samples: dict[str, list[bytes]] = {}
    for row in chosen:
        if row["text"]:
            samples.setdefault(row["lang"], []).append(row["text"].encode().lower())
    return Trees({language: sorted(texts) for language, texts in samples.items()})


def language(docs: DataFrame, trees: Trees, text: str = "text") -> Column:
    """struct(lang_pred, score) of a text column; per row, without a shuffle."""
    small_batches(docs.sparkSession)
    sent = share(docs.sparkSession, trees)

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = shared(sent)
        for texts, letters in batches:
            if not model.languages:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
                continue
            bits = model.totals(as_bytes(texts))
            winner = bits.argmin(axis=1)
            odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
            names = np.array(model.languages, dtype=object)[winner]
            known = letters.to_numpy(dtype=bool)
            yield pd.DataFrame({"lang_pred": np.where(known, names, UNKNOWN), "score": np.where(known, 1 / odds.sum(axis=1), 0.0)})

    return best(F.col(f"`{text}`"), F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
