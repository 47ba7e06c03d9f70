"""Token counts of whole texts by a two-tier lookup in the task that reads the text.

A text is cut into pre-tokens wherever no piece of the vocabulary holds the two characters
side by side: merges never cross such a place, so the counts of the pre-tokens add up to the count of the text. The
first tier is a table that tasks are sent: an open-addressing hash table in three flat arrays with the token
counts of the pre-tokens that are frequent in a sample of the texts. Its keys are the bytes of the
pre-tokens themselves, 15 at most, so a hit is exact. All pre-tokens of a block of texts are
looked up at once in numpy. The second tier is a bounded cache of the worker, for what the table lacks; what is not
there either is encoded by the library. No pre-token is shuffled, and the sample decides about speed alone.

What the library would treat otherwise (a normalizer that is not the identity, no byte fallback, white
space as a suffix, the meta symbol U+2581 in a text) goes to it as a whole text.

Edge cases: a null text is empty and has no tokens. Rows are counted one by one: repeated and null ids are
rows of their own; an empty table gives no rows. Texts of any length are counted whole. Only the text column
is read; other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import as_bytes, grouped, share, shared, small_batches

FREQUENT = 65_536  # pre-tokens in the table that tasks are sent
SAMPLE = 4_000  # documents whose pre-tokens are counted for it
SAMPLE_TASKS = 8  # each of them returns at most FREQUENT pre-tokens
REMEMBERED = 400_000  # pre-tokens in each of the two generations of a worker's cache

_BLOCK = 1 << 20  # bytes of text looked up at a time
_KEY = 15  # bytes of the longest key of the table; the 16th byte holds the length
_META = "▁".encode()

RESULT = "n_bytes long, n_tokens long"


class Table:
    """Token counts of pre-tokens of up to 15 bytes: two key words and a count per slot, linear probing."""

    def __init__(self, counts: dict[bytes, int]):
        keys = [k for k in counts if len(k) <= _KEY and counts[k] < 1 << 16]
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.low, self.high = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64)
        self.count = np.zeros(1 << bits, dtype=np.uint16)
        packed = b"".join(k.ljust(_KEY, b"\0") + bytes([len(k)]) for k in keys)
        words = np.frombuffer(packed, dtype="<u8").reshape(-1, 2)
        for slot, (low, high), key in zip(self._slot(words[:, 0], words[:, 1]).tolist(), words.tolist(), keys):
            while self.high[slot]:  # a key is never empty, so its length is not 0
                slot = (slot + 1) % len(self.low)
            self.low[slot], self.high[slot], self.count[slot] = low, high, counts[key]

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The count of every key, -1 for one that the table lacks."""
        found = np.full(len(low), -1, dtype=np.int64)
        slot = self._slot(low, high)
        open_ = np.flatnonzero(high)
        while len(open_):
            at = slot[open_]
            there = self.high[at]
            hit = (there == high[open_]) & (self.low[at] == low[open_])
            found[open_[hit]] = self.count[at[hit]]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + 1) % len(self.low)
        return found


class Counts:
    """What tasks are sent: the model, where its texts may be cut, and the table of frequent pre-tokens."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        if not str(path).endswith(".model"):
            raise ValueError("counts by pre-tokens need a sentencepiece model")
        with open(path, "rb") as file:
            self.definition = file.read()
        spec = model.ModelProto()
        spec.ParseFromString(self.definition)
        norm, trained = spec.normalizer_spec, spec.trainer_spec
        # Where one of these does not hold, texts are encoded whole.
        self.cuttable = bool(
            trained.model_type == model.TrainerSpec.BPE
            and trained.byte_fallback
            and not trained.treat_whitespace_as_suffix
            and not norm.precompiled_charsmap
            and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces
        )
        self.prefix = b" " if norm.add_dummy_prefix else b""
        # Which bytes stand side by side in a piece. All bytes beyond ASCII are one kind, 128.
        side = np.zeros((129, 129), dtype=bool)
        side[128, 128] = True
        for piece in spec.pieces:
            if piece.type in (piece.NORMAL, piece.USER_DEFINED, piece.UNUSED):
                kinds = [min(ord(c), 128) for c in piece.piece.replace("▁", " ")]
                side[kinds[:-1], kinds[1:]] = True
        kind = np.minimum(np.arange(256), 128)
        self.joined = side[kind[:, None], kind[None, :]].ravel()
        self.table = Table({})
        self.encoder = None

    def _open(self) -> None:
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=self.definition)
        self.new: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of texts begin that stand one after the other; ``starts``: first bytes of the texts."""
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        edge = np.empty(len(data), dtype=bool)
        np.logical_not(self.joined[pair], out=edge[1:])
        edge[starts] = True
        return np.flatnonzero(edge)

    def lengths(self, pieces: list[bytes]) -> list[int]:
        """Token counts of pre-tokens by the library; each begins as in a text."""
        # The library puts a space before every text but an empty one.
        own = [(p[len(self.prefix) :] if p.startswith(self.prefix) else None) for p in pieces]
        plain = [p.decode() for p in own if p]
        counts = iter(map(len, self.encoder.encode(plain, num_threads=1)))
        return [next(counts) if p else self._inner(whole) for p, whole in zip(own, pieces)]

    def _inner(self, piece: bytes) -> int:
        """Tokens of a pre-token without a space before it, or of the space alone."""
        text = piece.decode()
        if not self.prefix:
            return len(self.encoder.encode(text))
        # After a line feed nothing is merged with it, for no piece holds one beside another character.
        if text == " ":
            return len(self.encoder.encode(" \n ")) - len(self.encoder.encode(" \n"))
        return len(self.encoder.encode("\n" + text)) - len(self.encoder.encode("\n"))

    def _missing(self, pieces: list[bytes]) -> list[int]:
        """Counts by the worker's cache. When it is full, its older half goes."""
        found = list(map(self.new.get, pieces))
        if None in found:
            wanted = {p for p, n in zip(pieces, found) if n is None}
            known = {p: self.old[p] for p in wanted if p in self.old}
            unknown = list(wanted.difference(known))
            known.update(zip(unknown, self.lengths(unknown)))
            if len(self.new) + len(known) > REMEMBERED:
                self.old, self.new = self.new, {}
            self.new.update(known)
            found = [known[p] if n is None else n for p, n in zip(pieces, found)]
        return found

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of every text."""
        if self.encoder is None:
            self._open()
        totals = np.zeros(len(texts), dtype=np.int64)
        chosen, parts = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.cuttable or _META in text or not self._free_line(text):
                totals[i] = len(self.encoder.encode(text.decode()))
            else:
                chosen.append(i)
                parts.append(self.prefix + text)
        if not chosen:
            return totals
        joined = b"".join(parts)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        data = np.frombuffer(joined, dtype=np.uint8)
        first = np.cumsum(sizes) - sizes
        starts = self.cuts(data, first)
        ends = np.r_[starts[1:], len(data)]
        length = ends - starts
        low, high = self._keys(joined, starts, length)
        counts = self.table.find(low, high)
        lacking = np.flatnonzero(counts < 0)
        if len(lacking):
            pieces = [joined[a:b] for a, b in zip(starts[lacking].tolist(), ends[lacking].tolist())]
            counts[lacking] = self._missing(pieces)
        totals[chosen] = np.add.reduceat(counts, np.searchsorted(starts, first))
        return totals

    def _free_line(self, text: bytes) -> bool:
        """Whether pre-tokens may be encoded after a line feed: no piece holds one beside another character."""
        return not self.joined[10 * 256 : 11 * 256].any()

    def _keys(self, joined: bytes, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key words of pre-tokens; longer ones than a key get zeros."""
        padded = joined + bytes(16)
        words = np.ndarray(len(joined) + 8, dtype="<u8", buffer=padded, strides=(1,))
        short = np.minimum(length, 8)
        long = np.clip(length - 8, 0, 8)
        masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
        low, high = words[starts] & masks[short], words[starts + 8] & masks[long]
        high |= length.astype(np.uint64) << np.uint64(56)
        fits = length <= _KEY
        return np.where(fits, low, np.uint64(0)), np.where(fits, high, np.uint64(0))


def sampled(docs: DataFrame, counts: Counts, seed: int = 1) -> dict[bytes, int]:
    """Pre-tokens of a sample of about ``SAMPLE`` texts and how often they occur; the driver gets a bounded number."""
    if not counts.cuttable:
        return {}
    total = docs.count()
    if not total:
        return {}
    texts = docs.select("text").sample(min(1.0, SAMPLE / total), seed=seed).coalesce(SAMPLE_TASKS)
    sent = share(docs.sparkSession, counts)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared(sent)
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    whole = own.prefix + text.encode()
                    starts = own.cuts(np.frombuffer(whole, dtype=np.uint8), np.zeros(1, dtype=np.int64)).tolist()
                    seen.update(whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)]) if b - a <= _KEY)
        top = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], type=pa.binary()), pa.array([n for _, n in top], type=pa.int64())], names=["piece", "n"]
        )

    found: Counter = Counter()
    rows = texts.mapInArrow(frequent, "piece binary, n long").toArrow()
    for piece, n in zip(rows["piece"].to_pylist(), rows["n"].to_pylist()):
        found[piece] += n
    return dict(found.most_common(FREQUENT))


def learn(docs: DataFrame, path: str) -> Counts:
    """The counter of a model, with the table of the pre-tokens that are frequent in ``docs``."""
    small_batches(docs.sparkSession)
    counts = Counts(path)
    pieces = list(sampled(docs, counts))
    counts._open()
    counts.table = Table(dict(zip(pieces, counts.lengths(pieces))))
    counts.encoder = None
    return counts


def token_counts(docs: DataFrame, counts: Counts) -> Column:
    """A struct per text: its UTF-8 bytes and its tokens."""
    sent = share(docs.sparkSession, counts)

    @F.pandas_udf(RESULT)
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared(sent)
        for texts in batches:
            whole = list(as_bytes(texts))
            sizes = [len(t) for t in whole]
            parts = [own.count(part) for part in grouped(whole, sizes, _BLOCK)]
            n = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            yield pd.DataFrame({"n_bytes": np.array(sizes, dtype=np.int64), "n_tokens": n})

    return value(F.col("text"))
