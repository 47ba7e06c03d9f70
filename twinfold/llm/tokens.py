"""Ids of whole texts as the tokenizers library gives them, with repeated words encoded once.

A text is cut where the tokenizer always cuts too: a word-end tokenizer drops white space, a
byte-level one begins a new pre-token wherever white space follows something else. Each
distinct cut is encoded by the library once per worker; the ids of a block of texts are then
gathered from one flat array.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

_KEEP = 1_200_000  # cuts remembered per worker

# Characters that are white space for one side only, or whose class has changed: such texts go to the library whole.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎]")
_SPACE = "\t-\r \xa0  -     　"
_RUNS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: White space right before a space, in UTF-8, but for the rarer ones, whose lead bytes are looked for.
_DOUBLE = (b"  ", b"\n ", b"\t ", b"\r ", b"\x0b ", b"\x0c ", b"\xc2\xa0 ")
_UNSURE_BYTES = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xe1\xa0\x8e")
# First bytes of keys that no UTF-8 text begins with: a cut as it is, and a single id.
_AS_IS, _SINGLE = b"\xfe", b"\xff"
_JOINED = 20_000  # cuts encoded in one call
_LEADS = (b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")


class Tokens:
    """What tasks are sent; a worker that runs several tasks keeps the cuts it has encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.definition = file.read()
        spec = json.loads(self.definition)
        self.drops_space = bool(spec["model"]["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokenizer = None

    def _open(self) -> None:
        from tokenizers import Tokenizer

        # Texts are cut at special strings before, so inside a cut they are ordinary text.
        self.tokenizer = Tokenizer.from_str(self.definition)
        self.tokenizer.encode_special_tokens = True
        self.joiner = Tokenizer.from_str(self.definition)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _text(self, cut: bytes) -> str:
        if self.drops_space:
            return cut.decode()
        return cut[1:].decode() if cut[:1] == _AS_IS else " " + cut.decode()

    def _ids_of(self, cuts: list[bytes]) -> list[list[int]]:
        """Ids of every cut; cuts are joined by a special string, which ends one and begins the next."""
        found: list[list[int]] = [[]] * len(cuts)
        texts = []
        for i, cut in enumerate(cuts):
            if cut[:1] == _SINGLE:
                found[i] = [int(cut[1:])]
            else:
                texts.append((i, self._text(cut)))
        mark, number = next(iter(self.special.items()), ("", -1))
        safe = [(i, t) for i, t in texts if mark and "<|" not in t]
        for at in range(0, len(safe), _JOINED):
            part = safe[at : at + _JOINED]
            ids = self.joiner.encode_batch_fast([mark.join(t for _, t in part)], add_special_tokens=False)[0].ids
            begin = 0
            for i, _ in part[:-1]:
                end = ids.index(number, begin)
                found[i] = ids[begin:end]
                begin = end + 1
            found[part[-1][0]] = ids[begin:]
        for i, t in texts:
            if not mark or "<|" in t:
                found[i] = self.tokenizer.encode(t, add_special_tokens=False).ids
        return found

    def _learn(self, cuts: set[bytes]) -> None:
        new = list(cuts)
        coded = self._ids_of(new)
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        first, total = len(self.number), int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(new) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(coded), dtype=np.uint32, count=total)
        self.lengths[first : first + len(new)] = lengths
        self.starts[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.number.update(zip(new, range(first, first + len(new))))

    def cuts(self, text: bytes) -> list[bytes]:
        """Pieces of a text without special strings whose ids add up to the text's ids.

        Of a byte-level tokenizer, a piece stands for itself with a space before it, or, after the
        byte ``_AS_IS``, for itself.
        """
        if self.drops_space:
            # Lower case is the tokenizer's own; doing it here makes fewer distinct cuts.
            return text.lower().split()
        if any(d in text for d in _DOUBLE) or any(d in text for d in _LEADS):
            whole = text.decode()
            if _UNSURE.search(whole):
                return [_AS_IS + text]
            return [_AS_IS + run.encode() for run in _RUNS.findall(whole)]
        if any(c in text for c in _UNSURE_BYTES):
            return [_AS_IS + text]
        cuts = text.split(b" ")
        cuts[0] = _AS_IS + cuts[0]
        return cuts

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end`` after each, and the number of ids of each text."""
        if self.tokenizer is None:
            self._open()
        pieces: list[bytes] = []
        counts = []
        last = _SINGLE + str(end).encode()
        for text in texts:
            before = len(pieces)
            if self.split_special and b"<|" in text:
                for part in self.split_special.split(text.decode()):
                    if part in self.special:
                        pieces.append(_SINGLE + str(self.special[part]).encode())
                    else:
                        pieces += self.cuts(part.encode())
            else:
                pieces += self.cuts(text)
            pieces.append(last)
            counts.append(len(pieces) - before)
        rows = list(map(self.number.get, pieces))
        if None in rows:
            missing = [i for i, row in enumerate(rows) if row is None]
            new = {pieces[i] for i in missing}
            if len(self.number) + len(new) > _KEEP:
                self._clear()
                new, missing = set(pieces), range(len(pieces))
            self._learn(new)
            for i in missing:
                rows[i] = self.number[pieces[i]]
        rows = np.array(rows, dtype=np.int64)
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        source = np.repeat(self.starts[rows] - ends + lengths, lengths)
        source += np.arange(len(source))
        totals = np.add.reduceat(lengths, np.cumsum(counts) - counts) if counts else np.zeros(0, dtype=np.int64)
        return self.ids[source], totals


def blocks(tokens: Tokens, texts: list[bytes], end: int, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first text, ids, ids per text)`` for runs of texts of about ``limit`` bytes."""
    at, first, size = 0, 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield first, *tokens.encode(texts[first : at + 1], end)
            first, size = at + 1, 0
    if first < len(texts):
        yield first, *tokens.encode(texts[first:], end)
