"""SimHash, MinHash and top terms per text, as Arrow-batched UDFs.

A fingerprint needs one text and nothing else, so it is computed where the row
is: no shuffle. The same work as explode + group-by moves every shingle through
an aggregate and every partial result through an exchange.

Definitions
  SimHash  token hash = low 64 bits of md5; a bit is 1 iff more than half of the
           token occurrences have it; no tokens give 0.
  MinHash  h = low 32 bits of md5(shingle) mod p; value i = (a_i h + b_i) mod p.
  Band     first 8 hex digits of md5 of the band's values joined with commas.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinfold.functions.shingle_sets import sized_sketch, window_ids
from twinfold.params import DEFAULT, Params

# Workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The MinHash modulus and the prefixes its coefficients come from.
PRIME = 2**31 - 1
PREFIX_A, PREFIX_B = "a", "b"

_BLOCK = 128  # shingles hashed at a time, so that the work stays in cache
_GROUP = 1_000_000  # characters handled together: bounds memory, and shares hashes between texts
_CACHE = 1_000_000  # token hashes remembered per task
_LANES = 8_192  # pieces whose md5 is made side by side
_TOKENS = 50_000  # tokens of a text whose bits are added up at a time
_KNOWN = 2_000_000  # shingle hashes remembered per task, twelve bytes each
_FOLD = 200_000  # shingles whose permuted hashes exist at a time
_ROWS = 1_024  # rows of them whose minima are taken at a time
_LARGE = 256  # shingles of a text from which only small hashes are looked at
_SMALLEST = 8  # values below the limit that a text of that size has on average


def _low(text: str, size: int) -> int:
    return int.from_bytes(md5(text.encode()).digest()[-size:], "big")


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers a_i and b_i; computed where the plan is made, and sent along with it."""
    a = [1 + _low(f"{PREFIX_A}{i}", 4) % (PRIME - 1) for i in range(count)]
    b = [_low(f"{PREFIX_B}{i}", 4) % PRIME for i in range(count)]
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


# Fixed values of md5: what each step adds, how far it turns, and which word of the message it takes.
_MD5_ADD = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_MD5_TURN = [turns[i % 4] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_MD5_WORD = [(m * i + c) % 16 for m, c in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_MD5_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_MOST = 55  # bytes of a piece that is one block with its length


def _md5_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The md5 of pieces of ``data``, of at most 55 bytes each, as four little-endian words: one row per word.

    All pieces take a step together, so a hash costs a few dozen array operations and no Python object.
    """
    found = np.empty((4, len(starts)), dtype=np.uint32)
    data = np.concatenate([data, np.zeros(_MD5_MOST + 1, dtype=np.uint8)])
    for at in range(0, len(starts), _LANES):
        size = sizes[at : at + _LANES]
        width = int(size.max()) // 4 + 1
        place = np.arange(4 * width)
        block = data[starts[at : at + _LANES, None] + place]
        block *= place < size[:, None]
        block[np.arange(len(size)), size] = 0x80
        words = dict(enumerate(np.ascontiguousarray(block.view("<u4").T)))
        words[14] = (size * 8).astype(np.uint32)
        state = [np.full(len(size), x, dtype=np.uint32) for x in _MD5_STATE]
        a, b, c, d = (x.copy() for x in state)
        mixed, turned = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=mixed)
                mixed &= b
                mixed ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=mixed)
                mixed &= d
                mixed ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=mixed)
                mixed ^= d
            else:
                np.bitwise_not(d, out=mixed)
                mixed |= b
                mixed ^= c
            a += mixed
            a += np.uint32(_MD5_ADD[i])
            if _MD5_WORD[i] in words:
                a += words[_MD5_WORD[i]]
            np.left_shift(a, np.uint32(_MD5_TURN[i]), out=turned)
            a >>= np.uint32(32 - _MD5_TURN[i])
            a |= turned
            a += b
            a, b, c, d = d, a, b, c
        for row, (x, first) in enumerate(zip((a, b, c, d), state)):
            np.add(x, first, out=found[row, at : at + _LANES])
    return found


def _digests(pieces, size: int) -> np.ndarray:
    """The last ``size`` bytes of the md5 of every piece, as numbers."""
    return np.frombuffer(b"".join([md5(piece.encode()).digest()[-size:] for piece in pieces]), dtype=f">u{size}")


def _token_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last eight bytes of the md5 of every token, as they stand there: one row per token."""
    found = np.empty((len(starts), 8), dtype=np.uint8)
    short = np.flatnonzero(sizes <= _MD5_MOST)
    found[short] = np.ascontiguousarray(_md5_words(data, starts[short], sizes[short])[2:].T).astype("<u4").view(np.uint8)
    for i in np.flatnonzero(sizes > _MD5_MOST).tolist():
        found[i] = np.frombuffer(md5(data[starts[i] : starts[i] + sizes[i]].tobytes()).digest()[-8:], dtype=np.uint8)
    return found


def _hashes(pieces, size: int, cache: dict) -> np.ndarray:
    """Hash of every piece; repeated pieces of a task are hashed once."""
    if len(cache) > _CACHE:
        cache.clear()
    pieces = list(pieces)
    found = list(map(cache.get, pieces))
    for i in [i for i, value in enumerate(found) if value is None]:
        found[i] = cache[pieces[i]] = md5(pieces[i].encode()).digest()[-size:]
    return np.frombuffer(b"".join(found), dtype=f">u{size}").astype(np.uint64)


def groups_of(texts: pd.Series) -> Iterator[list[str]]:
    """Consecutive texts of about _GROUP characters together; a null text is empty."""
    group: list[str] = []
    length = 0
    for text in texts:
        text = text or ""
        group.append(text)
        length += len(text)
        if length >= _GROUP:
            yield group
            group, length = [], 0
    if group:
        yield group


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, rising; sorting is faster here than the hashing of ``np.unique``."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


class Pieces:
    """The distinct shingles of a group of texts by rising id, made only where they are asked for."""

    def __init__(self, ids: np.ndarray, joined: str, windows: np.ndarray, size: int):
        self.ids, self._joined, self._windows, self._size = ids, joined, windows, size
        self._coded: tuple[np.ndarray, np.ndarray] | None = None  # the bytes, and where each character begins

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int) -> str:
        return self.at(self.places(self.ids[i : i + 1]))[0]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where in the group the shingles of some rising ids stand; windows of one id have one content."""
        low = np.uint64((1 << 20) - 1)
        flags = np.zeros(1 << 20, dtype=bool)
        flags[ids & low] = True
        likely = np.flatnonzero(flags[self._windows & low])
        at = np.minimum(np.searchsorted(ids, self._windows[likely]), len(ids) - 1)
        held = ids[at] == self._windows[likely]
        places = np.zeros(len(ids), dtype=np.int64)
        places[at[held]] = likely[held]
        return places

    def at(self, places: np.ndarray) -> list[str]:
        return [self._joined[p : p + self._size] for p in places.tolist()]

    def hashes(self, places: np.ndarray) -> np.ndarray:
        """The low 32 bits of the md5 of the shingles at some places."""
        if 4 * self._size > _MD5_MOST:
            return _digests(self.at(places), 4).astype(np.uint32)
        if self._coded is None:
            coded = self._joined.encode()
            data = np.frombuffer(coded, dtype=np.uint8)
            # A character begins at each byte that does not continue one.
            begins = np.flatnonzero((data & 0xC0) != 0x80) if len(coded) > len(self._joined) else np.arange(len(coded))
            self._coded = data, np.append(begins, len(coded))
        data, begins = self._coded
        starts = begins[places]
        return _md5_words(data, starts, begins[places + self._size] - starts)[3].byteswap()


def shingle_index(texts: list[str], size: int) -> tuple[Pieces, list[np.ndarray]]:
    """The distinct shingles of a group of texts, and for each text which of them it has."""
    joined = "".join(texts)
    windows = window_ids(np.frombuffer(joined.encode("utf-32-le"), dtype="<u4"), size)
    starts = np.cumsum([0] + [len(text) for text in texts])
    own = [_distinct(windows[s : s + max(len(text) - size + 1, 0)]) for s, text in zip(starts, texts)]
    every = _distinct(np.concatenate(own))
    return Pieces(every, joined, windows, size), [np.searchsorted(every, ids) for ids in own]


def shingle_hashes(pieces: Pieces, known: dict) -> np.ndarray:
    """The hash of every shingle of a group, modulo the prime; ``known`` keeps those that the task has met, by id."""
    ids, met, values = pieces.ids, known.get("ids", np.zeros(0, dtype=np.uint64)), known.get("hashes", np.zeros(0, dtype=np.uint32))
    at = np.searchsorted(met, ids)
    old = np.zeros(len(ids), dtype=bool)
    if len(met):
        old = met[np.minimum(at, len(met) - 1)] == ids
    found = np.empty(len(ids), dtype=np.uint32)
    found[old] = values[at[old]]
    new = np.flatnonzero(~old)
    if len(new):
        places = pieces.places(ids[new])
        for start in range(0, len(new), _FOLD):
            found[new[start : start + _FOLD]] = pieces.hashes(places[start : start + _FOLD]) % np.uint32(PRIME)
        if len(met) + len(new) > _KNOWN:
            known.update(ids=ids[:_KNOWN].copy(), hashes=found[:_KNOWN].copy())
        else:
            known.update(ids=np.insert(met, at[new], ids[new]), hashes=np.insert(values, at[new], found[new]))
    return found


def _scale(numbers: np.ndarray) -> np.ndarray:
    """Numbers below the prime as parts of 2^64, rounded up."""
    return np.array([-(-(int(n) << 64) // PRIME) for n in numbers], dtype=np.uint64)


def _scaled(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``permuted`` as parts of 2^32, from coefficients as parts of 2^64: the modulus is the overflow.

    A product is off by less than 2^32, and neighbouring values are 2^33 apart, so the upper halves are in the order of the values and tell them apart.
    """
    table = np.empty((len(hashes), len(a)), dtype=np.uint32)
    values = np.empty((_BLOCK, len(a)), dtype=np.uint64)
    upper = values.view(np.uint32).reshape(_BLOCK, len(a), 2)[:, :, 1 if sys.byteorder == "little" else 0]
    for start in range(0, len(hashes), _BLOCK):
        some = hashes[start : start + _BLOCK, None]
        np.multiply(some, a, out=values[: len(some)])
        values[: len(some)] += b
        table[start : start + _BLOCK] = upper[: len(some)]
    return table


def _unscaled(values: np.ndarray) -> np.ndarray:
    """The numbers below the prime that parts of 2^32 stand for."""
    return ((values.astype(np.uint64) * np.uint64(PRIME) + np.uint64(1 << 31)) >> np.uint64(32)).astype(np.uint32)


def permuted(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row per hash, column per permutation."""
    return _unscaled(_scaled(hashes, _scale(a), _scale(b)))


def _small(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The scaled values below ``limit``: their places in a table with a row per hash and a column per permutation, rising, and the values."""
    places, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    values = np.empty((_BLOCK, len(a)), dtype=np.uint64)
    for start in range(0, len(hashes), _BLOCK):
        some = values[: min(_BLOCK, len(hashes) - start)]
        np.multiply(hashes[start : start + _BLOCK, None], a, out=some)
        some += b
        flat = some.reshape(-1)
        at = np.flatnonzero(flat < np.uint64(limit << 32))
        found.append(flat[at])
        places.append(at + start * len(a))
    return np.concatenate(places), (np.concatenate(found) >> np.uint64(32)).astype(np.uint32)


def _minima(hashes: np.ndarray, owned: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The smallest scaled value of each text's shingles under each permutation; the largest number for a text without.

    The minimum of n values is nearly always among the smallest few of n, so a large text looks at values below a limit only; where it has
    none, it looks at all of its values. The limit decides about the work, not about the result.
    """
    width = len(a)
    best = [np.full(width, 2**32 - 1, dtype=np.uint32) for _ in owned]
    kinds = [max(0, (len(rows) // _LARGE).bit_length() + 1 >> 1) for rows in owned]
    places = values = None
    for kind in range(1, max(kinds, default=0) + 1):
        texts = [i for i, k in enumerate(kinds) if k == kind]
        if not texts:
            continue
        limit = (_SMALLEST << 32) // (_LARGE << 2 * (kind - 1))
        if places is None:
            places, values = _small(hashes, a, b, limit)
        else:
            places, values = places[values < limit], values[values < limit]
        begins = np.searchsorted(places, np.arange(len(hashes) + 1) * width)
        column = places % width
        for i in texts:
            first = begins[owned[i]]
            times = begins[owned[i] + 1] - first
            upto = np.cumsum(times)
            at = np.repeat(first - upto + times, times) + np.arange(upto[-1])
            np.minimum.at(best[i], column[at], values[at])
    for i, rows in enumerate(owned):
        if len(rows) and (kinds[i] == 0 or best[i].max() == 2**32 - 1):
            for at in range(0, len(rows), _ROWS):
                np.minimum(best[i], _scaled(hashes[rows[at : at + _ROWS]], a, b).min(axis=0), out=best[i])
    return best


def set_minhashes(
    texts: pd.Series, size: int, a: np.ndarray, b: np.ndarray, known: dict
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The shingle set of each text, as rising ids, and its MinHash values; None without shingles.

    The values of a group's shingles are made ``_FOLD`` shingles at a time and folded into the minima of the
    texts, so a text of any length needs a few numbers per character.
    """
    a, b = _scale(a), _scale(b)
    for group in groups_of(texts):
        pieces, owned = shingle_index(group, size)
        hashes = shingle_hashes(pieces, known).astype(np.uint64)
        best = [np.full(len(a), 2**32 - 1, dtype=np.uint32) for _ in owned]
        for start in range(0, len(pieces), _FOLD):
            part = [rows[slice(*np.searchsorted(rows, (start, start + _FOLD)))] - start for rows in owned]
            for values, found in zip(best, _minima(hashes[start : start + _FOLD], part, a, b)):
                np.minimum(values, found, out=values)
        for rows, values in zip(owned, best):
            yield pieces.ids[rows], _unscaled(values) if len(rows) else None


def minhashes(
    texts: pd.Series, size: int, a: np.ndarray, b: np.ndarray, known: dict
) -> Iterator[tuple[int, np.ndarray | None]]:
    """Number of distinct shingles and MinHash values of each text; None without shingles."""
    return ((len(ids), values) for ids, values in set_minhashes(texts, size, a, b, known))


def band_hashes(values: np.ndarray, rows: int) -> list[int]:
    """Bucket numbers: band index in the upper, band hash in the lower 32 bits."""
    texts = [",".join(map(str, values[i : i + rows].tolist())) for i in range(0, len(values), rows)]
    return [(band << 32) | int(md5(t.encode()).hexdigest()[:8], 16) for band, t in enumerate(texts)]


def simhash_values(texts: pd.Series) -> list[int]:
    """The fingerprints of texts as signed 64-bit numbers."""
    return [value for group in groups_of(texts) for value in _simhashes([text.split() for text in group])]


def _simhashes(texts: list[list[str]]) -> list[int]:
    """Tokens are hashed wherever they stand, which costs less than to find those met before."""
    data = np.frombuffer(" ".join([*chain.from_iterable(texts), ""]).encode(), dtype=np.uint8)
    ends = np.flatnonzero(data == 0x20)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    hashes = _token_hashes(data, starts, ends - starts)
    found, at = [], 0
    for tokens in texts:
        weight = np.zeros(64)
        for low in range(at, at + len(tokens), _TOKENS):
            bits = np.unpackbits(hashes[low : min(low + _TOKENS, at + len(tokens))], axis=1)
            # Whole numbers far below 2^24, so floating point is exact.
            weight += np.ones(len(bits), dtype=np.float32) @ bits.astype(np.float32)
        found.append(int.from_bytes(np.packbits(2 * weight > len(tokens)).tobytes(), "big", signed=True) if tokens else 0)
        at += len(tokens)
    return found


def simhash_value(tokens: list[str], cache: dict | None = None) -> int:
    """The fingerprint of one text's tokens."""
    return _simhashes([tokens])[0]


def fingerprint(normalized: Column, params: Params = DEFAULT) -> Column:
    """struct(simhash, n_shingles, buckets, sketch) of normalised text; no buckets without shingles."""
    size, rows = params.shingle_size, params.rows
    a, b = coefficients(params.permutations)
    known: dict = {}

    @F.pandas_udf("simhash bigint, n_shingles int, buckets array<bigint>, sketch binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        hashed = list(set_minhashes(texts, size, a, b, known))
        return pd.DataFrame(
            {
                "simhash": simhash_values(texts),
                "n_shingles": [len(ids) for ids, _ in hashed],
                "buckets": [band_hashes(values, rows) if len(ids) else [] for ids, values in hashed],
                "sketch": [sized_sketch(ids) for ids, _ in hashed],
            }
        )

    return features(normalized)


def simhash(normalized: Column) -> Column:
    @F.pandas_udf("bigint")
    def value(texts: pd.Series) -> pd.Series:
        return pd.Series(simhash_values(texts), dtype="int64")

    return value(normalized)


def minhash(normalized: Column, params: Params = DEFAULT) -> Column:
    """All MinHash values of a text as an array; empty without shingles."""
    size = params.shingle_size
    a, b = coefficients(params.permutations)
    known: dict = {}

    @F.pandas_udf("array<bigint>")
    def value(texts: pd.Series) -> pd.Series:
        hashed = minhashes(texts, size, a, b, known)
        return pd.Series([values.astype(np.int64) if n else [] for n, values in hashed], dtype=object)

    return value(normalized)


def top_terms(text: Column, max_terms: int = 10) -> Column:
    """Most frequent words of two or more characters with their share of the listed counts.

    Ties keep the order of first appearance.
    """

    @F.pandas_udf("array<struct<term:string,weight:double>>")
    def terms(texts: pd.Series) -> pd.Series:
        def top(value: str) -> list[dict]:
            counts = Counter(w for w in (value or "").lower().split() if len(w) > 1)
            best = counts.most_common(max_terms)
            total = sum(n for _, n in best)
            return [{"term": w, "weight": round(n / total, 3)} for w, n in best]

        return pd.Series([top(value) for value in texts], dtype=object)

    return terms(text)
