"""Character shingle sets as sorted 64-bit ids, made and compared inside Arrow batches.

An id is a linear hash of the shingle's code points and a bijective mix of it, so two shingles of one
pair of texts share an id with a chance of about 2**-64. A set's sketch has two to four bits for each of its
elements, one of which each element sets. A bit set in one sketch only is an element of that set
only, so two sketches bound the overlap of their sets from above, whatever their sizes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LEAST_BITS = 64


def _factor(place: int) -> np.uint64:
    """An odd number per place in the shingle."""
    return np.uint64(int.from_bytes(md5(f"s{place}".encode()).digest()[:8], "big") | 1)


def window_ids(points: np.ndarray, size: int) -> np.ndarray:
    """The id of every ``size`` consecutive code points."""
    points = points.astype(np.uint64)
    ids = np.zeros(max(len(points) - size + 1, 0), dtype=np.uint64)
    for place in range(size):
        ids += points[place : place + len(ids)] * _factor(place)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        ids ^= ids >> np.uint64(shift)
        ids *= np.uint64(factor)
    ids ^= ids >> np.uint64(31)
    return ids


def ids_of(text: str, size: int) -> np.ndarray:
    """The distinct shingles of a text, as rising ids."""
    ids = window_ids(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), size)
    if not len(ids):
        return ids
    ids.sort()
    return ids[np.r_[True, ids[1:] != ids[:-1]]]


def sketch_of(ids: np.ndarray) -> bytes:
    """One bit per id, in a power of two of bits, two to four times as many as ids."""
    bits = max(_LEAST_BITS, 1 << (2 * max(len(ids), 1) - 1).bit_length())
    flags = np.zeros(bits, dtype=bool)
    flags[(ids & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def sized_sketch(ids: np.ndarray) -> bytes:
    """The size of a set in four bytes, then its sketch."""
    return len(ids).to_bytes(4, "little") + sketch_of(ids)


def most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """A bound of the number of elements that two sets have in common, from their sketches and sizes."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    # The wider sketch is folded: an id's bit in a narrower one is given by fewer of its bits.
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The number of elements that two sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def similarity(n_common: int, n_a: int, n_b: int) -> float:
    """Jaccard similarity; 0.0 of two empty sets."""
    union = n_a + n_b - n_common
    return n_common / union if union else 0.0


def prefix_length(n: int, threshold: float) -> int:
    """So many of the first elements, in one order of all, that similar sets share one of them."""
    return n - int(np.ceil(threshold * n - 1e-6)) + 1 if n else 0


def prefix_of(ids: np.ndarray, frequent: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The elements of a set that decide on similarity, rarest first; ``frequent`` is sorted."""
    times = np.zeros(len(ids), dtype=np.int64)
    if len(frequent) and len(ids):
        at = np.minimum(np.searchsorted(frequent, ids), len(frequent) - 1)
        times = np.where(frequent[at] == ids, counts[at], 0)
    return ids[np.lexsort((ids, times))[: prefix_length(len(ids), threshold)]]


def shingle_ids(normalized: Column, size: int) -> Column:
    """The sorted ids of a text's shingle set, as bytes of 64-bit numbers."""

    @F.pandas_udf("binary")
    def value(texts: pd.Series) -> pd.Series:
        return pd.Series([ids_of(text or "", size).tobytes() for text in texts], dtype=object)

    return value(normalized)


def prefix(normalized: Column, size: int, threshold: float, frequent: np.ndarray, counts: np.ndarray) -> Column:
    """struct(n, prefix) of a text: the size of its shingle set and the ids that decide on similarity."""

    @F.pandas_udf("n int, prefix array<bigint>")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [ids_of(text or "", size) for text in texts]
            chosen = [prefix_of(ids, frequent, counts, threshold).view(np.int64) for ids in sets]
            yield pd.DataFrame({"n": np.array([len(s) for s in sets], dtype=np.int32), "prefix": pd.Series(chosen, dtype=object)})

    return value(normalized)


def text_similarity(left: Column, right: Column, size: int) -> Column:
    """Jaccard similarity of the shingle sets of two texts; a right text that repeats is cut up once."""

    @F.pandas_udf("double")
    def value(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, ids = None, None
        for lefts, rights in batches:
            found = []
            for a, b in zip(lefts, rights):
                if b != last or ids is None:
                    last, ids = b, ids_of(b or "", size)
                own = ids_of(a or "", size)
                found.append(similarity(common(own, ids), len(own), len(ids)))
            yield pd.Series(found, dtype="float64")

    return value(left, right)
