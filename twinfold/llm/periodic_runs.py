"""Periodic runs of words: a suffix automaton whose link tree is accessed as a link-cut tree.

Every state of the automaton of a word sequence stands for the substrings that end at the same
places; its suffix link leads to the longest shorter one with more ends. The words are appended in
order: the path from the state of the current prefix to the root is accessed, and all states on it take
the current place as their last end. Before, that path was made of segments, each of one
earlier end. A segment that ends d words ago and whose longest substring has L words shows that the
last d + L words have period d; with L >= d that is a square. The last end cannot be d words ago if a
smaller period holds, so d is the smallest one; L is as long as it can be, so the stretch begins where the
run begins, and it grows word by word until the run ends. The segments of all accesses together
are O(n log n), however the words repeat.

A run has smallest period q and at least ``max(least, 4 q)`` words (``least`` >= 6). All grams of five
words within it stand in it twice or more. So first the stretches of words are found whose
grams all repeat within the stretch; a run lies in one of them as a whole, and only these go
through the automaton. That leaves nothing of most texts and drops no run.

Edge cases: a null, empty or blank text has no words, no runs and an empty collapsed text. Words are
compared as they stand, case included. Rows are judged one by one: repeated ids are rows of their own, and
null ids too; an empty table gives no rows. Only the text column is read; other columns may have any name. Memory
grows with the longest text of a batch, about 1 KB per word of its periodic stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import as_bytes, small_batches

# A run's least number of words and its least number of periods.
LEAST = 6
PERIODS = 4

_GRAM = 5  # words of a gram; each one of a run stands in it at least twice
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)

RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def repeating_stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of word numbers outside of which no run has a word, and no run reaches from one into another.

    Grams are compared by a hash. Equal ones have equal hashes, so a collision only makes a range longer.
    """
    n = len(words) - _GRAM + 1
    if n < 2:
        return []
    with np.errstate(over="ignore"):
        gram = np.zeros(n, dtype=np.uint64)
        for k, factor in enumerate(_MIX):
            gram += words[k : k + n].astype(np.uint64) * np.uint64(factor)
            gram ^= gram >> np.uint64(29)
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    if not same.any():
        return []
    after, before = np.full(n, -1), np.full(n, -1)  # the next and the previous place of the same gram
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    repeats = (after >= 0) | (before >= 0)
    while True:
        edge = np.flatnonzero(np.diff(np.r_[False, repeats, False].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return []
        number = np.cumsum(np.bincount(starts, minlength=n)) - 1
        number[~repeats] = -1
        # A gram of a run has its copy one period off, in the same stretch.
        near = ((after >= 0) & (number[after] == number)) | ((before >= 0) & (number[before] == number))
        kept = repeats & near
        if kept.sum() == repeats.sum():
            break
        repeats = kept
    return [(int(a), int(b) + _GRAM - 1) for a, b in zip(starts, ends)]


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """``(length, link, state of each prefix)``; state 0 is the root."""
    length, link, moves = [0], [-1], [{}]
    prefixes = []
    last = 0
    for n, word in enumerate(words, 1):
        state = len(length)
        length.append(n)
        link.append(0)
        moves.append({})
        at = last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = state
            at = link[at]
        if at >= 0:
            target = moves[at][word]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                clone = state + 1
                length.append(length[at] + 1)
                link.append(link[target])
                moves.append(moves[target].copy())
                while at >= 0 and moves[at].get(word) == target:
                    moves[at][word] = clone
                    at = link[at]
                link[target] = link[state] = clone
        prefixes.append(state)
        last = state
    return length, link, prefixes


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    length, up, prefixes = suffix_automaton(words)
    # Paths are splay trees by depth: a state has a left (shallower) and a right (deeper) child. The parent of a
    # tree's root is the state above the path. ``ends`` holds at a tree's root the last end of all its states.
    # State 0 stands for none: the empty substring says nothing, so its children are the tops.
    left, right = [0] * len(up), [0] * len(up)
    ends = [-1] * len(up)
    up[0] = 0

    def splay(x: int) -> None:
        """Bring a state to the root of its tree."""
        p = up[x]
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            first = x
            if inner:
                # Two equal turns rotate the parent first.
                if (left[g] == p) == (left[p] == x):
                    first = p
            for y in (first, x) if inner else (x,):
                # Rotate y over its parent.
                p = up[y]
                above = up[p]
                if left[p] == y:
                    child = left[p] = right[y]
                    right[y] = p
                else:
                    child = right[p] = left[y]
                    left[y] = p
                if child:
                    up[child] = p
                up[p] = y
                up[y] = above
                if above:
                    if left[above] == p:
                        left[above] = y
                    elif right[above] == p:
                        right[above] = y
                    else:
                        ends[y] = ends[p]
                else:
                    ends[y] = ends[p]
            p = up[x]

    found: list[tuple[int, int, int]] = []
    growing: dict[int, tuple[int, int]] = {}  # period -> (start, last word)
    for place, state in enumerate(prefixes):
        deeper, at = 0, state
        while at:
            p = up[at]
            if p and (left[p] == at or right[p] == at):
                splay(at)
            end = ends[at]
            if end >= 0:
                d, reach = place - end, length[at]
                # The rest of the segment below keeps its end.
                rest = right[at]
                if rest:
                    ends[rest] = end
                if reach >= (PERIODS - 1) * d and reach + d >= least:
                    start = place - d - reach + 1
                    held = growing.get(d)
                    if held is not None and held != (start, place - 1):
                        found.append((held[0], held[1] - held[0] + 1, d))
                    growing[d] = (start, place)
            right[at] = deeper
            deeper, at = at, up[at]
        ends[deeper] = place
        p = up[state]
        if p and (left[p] == state or right[p] == state):
            splay(state)
    found += [(start, end - start + 1, d) for d, (start, end) in growing.items()]
    return sorted((s, n, d) for s, n, d in found) if len(found) < 2 else sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a word sequence, by start, then period."""
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    if len(words) < least:
        return []
    # A word's number is its last place.
    numbers = dict(zip(words, range(len(words))))
    if len(numbers) > len(words) - 3:  # three words of a run at least are repetitions
        return []
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    found = []
    for a, b in repeating_stretches(ids):
        found += [(a + start, n, d) for start, n, d in runs_of(ids[a:b].tolist(), least)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    start, length, period = np.array(runs, dtype=np.int64).T
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change[:-1]) > 0
    return [w for w, out in zip(words, dropped.tolist()) if not out]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> Column:
    """A struct per text of ``docs``: number of words, runs by start and period, the text with one period of each run."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in as_bytes(texts):
                words = text.split()
                runs = find_runs(words, least)
                kept = b" ".join(collapsed(words, runs)).decode()
                rows.append((len(words), [{"start": s, "length": n, "period": d} for s, n, d in runs], kept))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return value(F.col("text"))
