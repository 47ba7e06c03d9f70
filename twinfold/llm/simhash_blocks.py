"""Near-duplicate documents by SimHash with pigeonhole blocks.

A fingerprint has 64 bits, cut into ``bits + common`` blocks. Two fingerprints that
differ in at most ``bits`` bits differ in at most ``bits`` blocks, so they agree in
``common`` whole blocks at least: they are joined on every choice of ``common`` blocks
and their Hamming distance is verified.

Equal fingerprints are one row first. A key with many fingerprints is cut into chunks;
each pair of chunks is one unit of work that gives a spanning forest of its links, not
the links, so the output stays linear in its input.

Edge cases: a null or wordless text has fingerprint zero, which links like any other. Rows
with equal ids stay separate rows. A null id is never a component's smallest id. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import as_bytes, small_batches
from twinfold.operators.components import connected_components
from twinfold.session import materialize

# The seed of the shingle hash and the shingle length.
SEED = 42
SHINGLE = 4

_PENDING = 100_000  # shingles whose bits are counted at a time
_CHUNK = 256  # fingerprints of one key that meet in one unit of work


def fingerprints(texts: Iterable[bytes], size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as a signed 64-bit number."""
    totals: list[np.ndarray] = []
    counts: list[int] = []
    owners: list[int] = []
    starts: list[int] = []
    pending: list[bytes] = []

    def flush() -> None:
        if pending:
            bits = np.unpackbits(np.frombuffer(b"".join(pending), dtype=np.uint8).reshape(-1, 8), axis=1)
            for owner, part in zip(owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64)):
                totals[owner] += part
            pending.clear()
            owners.clear()
            starts.clear()

    digest = xxhash.xxh64_digest
    for text in texts:
        words = text.lower().split()
        owner, n = len(totals), max(len(words) - size + 1, min(len(words), 1))
        totals.append(np.zeros(64, dtype=np.int64))
        counts.append(n)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begin = np.cumsum(lengths + 1) - lengths - 1
        end = (begin + lengths)[min(size, len(words)) - 1 :] if n else begin
        joined = b" ".join(words)
        for at in range(0, n, _PENDING):
            owners.append(owner)
            starts.append(len(pending))
            part = slice(at, min(at + _PENDING, n))
            pending += [digest(joined[a:b], SEED) for a, b in zip(begin[part].tolist(), end[part].tolist())]
            if len(pending) >= _PENDING:
                flush()
    flush()
    if not totals:
        return np.zeros(0, dtype=np.int64)
    majority = 2 * np.stack(totals) > np.array(counts)[:, None]
    return np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """Fingerprint of a text column; per row, without a shuffle."""

    @F.pandas_udf("bigint")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fingerprints(as_bytes(texts), size))

    return value(text)


def block_masks(bits: int, common: int) -> list[int]:
    """For every choice of ``common`` of the ``bits + common`` blocks, the mask of its bits."""
    edges = [round(64 * i / (bits + common)) for i in range(bits + common + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, common)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def run_forest(keys: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """For consecutive rows with equal keys: the row each one is linked to, itself if none.

    Rows k and k + d are compared for d = 1, 2, ... in all runs at once; linked rows that
    are in one tree already add nothing.
    """
    n = len(values)
    label = np.arange(n)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[new, n])
    left = np.repeat(new + sizes, sizes) - np.arange(n)  # rows from here to the end of the run
    rows, lag = np.flatnonzero(left > 1), 1
    while len(rows):
        near = rows[np.bitwise_count(values[rows] ^ values[rows + lag]) <= bits]
        near = near[label[near] != label[near + lag]]
        while len(near):
            a, b = label[near], label[near + lag]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, shorter := label[label]):
                label = shorter
            near = near[label[near] != label[near + lag]]
        lag += 1
        rows = rows[left[rows] > lag]
    return label


def near_links(prints: DataFrame, bits: int = 4, common: int = 3, chunk: int = _CHUNK) -> DataFrame:
    """``(u, v)``: a spanning forest, key by key, of fingerprints ``fp`` at most ``bits`` apart.

    ``prints`` holds each fingerprint once. No pair within ``bits`` is missed.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(bits, common)])
    keyed = prints.select("fp", F.posexplode(masks).alias("choice", "block"))
    counts = keyed.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1")
    # The planner takes the exploded rows for as few bytes as the stored fingerprints and would send them
    # all through the driver: both sides are sorted instead.
    shared = keyed.hint("merge").join(counts, ["choice", "block"])
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    # Every pair of chunks (i <= j) meets once.
    met = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")),
    )
    units = shared.select("fp", "choice", "block", F.explode(met).alias("m")).select(
        "fp", F.xxhash64("choice", "block", "m.i", "m.j").alias("unit"), "choice", "block", "m.i", "m.j"
    )
    order = ["unit", "choice", "block", "i", "j"]
    dealt = units.repartition(parts, "unit").sortWithinPartitions(*order, "fp")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: pa.Table) -> pa.RecordBatch:
            columns = {c: held[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ["fp", *order]}
            number = np.zeros(held.num_rows, dtype=np.int64)
            for c in order:
                number[1:] |= columns[c][1:] != columns[c][:-1]
            label = run_forest(np.cumsum(number), columns["fp"].view(np.uint64), bits)
            linked = np.flatnonzero(label != np.arange(len(label)))
            ends = {"u": columns["fp"][linked], "v": columns["fp"][label[linked]]}
            return pa.RecordBatch.from_arrays([pa.array(ends["u"]), pa.array(ends["v"])], names=["u", "v"])

        # A unit never has more than 2 * chunk rows or so; its rows are kept together over batches.
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 50_000:
                continue
            whole = pa.Table.from_batches(held)
            unit = whole["unit"].combine_chunks().to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(unit, unit[-1]))
            if cut:
                yield emit(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                rows = len(unit) - cut
        if held:
            whole = pa.Table.from_batches(held)
            if whole.num_rows:
                yield emit(whole)

    return dealt.mapInArrow(links, "u bigint, v bigint")


def components(prints: DataFrame, bits: int = 4) -> DataFrame:
    """``(fp, group)`` of linked fingerprints; fingerprints without a link are left out.

    ``prints`` is a stored table with each fingerprint ``fp`` once.
    """
    found = connected_components(near_links(prints, bits))
    return found.select(F.col("node").alias("fp"), F.col("component").alias("group"))


def _first_of_group(prints: DataFrame, bits: int) -> DataFrame:
    """``(fp, group, first)``, stored: of every fingerprint the least ``first`` of those that it is linked to.

    ``prints`` is a stored table with each fingerprint ``fp`` once and its least row ``first``.
    """
    labelled = prints.join(components(prints, bits), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    smallest = labelled.groupBy("group").agg(F.min("first").alias("first"))
    return materialize(labelled.select("fp", "group").join(smallest, "group"))


def near_duplicates(docs: DataFrame, bits: int = 4, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per document; component_id = smallest id reachable by links."""
    small_batches(docs.sparkSession)
    marked = materialize(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp")))
    prints = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = _first_of_group(prints, bits).select("fp", F.col("first").alias("component_id"))
    return marked.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, bits: int = 4, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group of linked fingerprints one row stays.

    It is a row with the smallest id; null ids come last, and of rows with equal ids the least digest of
    the whole row counts. All columns are kept as they are. Texts are read twice instead of stored again: the
    second time to find the rows by id and digest.
    """
    small_batches(docs.sparkSession)
    cells = [F.col(f"`{c}`") for c in docs.columns]
    # A digest skips nulls, so it takes which cells are null as well.
    digest = F.xxhash64(*cells, *[c.isNull() for c in cells])
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"))
    marked = materialize(docs.select(key.alias("key"), fingerprint(F.col("text"), size).alias("fp")))
    prints = materialize(marked.groupBy("fp").agg(F.min("key").alias("first")))
    firsts = materialize(_first_of_group(prints, bits).select("first.*").distinct())
    # Rows that are equal in every cell have one key: one of them stays.
    times = marked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key.*")
    repeated = materialize(times.join(firsts, [times["digest"] == firsts["digest"], times["id"].eqNullSafe(firsts["id"])], "left_semi"))
    rows = docs.select(F.struct(*cells).alias("doc"), F.col("doc_id").alias("id"), digest.alias("digest"))

    def among(some: DataFrame, found: DataFrame, how: str) -> DataFrame:
        return some.join(found, [some["digest"] == found["digest"], some["id"].eqNullSafe(found["id"])], how)

    kept = among(rows, firsts, "left_semi")
    once = among(kept, repeated, "left_anti")
    again = among(kept, repeated, "left_semi").dropDuplicates(["id", "digest"])
    return once.unionByName(again).select("doc.*")
