"""Packing documents into sequences by a grouping genetic algorithm on islands.

A document's ids, with the end id, are one piece, or, if longer than a sequence, whole
pieces of sequence length and a first piece with what is left. Whole pieces are sequences. The others
are dealt out evenly into shards of a bounded number of pieces. Each shard is packed on several
islands: an individual is a grouping of pieces into bins; crossover injects whole well-filled
bins of one parent into another, removes the bins that hold a piece twice, and puts displaced
pieces where they fit best. Between rounds each island's elite moves to the next island of its
shard. The best grouping of all islands is the shard's result. The first individual is
best fit by falling length, so the result never has more sequences than that.

A shard costs at most about one sequence that could be fuller; shards are packed in
parallel, and no task holds more than a shard.

Edge cases: a null or empty text is one piece that holds the end id. Rows with equal ids are
packed as separate documents. An empty table gives no rows. Only ``doc_id`` and ``text`` are read; other
columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import share, shared, small_batches
from twinfold.llm.tokens import Tokens, blocks
from twinfold.session import materialize

SHARD = 16_384  # pieces packed together
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2, 2, 4, 4
WELL_FILLED = 0.98

_RUN = 1_000_000  # bytes of text encoded at a time


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter than ``capacity``."""
    first = total % capacity or capacity
    starts = [0, *range(first, total, capacity)]
    return list(zip(starts, [first] + [capacity] * (len(starts) - 1)))


def pieces(docs: DataFrame, path: str, end: int, capacity: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; ``path`` is the tokenizer's file, read where the plan is made."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = share(spark, Tokens(path))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            doc_ids = batch.column("doc_id").to_pylist()
            rows = []
            for at, ids, lengths in blocks(shared(sent), texts, end, _RUN):
                ids, begin = ids.astype("<u4"), 0
                for k, total in enumerate(lengths.tolist()):
                    for number, (start, length) in enumerate(cut(total, capacity)):
                        piece = ids[begin + start : begin + start + length]
                        rows.append((doc_ids[at + k], number, start, length, zlib.crc32(piece)))
                    begin += total
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*rows), types)],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(count, schema)


class Bins:
    """Bins under construction; finds the fullest bin with room by one look at a bit mask."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, items: list[int], room: int) -> None:
        self._file(len(self.items), room)
        self.items.append(items)
        self.room.append(room)

    def _file(self, number: int, room: int) -> None:
        self.by_room[room].append(number)
        self.mask |= 1 << room

    def best_fit(self, item: int, length: int) -> None:
        open_bins = self.mask >> length
        if not open_bins:
            self.add([item], self.capacity - length)
            return
        room = length + (open_bins & -open_bins).bit_length() - 1
        number = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.items[number].append(item)
        self.room[number] = room - length
        self._file(number, room - length)


def best_fit_all(lengths: list[int], order, capacity: int, start: Bins | None = None) -> Bins:
    bins = start or Bins(capacity)
    for item in order:
        bins.best_fit(item, lengths[item])
    return bins


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer bins are better; then fuller ones."""
    fill = 1 - np.array(bins.room) / bins.capacity
    return -len(bins.items), float((fill**2).mean()) if len(fill) else 0.0


def crossover(one: Bins, other: Bins, lengths: list[int], random: np.random.Generator) -> Bins:
    """Half of ``other``'s well-filled bins, ``one``'s bins without pieces of those, the rest by best fit."""
    capacity, limit = one.capacity, int((1 - WELL_FILLED) * one.capacity)
    filled = [i for i, room in enumerate(other.room) if room <= limit]
    taken = random.permutation(len(filled))[: (len(filled) + 1) // 2].tolist()
    child, inside, displaced = Bins(capacity), np.zeros(len(lengths), dtype=bool), []
    for i in taken:
        child.add(list(other.items[filled[i]]), other.room[filled[i]])
        inside[other.items[filled[i]]] = True
    for items, room in zip(one.items, one.room):
        twice = inside[items]
        if not twice.any() and room <= limit:
            child.add(list(items), room)
        else:
            # Badly filled bins are given up too, so that their pieces find better places.
            displaced += [i for i, there in zip(items, twice.tolist()) if not there]
    displaced.sort(key=lengths.__getitem__, reverse=True)
    return best_fit_all(lengths, displaced, capacity, child)


def genome(bins: Bins, n: int) -> np.ndarray:
    """The bin of each piece."""
    out = np.empty(n, dtype=np.int32)
    for number, items in enumerate(bins.items):
        out[items] = number
    return out


def from_genome(groups: np.ndarray, lengths: list[int], capacity: int) -> Bins:
    bins, order = Bins(capacity), np.argsort(groups, kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1) if len(order) else []:
        items = items.tolist()
        bins.add(items, capacity - sum(lengths[i] for i in items))
    return bins


def evolve(lengths: list[int], elites: list[np.ndarray], capacity: int, seed: int) -> np.ndarray:
    """The best grouping after some generations that begin with ``elites`` and new individuals."""
    random = np.random.default_rng(seed)
    n, least = len(lengths), -(-sum(lengths) // capacity)
    falling = sorted(range(n), key=lengths.__getitem__, reverse=True)
    people = [from_genome(e, lengths, capacity) for e in elites] or [best_fit_all(lengths, falling, capacity)]
    while len(people) < POPULATION and max(map(fitness, people))[0] < -least:
        # Large pieces by falling length, the small ones in any order.
        some = int(n * random.uniform(0.5, 1))
        order = falling[:some] + [falling[i] for i in some + random.permutation(n - some)]
        people.append(best_fit_all(lengths, order, capacity))
    for _ in range(GENERATIONS):
        people.sort(key=fitness, reverse=True)
        if fitness(people[0])[0] >= -least or len(people) < 2:
            break
        children = [crossover(people[i], people[j], lengths, random) for i, j in ((0, 1), (1, 0), (0, len(people) - 1))]
        people = sorted(people + children, key=fitness, reverse=True)[:POPULATION]
    return genome(max(people, key=fitness), n)


def pack(items: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; ``items`` is a stored table with a unique ``_item`` and ``length``."""
    spark = items.sparkSession
    whole = items.where(F.col("length") >= capacity)
    rest = items.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard))
    dealt = materialize(
        rest.withColumn("_shard", F.pmod(F.xxhash64("_item"), F.lit(shards)).cast("int"))
        .groupBy("_shard")
        .agg(F.sort_array(F.collect_list(F.struct("length", *[c for c in items.columns if c != "length"]))).alias("_pieces"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lengths = dealt.select(
        F.col("_shard").alias("shard"), F.col("_pieces.length").alias("lengths"),
        F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
    )
    schema = "shard int, island int, groups binary, bins int, fill double"

    def live(round_number: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for shard_id, island, sizes, elites in zip(frame["shard"], frame["island"], frame["lengths"], frame["elites"]):
                    sizes = [int(x) for x in sizes]
                    seeds = [np.frombuffer(e, dtype="<i4") for e in elites]
                    seed = (int(shard_id) * ISLANDS + int(island)) * ROUNDS + round_number
                    best = evolve(sizes, seeds, capacity, seed)
                    bins = fitness(from_genome(best, sizes, capacity))
                    rows.append((shard_id, island, best.astype("<i4").tobytes(), -bins[0], bins[1]))
                yield pd.DataFrame(rows, columns=["shard", "island", "groups", "bins", "fill"])

        return run

    state = None
    for number in range(ROUNDS):
        if state is None:
            ready = lengths.withColumn("elites", F.array().cast("array<binary>"))
        else:
            # An island keeps its elite and gets the one of the island before it.
            moved = state.select("shard", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island"), "groups")
            elites = moved.groupBy("shard", "island").agg(F.collect_set("groups").alias("elites"))
            ready = lengths.join(elites, ["shard", "island"])
        ready = ready.repartition(parts, "shard", "island")
        state = materialize(ready.mapInPandas(live(number), schema))
    better = F.struct((-F.col("bins")).alias("bins"), "fill", "groups")
    best = state.groupBy("shard").agg(F.max(better).alias("best")).select(F.col("shard").alias("_shard"), "best.groups")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard_id, sizes, groups in zip(frame["_shard"], frame["lengths"], frame["groups"]):
                bins, sizes = np.frombuffer(groups, dtype="<i4"), np.array(sizes, dtype=np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.flatnonzero(np.r_[True, np.diff(bins[order]) != 0])
                base = np.repeat((ends - sizes[order])[first], np.diff(np.r_[first, len(order)]))
                offset = np.empty(len(order), dtype=np.int64)
                offset[order] = ends - sizes[order] - base
                yield pd.DataFrame({"_shard": [shard_id], "bins": [bins.tolist()], "offsets": [offset.tolist()]})

    placed = dealt.select("_shard", F.col("_pieces.length").alias("lengths")).join(best, "_shard").mapInPandas(
        place, "_shard int, bins array<long>, offsets array<long>"
    )
    row = F.explode(F.arrays_zip(F.col("_pieces").alias("p"), F.col("bins").alias("b"), F.col("offsets").alias("o")))
    packed = dealt.join(placed, "_shard").select("_shard", row.alias("r")).select(
        *[F.col(f"r.p.{c}").alias(c) for c in items.columns],
        (F.col("_shard").cast("long") * (1 << 32) + F.col("r.b")).alias("sequence_id"),
        F.col("r.o").alias("offset"),
    )
    alone = whole.select(*items.columns, (-1 - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece."""
    items = materialize(pieces(docs, path, end, capacity).withColumn("_item", F.monotonically_increasing_id()))
    return pack(items, capacity).drop("_item")
