"""Token ids of documents as Simple-8b files, and back.

A 64-bit word holds a 4-bit selector and 60 bits of payload: as many ids, all of one width,
as fit. Ids are taken in blocks of 256; each block begins a new word, and a file row has the
word and escape offset of every block, so all blocks of a row are packed and unpacked at
once in numpy. Runs of zeros have selectors without payload, and an id wider than
60 bits is an escape: its selector stands for one value in a separate list.

The file format is a Parquet folder. A row is a run of documents: ``part`` (file order), ``first``
(ids before it in its part), ``doc_ids``, ``doc_lengths``, ``n_ids``, and, little-endian, ``words`` (uint64),
``word_offsets`` and ``escape_offsets`` (uint32 per block) and ``escapes`` (uint64).

Edge cases: a null or empty text is the end id alone. Rows with equal ids are ordered by text and all
kept; null ids come first. An empty table gives no rows. Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import share, shared, small_batches
from twinfold.llm.tokens import Tokens, blocks
from twinfold.session import shared_folder

BLOCK = 256

# Ids per word and bits per id of each selector. Selector 0 is the escape.
COUNTS = np.array([1, 240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2])
WIDTHS = np.array([64, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30])
_MOST = 60  # ids in a word that has payload

_RUN = 1_000_000  # bytes of text per file row


def _window_max(widths: np.ndarray, count: int) -> np.ndarray:
    """Per position the largest of ``count`` widths from there on; zeros follow a block's end."""
    best, have = widths, 1
    while have < count:
        step = min(have, count - have)
        moved = np.zeros_like(best)
        moved[:, : best.shape[1] - step] = best[:, step:]
        best = np.maximum(best, moved)
        have += step
    return best


_SMALL = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    widths = _SMALL[(values & values.dtype.type(0xFFFF)).astype(np.uint16)]
    for shift in range(16, 8 * values.dtype.itemsize, 16):
        part = values >> values.dtype.type(shift)
        if not part.any():
            break
        own = _SMALL[(part & values.dtype.type(0xFFFF)).astype(np.uint16)]
        widths = np.where(own > 0, own + np.uint8(shift), widths)
    return widths


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(words, word_offsets, escape_offsets, escapes)`` of ids below 2^64."""
    n_blocks = -(-len(ids) // BLOCK)
    # Zeros follow every block, so that a word that passes its end holds padding.
    wide = np.uint32 if not len(ids) or int(ids.max()) < 1 << 32 else np.uint64
    grid = np.zeros((n_blocks, BLOCK + _MOST), dtype=wide)
    full = len(ids) // BLOCK
    grid[:full, :BLOCK] = ids[: full * BLOCK].reshape(-1, BLOCK)
    grid[full:, : len(ids) - full * BLOCK] = ids[full * BLOCK :]
    widths = _widths(grid[:, :BLOCK])
    # The selector of each position: the one with most ids whose width suffices.
    choice = np.zeros(widths.shape, dtype=np.uint8)
    for selector in range(len(COUNTS) - 1, 0, -1):
        fits = _window_max(widths, int(COUNTS[selector])) <= WIDTHS[selector]
        if not fits.any():
            break
        np.copyto(choice, np.uint8(selector), where=fits)
    # All blocks go on from word to word together.
    taken = np.zeros(choice.size, dtype=bool)
    rows = np.arange(n_blocks) * BLOCK
    at, ends, picks = rows.copy(), rows + BLOCK, choice.ravel()
    while len(at):
        taken[at] = True
        at = at + COUNTS[picks[at]]
        going = at < ends
        at, ends = at[going], ends[going]
    begin = np.flatnonzero(taken)
    selectors = picks[begin]
    words = selectors.astype(np.uint64) << np.uint64(60)
    flat, place = grid.ravel(), begin + begin // BLOCK * _MOST
    for selector in range(3, len(COUNTS)):
        chosen = np.flatnonzero(selectors == selector)
        if len(chosen):
            first, payload = place[chosen], np.zeros(len(chosen), dtype=np.uint64)
            for i in range(COUNTS[selector]):
                payload |= flat[first + i].astype(np.uint64) << np.uint64(i * WIDTHS[selector])
            words[chosen] |= payload
    block_of = begin // BLOCK
    escaped = selectors == 0
    per_block = np.bincount(block_of, minlength=n_blocks)
    escapes_per_block = np.bincount(block_of[escaped], minlength=n_blocks)
    return (
        words,
        (np.cumsum(per_block) - per_block).astype(np.uint32),
        (np.cumsum(escapes_per_block) - escapes_per_block).astype(np.uint32),
        flat[place[escaped]].astype(np.uint64),
    )


def unpack(
    words: np.ndarray, word_offsets: np.ndarray, escape_offsets: np.ndarray, escapes: np.ndarray, n_ids: int
) -> np.ndarray:
    """The ids, from words of any set of whole blocks; the last block may be partial."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    # Within a block a word's first id follows the ids of the words before it.
    before = np.cumsum(counts) - counts
    block_of = np.searchsorted(word_offsets, np.arange(len(words)), side="right") - 1
    begin = before - before[word_offsets.astype(np.int64)][block_of] + block_of * BLOCK
    out = np.zeros((len(word_offsets) + 1) * BLOCK, dtype=np.uint64)
    for selector in range(3, len(COUNTS)):
        chosen = np.flatnonzero(selectors == selector)
        if len(chosen):
            mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
            for i in range(COUNTS[selector]):
                # What a word holds past the end of its block is padding.
                inside = chosen[begin[chosen] % BLOCK + i < BLOCK]
                out[begin[inside] + i] = (words[inside] >> np.uint64(i * WIDTHS[selector])) & mask
    escaped = np.flatnonzero(selectors == 0)
    if len(escaped):
        number = np.arange(len(escaped))
        first = np.searchsorted(block_of[escaped], block_of[escaped])
        out[begin[escaped]] = escapes[escape_offsets.astype(np.int64)[block_of[escaped]] + number - first]
    return out[:n_ids]


FILE_SCHEMA = (
    "part int, first long, doc_ids array<long>, doc_lengths array<long>, n_ids long, words binary, "
    "word_offsets binary, escape_offsets binary, escapes binary"
)


def write_ids(docs: DataFrame, path: str, end: int, folder: str | None = None) -> str:
    """Write the ids of every text in ascending id order; returns the folder of the files.

    ``path`` is the tokenizer's file, read where the plan is made.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or f"{shared_folder(spark)}/twinfold/ids-{uuid.uuid4().hex}"
    sent = share(spark, Tokens(path))
    text = F.coalesce(F.col("text"), F.lit(""))
    # The hash deals out rows that share one id; it never changes the order of different ids.
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
        .repartitionByRange(parts, "doc_id", "_h")
        .sortWithinPartitions("doc_id", "_h", "text")
        .select("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for at, ids, lengths in blocks(shared(sent), texts, end, _RUN):
                packed = pack(ids)
                row = [
                    pa.array([part], type=pa.int32()),
                    pa.array([first], type=pa.int64()),
                    pa.array([batch.column("doc_id").slice(at, len(lengths)).to_pylist()], type=pa.list_(pa.int64())),
                    pa.array([lengths], type=pa.list_(pa.int64())),
                    pa.array([len(ids)], type=pa.int64()),
                    *[pa.array([p.astype(p.dtype.newbyteorder("<")).tobytes()], type=pa.binary()) for p in packed],
                ]
                first += len(ids)
                yield pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

    ordered.mapInArrow(encode, FILE_SCHEMA).write.parquet(folder)
    return folder


def read_ids(spark, folder: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the files in ``folder``; with ``digest`` the crc32 of the ids in place of the ids."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per file part.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    last = "ids_crc32 long" if digest else "ids binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                arrays = [np.frombuffer(row[c], dtype=t) for c, t in (("words", "<u8"), ("word_offsets", "<u4"), ("escape_offsets", "<u4"), ("escapes", "<u8"))]
                ids = unpack(*arrays, row["n_ids"]).astype("<u4")
                lengths = np.array(row["doc_lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                found = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                final = pa.array(map(zlib.crc32, found), type=pa.int64()) if digest else pa.array(found, type=pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], type=pa.int64()), pa.array(row["base"] + row["first"] + ends - lengths), pa.array(lengths), final],
                    names=["doc_id", "start", "n_tokens", last.split()[0]],
                )

    return rows.join(F.broadcast(bases), "part").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last}")
