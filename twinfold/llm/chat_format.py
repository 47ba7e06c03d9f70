"""Chat formatting by columnar byte assembly.

A batch of turns becomes one list of byte segments: marks, roles and texts. Segment lengths
give output offsets by a running sum; a scatter index copies all segments from the source
buffers into one preallocated buffer, which becomes the Arrow column as it is. The loss
mask of a row is a list of spans in code points of the formatted text, one per assistant turn.

A turn is ``<s>[INST] role [/INST]text</s>``. Inside roles and texts a control string gets one
backslash after its first character, and one more where it has some already, so that no
control string is ever inside and the escape can be taken back.

Edge cases: turns of a conversation are ordered by turn, then role, then text; nulls first. A null
role or text is empty. Rows with equal keys are all kept. A null conv_id is one
conversation. An empty table gives an empty result. Only ``conv_id``, ``turn``, ``role`` and
``text`` are read; other columns may have any name. A conversation that is longer than an Arrow batch goes on in further
rows (``part`` 0, 1, ...), so no task holds a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import small_batches

# The template. HEAD role SEP text END.
HEAD, SEP, END = "<s>[INST] ", " [/INST]", "</s>"

_ESCAPE = r"([<\[])(\\*(?:/?s>|/?INST\]))"
_UNESCAPE = r"([<\[])\\(\\*(?:/?s>|/?INST\]))"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2")


def unescape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _UNESCAPE, r"\1\2")


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, the byte offset of each turn, and of each turn's text."""
    n = len(roles)
    marks = np.frombuffer((HEAD + SEP + END).encode(), dtype=np.uint8)
    role_bytes, role_at = _bytes_of(escape(roles))
    text_bytes, text_at = _bytes_of(escape(texts))
    source = np.concatenate([marks, role_bytes, text_bytes])
    starts = np.empty((n, 5), dtype=np.int64)
    lengths = np.empty((n, 5), dtype=np.int64)
    starts[:, 0], lengths[:, 0] = 0, len(HEAD)
    starts[:, 1], lengths[:, 1] = len(marks) + role_at[:-1], np.diff(role_at)
    starts[:, 2], lengths[:, 2] = len(HEAD), len(SEP)
    starts[:, 3], lengths[:, 3] = len(marks) + len(role_bytes) + text_at[:-1], np.diff(text_at)
    starts[:, 4], lengths[:, 4] = len(HEAD) + len(SEP), len(END)
    out_at = np.zeros(5 * n + 1, dtype=np.int64)
    np.cumsum(lengths.ravel(), out=out_at[1:])
    index = np.arange(out_at[-1]) + np.repeat(starts.ravel() - out_at[:-1], lengths.ravel())
    out = np.empty(out_at[-1], dtype=np.uint8)
    np.take(source, index, out=out)
    return out, out_at[::5], np.stack([out_at[3:-1:5], out_at[4::5]])


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, part, formatted, loss)``; ``loss`` lists the ``start`` and ``length`` of assistant texts."""
    spark = turns.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").alias("role"), F.col("text").alias("text"))
        .repartition(parts, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    schema = "conv_id long, part int, formatted string, loss array<struct<start:long,length:long>>"

    def layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = "none yet", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            roles = batch.column("role").cast(pa.string()).fill_null("")
            texts = batch.column("text").cast(pa.string()).fill_null("")
            out, turn_at, text_at = assemble(roles, texts)
            ids = batch.column("conv_id").to_pylist()
            first = np.array([0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], dtype=np.int64)
            row_at = np.r_[turn_at[first], turn_at[-1]]
            # Code points before each byte: every byte but the continuation bytes of UTF-8 begins one.
            points = np.zeros(len(out) + 1, dtype=np.int64)
            np.cumsum((out & 0xC0) != 0x80, out=points[1:])
            row_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
            masked = np.flatnonzero(pc.equal(roles, "assistant").to_numpy(zero_copy_only=False))
            begin, end = points[text_at[0, masked]], points[text_at[1, masked]]
            spans = pa.StructArray.from_arrays(
                [pa.array(begin - points[row_at[row_of[masked]]]), pa.array(end - begin)], names=["start", "length"]
            )
            counts = np.bincount(row_of[masked], minlength=len(first))
            loss = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], type=pa.int32()), spans)
            formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(row_at.astype(np.int64)), pa.py_buffer(out))
            numbers = []
            for at in first:
                part = part + 1 if ids[at] == last else 0
                last = ids[at]
                numbers.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id").take(pa.array(first)), pa.array(numbers, type=pa.int32()), formatted.cast(pa.string()), loss],
                names=["conv_id", "part", "formatted", "loss"],
            )

    return ordered.mapInArrow(layout, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: role and text as they were."""
    pieces = [turn[len(HEAD) :].split(SEP, 1) for turn in formatted.split(END)[:-1]]
    roles = unescape(pa.array([p[0] for p in pieces], type=pa.string()))
    texts = unescape(pa.array([p[1] for p in pieces], type=pa.string()))
    return list(zip(roles.to_pylist(), texts.to_pylist()))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: turns, digest of the turns, and digest and size of the text under the loss mask.

    ``formatted`` has the columns of :func:`format_conversations`.
    """
    spark = formatted.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part")
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    names = [c.strip().split()[0] for c in schema.split(",")]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One conversation is open at a time; only its running digests are kept.
        state: list | None = None

        def rows(done: list[list]) -> pa.RecordBatch:
            final = [[s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]] for s in done]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*final), types)], names=names)

        for batch in batches:
            done = []
            for conv_id, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        done.append(state)
                    state = [conv_id, 0, sha256(), 0, sha256(), 0]
                turns = parse(text)
                state[1] += len(turns)
                state[2].update("".join(f"{role}\n{said}\n" for role, said in turns).encode())
                masked = [text[s["start"] : s["start"] + s["length"]] for s in loss]
                under = "".join(unescape(pa.array(masked, type=pa.string())).to_pylist())
                state[3] += len(under)
                state[4].update(under.encode())
                state[5] += len(text)
            if done:
                yield rows(done)
        if state is not None:
            yield rows([state])

    return ordered.mapInArrow(digests, schema)
