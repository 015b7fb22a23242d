r"""Chat formatting by columnar byte assembly.

A turn becomes `<s>[ROLE]role[/ROLE]text</s>`; a formatted conversation is its turns' segments in order of
turn. Control strings begin with `<` or `[`; in roles and texts these two and the backslash get a backslash
before them, so no text can contain a control string and removing one backslash gives the text back.

Segments of a whole Arrow batch are assembled in one preallocated buffer: segment lengths, cumulative
offsets and scatter indices are numpy arrays. Turns are formatted where they lie, before any shuffle; then
one sort by (conversation, turn) brings segments together, and conversations are read or written as a
stream, so a conversation of any length needs the memory of one batch.

Defined cases: null text and null role count as empty; a null conv_id is a conversation of its own; null
turns come first; equal turns are ordered by their segment; repeated rows are turns of their own. An empty
table gives an empty result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = b"<s>[ROLE]", b"[/ROLE]", b"</s>"
LOSS_ROLE = "assistant"
CHUNK_CHARS = 1 << 20
_TURN = re.compile(r"<s>\[ROLE\]((?:[^\\<\[]|\\.)*)\[/ROLE\]((?:[^\\<\[]|\\.)*)</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def _column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string column, nulls empty."""
    values = (pa.concat_arrays([values]) if values.offset else values).fill_null("").cast(pa.large_string())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(values) + 1 + values.offset)[values.offset :] if len(values) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def escape_column(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mark = (data == ord("\\")) | (data == ord("<")) | (data == ord("["))
    shift = np.concatenate([[0], np.cumsum(mark)])
    out = np.empty(len(data) + int(shift[-1]), dtype=np.uint8)
    to = np.arange(len(data)) + shift[1:]
    out[to] = data
    out[to[mark] - 1] = ord("\\")
    return offsets + shift[offsets], out


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Segments, and in code points their length and where their escaped text starts and ends."""
    n = len(texts)
    columns = [escape_column(*_column(roles)), escape_column(*_column(texts))]
    lengths = [np.diff(o) for o, _ in columns]
    starts = np.concatenate([[0], np.cumsum(lengths[0] + lengths[1] + len(HEAD) + len(MIDDLE) + len(TAIL))]).astype(np.int64)
    buffer = np.empty(int(starts[-1]), dtype=np.uint8)

    def fixed(at: np.ndarray, value: bytes) -> np.ndarray:
        buffer[(at[:, None] + np.arange(len(value))).ravel()] = np.tile(np.frombuffer(value, dtype=np.uint8), n)
        return at + len(value)

    def varying(at: np.ndarray, k: int) -> np.ndarray:
        offsets, data = columns[k]
        buffer[np.arange(len(data)) + np.repeat(at - offsets[:-1], lengths[k])] = data
        return at + lengths[k]

    content = fixed(varying(fixed(starts[:-1], HEAD), 0), MIDDLE)
    end = varying(content, 1)
    fixed(end, TAIL)
    points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
    segments = pa.LargeStringArray.from_buffers(n, pa.py_buffer(starts), pa.py_buffer(buffer)).cast(pa.string())
    origin = points[starts[:-1]]
    return segments, points[starts[1:]] - origin, points[content] - origin, points[end] - origin


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        segments, chars, start, end = assemble(batch["role"], batch["text"])
        quiet = np.array([r != LOSS_ROLE for r in batch["role"].to_pylist()], dtype=bool)
        columns = [batch["conv_id"], batch["turn"], segments, pa.array(chars, pa.int64()), pa.array(start, pa.int64(), mask=quiet), pa.array(end, pa.int64(), mask=quiet)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "segment", "chars", "loss_start", "loss_end"])


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, segment, chars, and the loss span in code points of the segment (null: none)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(_format, "conv_id long, turn long, segment string, chars long, loss_start long, loss_end long")


def _in_order(segments: DataFrame) -> DataFrame:
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")


def _chunks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, number, "".join(parts), spans), kinds, strict=True)], names=["conv_id", "chunk", "formatted", "loss_spans"])

        conv, number, parts, spans, size = None, -1, [], [], 0
        for batch in batches:
            for c, segment, chars, start, end in zip(*(batch[k].to_pylist() for k in ("conv_id", "segment", "chars", "loss_start", "loss_end")), strict=True):
                if number < 0 or c != conv or size + chars > limit:
                    if parts:
                        yield row()
                    conv, number, parts, spans, size = c, (number + 1 if number >= 0 and c == conv else 0), [], [], 0
                parts.append(segment)
                if start is not None:
                    spans.append([size + start, size + end])
                size += chars
        if parts:
            yield row()

    return run


def format_conversations(turns: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id, chunk, formatted, loss_spans (code points of the chunk); one chunk unless a conversation is longer."""
    schema = "conv_id long, chunk int, formatted string, loss_spans array<array<long>>"
    return _in_order(format_turns(turns)).mapInArrow(_chunks(chunk_chars), schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row() -> tuple:
        return conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), formatted

    conv, n = None, 0
    for batch in batches:
        rows = []
        for c, text, spans in zip(*(batch[k].to_pylist() for k in ("conv_id", "formatted", "loss_spans")), strict=True):
            if not n or c != conv:
                if n:
                    rows.append(row())
                conv, n, whole, loss, loss_chars, formatted = c, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            at = 0
            for m in _TURN.finditer(text):
                if m.start() != at:
                    raise ValueError(f"conversation {c}: not a turn at {at}")
                at = m.end()
                n += 1
                whole.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            if at != len(text):
                raise ValueError(f"conversation {c}: not a turn at {at}")
            for start, end in spans:
                said = unescape(text[start:end])
                loss.update(said.encode("utf-8", "surrogatepass"))
                loss_chars += len(said)
            formatted += len(text)
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_DIGEST)
    if n:
        yield pa.RecordBatch.from_pylist([dict(zip(names, row(), strict=True))], schema=_DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from format_conversations' chunks, which lie in order in their partitions."""
    return formatted.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
