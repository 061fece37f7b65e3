"""Chat formatting by columnar byte assembly.

Turns are dealt over tasks by ranges of (conv_id, turn) and sorted there, so a conversation of any length may lie in
several tasks. For each stretch of turns a task computes the lengths of all segments (headers, roles, texts, footers),
their cumulative offsets and the places each source byte goes to, in numpy, and copies headers and contents into one
preallocated buffer, which becomes the data of an Arrow column as it is. No string is built for a turn.

A turn is `<s>[INST] role [/INST]text</s>`. In roles and texts a backslash goes before each backslash and behind the
first character of each control string, which is reversible and leaves no control string in them. The loss mask is a
flat list of byte offsets (start, end) of the texts of assistant turns within the part.

A conversation is one row, unless it is longer than PART_BYTES or touches the edge of a task: then it is several
parts, which follow each other by `part`. `read_back` reads the parts alone: turns by the marks, loss texts by the mask.
The digest of a whole conversation is one chain; parts of the few conversations that are in several are brought together
for it and read one after the other, so memory stays bounded there too.

Defined cases: a null role or text is empty; rows with a null conv_id are one conversation with a null id; a null turn
comes first; ties of (conv_id, turn) are ordered by the first 32 characters of the role, the first 64 of the text, then
by role and text, and repeated rows are all kept; an empty table gives no rows; texts of any length are whole; other
columns are unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gaugework.llm.common import claim

OPEN, MIDDLE, CLOSE = b"<s>[INST] ", b" [/INST]", b"</s>"
CONTROL = (b"<s>", b"</s>", b"[INST]", b"[/INST]")
LOSS_ROLE = b"assistant"
#: Bytes of a conversation from which it is cut into parts, and bytes of source that are assembled together.
PART_BYTES, SLICE_BYTES = 4_000_000, 4_000_000

_SLASH = 0x5C
PARTS = "part bigint, whole boolean, formatted binary, loss array<bigint>"


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and the offset of each value in them."""
    values = values.cast(pa.binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values with a backslash before each backslash and behind the first byte of each control string."""
    at = [np.flatnonzero(data == _SLASH)]
    for mark in CONTROL:
        found = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
        for k in range(1, len(mark)):
            found = found[data[found + k] == mark[k]]
        end = offsets[np.searchsorted(offsets, found, side="right")]  # of the value that the mark begins in
        at.append(found[found + len(mark) <= end] + 1)
    at = np.sort(np.concatenate(at))
    if not len(at):
        return data, offsets
    return np.insert(data, at, _SLASH), offsets + np.searchsorted(at, offsets, side="left")


def unescaped(value: bytes) -> bytes:
    """The value that was escaped: of two backslashes one stays, any other one goes."""
    if b"\\" not in value:
        return value
    data = np.frombuffer(value, dtype=np.uint8)
    slash = data == _SLASH
    at = np.arange(len(data))
    before = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte that is no backslash
    return data[~(slash & ((at - before) % 2 == 1))].tobytes()


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all turns in one buffer, offset of each turn and the end, start and end of each turn's text)."""
    parts = [escaped(*_bytes(roles)), escaped(*_bytes(texts))]
    sizes = [np.diff(o) for _, o in parts]
    turns = len(OPEN) + sizes[0] + len(MIDDLE) + sizes[1] + len(CLOSE)
    offsets = np.concatenate([[0], np.cumsum(turns)])
    out = np.empty(int(offsets[-1]), dtype=np.uint8)
    role_at = offsets[:-1] + len(OPEN)
    text_at = role_at + sizes[0] + len(MIDDLE)
    for mark, at in ((OPEN, offsets[:-1]), (MIDDLE, role_at + sizes[0]), (CLOSE, text_at + sizes[1])):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, dtype=np.uint8)
    for (data, begin), size, at in zip(parts, sizes, (role_at, text_at)):
        places = np.repeat(at - begin[:-1], size)
        places += np.arange(len(data))
        out[places] = data
    return out, offsets, text_at, text_at + sizes[1]


def _parts(rows: pa.RecordBatch, first: int, whole: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    """A row for each run of rows with one conv_id; runs: the first row of each, and the end."""
    data, offsets, text_from, text_to = assembled(rows.column(1), rows.column(2))
    ends = offsets[runs]
    formatted = pa.Array.from_buffers(pa.binary(), len(runs) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    masked = np.flatnonzero(pc.equal(rows.column(1), pa.scalar(LOSS_ROLE, rows.column(1).type)).to_numpy(zero_copy_only=False))
    run = np.searchsorted(runs, masked, side="right") - 1
    spans = np.stack([text_from[masked] - ends[run], text_to[masked] - ends[run]], axis=1).ravel()
    loss = pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(masked, runs), pa.int32()), pa.array(spans, pa.int64()))
    return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(runs[:-1])), pa.array(first + np.arange(len(runs) - 1)), pa.array(whole), formatted, loss], names=["conv_id", "part", "whole", "formatted", "loss"])


def _stretches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in stretches of about limit bytes."""
    for batch in batches:
        size = np.cumsum((pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) + pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _runs(ids: pa.Array) -> np.ndarray:
    if len(ids) == 1:
        return np.array([0, 1])
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    same = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.and_(a.is_null(), b.is_null()), pc.equal(a, b)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(~same) + 1, [len(ids)]])


def _format(batches: Iterator[pa.RecordBatch], part_bytes: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches: conv_id, role, text, sorted. The last conversation of a stretch is held back while it is short, so that
    only the first and the last one of a task, and long ones, are in parts."""
    from pyspark import TaskContext

    claim("chat_format")
    number = TaskContext.get().partitionId() << 33
    held: pa.RecordBatch | None = None
    cut = True  # whether the conversation that begins the next rows may have rows before them

    def close(rows: pa.RecordBatch, last_whole: bool) -> pa.RecordBatch:
        nonlocal number, cut
        runs = _runs(rows.column(0))
        whole = np.ones(len(runs) - 1, dtype=bool)
        whole[0] &= not cut
        whole[-1] &= last_whole
        out = _parts(rows, number, whole, runs)
        number, cut = number + len(runs) - 1, not last_whole
        return out

    for rows in _stretches(batches, slice_bytes):
        if held is not None:
            rows = pa.concat_batches([held, rows])
        runs = _runs(rows.column(0))
        tail = rows.slice(int(runs[-2]))
        if sum(pc.sum(pc.binary_length(tail.column(c))).as_py() for c in (1, 2)) >= part_bytes:
            yield close(rows, False)
            held = None
            continue
        if len(runs) > 2:
            yield close(rows.slice(0, int(runs[-2])), True)
        held = tail
    if held is not None:
        yield close(held, False)


def formatted(conversations: DataFrame, part_bytes: int = PART_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(conv_id, part, whole, formatted, loss): one shuffle, by ranges."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    heads = [F.substring("role", 1, 32), F.substring("text", 1, 64)]
    own = rows.repartitionByRange("conv_id", "turn", *heads).sortWithinPartitions("conv_id", "turn", *heads, "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    as_bytes = own.select("conv_id", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
    return as_bytes.mapInArrow(lambda it: _format(it, part_bytes, slice_bytes), f"conv_id {kind}, {PARTS}")


def turns(part: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn of a part, by its marks."""
    for turn in part.split(CLOSE)[:-1]:
        role, text = turn[len(OPEN) :].split(MIDDLE, 1)
        yield unescaped(role), unescaped(text)


class _Digest:
    """What is read of a conversation, part by part."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, part: bytes, loss: list[int]) -> None:
        self.chars += len(part.decode())
        for role, text in turns(part):
            self.n_turns += 1
            self.turns.update(b"%b\n%b\n" % (role, text))
        for a, b in zip(loss[::2], loss[1::2]):
            text = unescaped(part[a:b])
            self.loss_chars += len(text.decode())
            self.loss.update(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_RESULT = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations that are whole; parts of others are handed on."""
    for batch in batches:
        rows = []
        for whole, part, loss in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
            d = _Digest()
            if whole:
                d.add(part.as_py(), loss)
            rows.append(d.row() if whole else (None,) * len(_RESULT))
        whole = batch.column(2)
        left = [pc.if_else(whole, pa.scalar(None, batch.column(i).type), batch.column(i)) for i in (3,)]
        loss = pa.array([None if w else x for w, x in zip(whole.to_pylist(), batch.column(4).to_pylist())], batch.column(4).type)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *left, loss, *[pa.array(c, t) for c, (_, t) in zip(zip(*rows), _RESULT)]] if rows else [pa.array([], t) for t in [*[f.type for f in batch.schema], *[t for _, t in _RESULT]]], names=[*batch.schema.names, *[n for n, _ in _RESULT]])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of _read, sorted by conv_id and part; a digest at a time is open."""
    now, digest, any_open = None, _Digest(), False
    names = ["conv_id", *[n for n, _ in _RESULT]]

    def close(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], kind), *[pa.array([v], t) for v, (_, t) in zip(digest.row(), _RESULT)]], names=names)

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        done = batch.filter(batch.column(2))
        yield pa.RecordBatch.from_arrays([done.column(0), *[done.column(5 + i) for i in range(len(_RESULT))]], names=names)
        for i in np.flatnonzero(~batch.column(2).to_numpy(zero_copy_only=False)).tolist():
            conv = batch.column(0)[i].as_py()
            if not any_open or conv != now:
                if any_open:
                    yield close(kind)
                now, digest, any_open = conv, _Digest(), True
            digest.add(batch.column(3)[i].as_py(), batch.column(4)[i].as_py())
    if any_open:
        yield close(kind)


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id and DIGESTS of each conversation, from its parts. Only narrow rows and the parts of conversations that are
    in several are shuffled."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    read = parts.mapInArrow(_read, f"conv_id {kind}, {PARTS}, {DIGESTS}")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_joined, f"conv_id {kind}, {DIGESTS}")
