"""Texts as the bytes that Arrow holds: no Python strings, whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: UTF-8 bytes of text that are worked on in one go; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000
#: True for the bytes that count as white space.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a text column; null is empty."""
    filled = column.cast(pa.large_string()).fill_null("")
    _, at, data = filled.buffers()
    if not len(filled) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most so many bytes of text, or one row, each with the bytes and offsets of its texts."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(name))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes and offsets as a text column, without a copy."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The longest runs of bytes for which ``inside`` holds, none across texts: (the runs as texts, the text of each)."""
    held = inside[data]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    filled = offsets[1:] > offsets[:-1]
    starts, ends = offsets[:-1][filled], offsets[1:][filled] - 1
    first[starts], last[ends] = held[starts], held[ends]
    begin = np.flatnonzero(first)
    at = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - begin)])
    return text_array(data[held], at), np.searchsorted(offsets, begin, "right") - 1


def hashes(words: pa.Array, salt: int = 0) -> np.ndarray:
    """64-bit hashes of texts; other salts make other collisions."""
    _, at, data = words.buffers()
    offsets = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(offsets)
    out = size.astype(np.uint64)
    filled = np.flatnonzero(size)
    if len(filled):
        own = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
        starts = offsets[filled] - offsets[0]
        powers = np.cumprod(np.full(int(size.max()), (0x9E3779B97F4A7C15 + 2 * salt) & 0xFFFFFFFFFFFFFFFF, np.uint64))
        out[filled] += np.add.reduceat(own * powers[np.arange(len(own)) - np.repeat(starts, size[filled])], starts)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)
