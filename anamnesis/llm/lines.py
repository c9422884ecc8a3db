"""Texts of an Arrow batch as bytes: vectorised helpers that the operators on words and chunks share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
AT_ONCE = 12 << 20


def portions(column: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Borders of runs of rows with about ``most`` bytes of text each."""
    sizes = np.cumsum(np.array(pc.binary_length(column.cast(pa.large_binary())).fill_null(0), np.int64))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield at, end
        at = end


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and the offset of each text (one more than there are texts); null counts as empty."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches [start, end) of UTF-8 bytes, which don't overlap and are in order, as strings."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    np.subtract.at(inside, end, 1)
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept)))


def glued(*columns: pa.Array, by: str) -> pa.Array:
    """Columns of strings put together row by row; null counts as empty."""
    wide = [pc.fill_null(c.cast(pa.large_string()), "") if isinstance(c, pa.Array) else c for c in columns]
    return pc.binary_join_element_wise(*wide, pa.scalar(by, pa.large_string()))
