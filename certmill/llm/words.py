"""Words of Arrow text columns as one flat Arrow array, cut at ASCII bytes with numpy.

Every byte that cuts is ASCII, so no character of UTF-8 is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags; ranges hold both ends."""
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column with long offsets; null is empty."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")


def _offsets(texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of one text at least and about ``most`` bytes."""
    at, offsets = 0, _offsets(texts)
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def split_words(texts: pa.Array, cuts: np.ndarray, fold: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and the places at which each text's words begin, with the end added.

    ``cuts`` flags the bytes between words; ``fold`` replaces the bytes of words.
    """
    offsets = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~cuts[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    firsts, lasts = offsets[:-1], offsets[1:] - 1
    firsts, lasts = firsts[firsts < len(data)], lasts[lasts >= 0]
    begin[firsts], end[lasts] = inside[firsts], inside[lasts]
    starts = np.flatnonzero(begin)
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(end) + 1 - starts, out=ends[1:])
    held = data[inside] if fold is None else fold[data[inside]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(held)])
    return words, np.searchsorted(starts, offsets)
