"""Texts of Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PIECE_CHARS = 1 << 20


def text_pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of successive pieces; a piece has one text at least and about ``most`` characters."""
    start, held, size = 0, [], 0
    values = batch.column(batch.schema.get_field_index(column))
    for i in range(batch.num_rows):
        t = values[i].as_py()
        held.append(t)
        size += len(t or "")
        if size >= most:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held
