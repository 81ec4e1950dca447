"""Arrow batches in pieces, so that a Python worker holds few texts at a time, however many rows come at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: What is worked on at once. A row that is longer is a piece of its own.
PIECE_BYTES = 1 << 21


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in slices of up to ``most`` bytes; nothing is copied."""
    for batch in batches:
        open_ = [batch]
        while open_:
            part = open_.pop()
            n = part.num_rows
            if n > 1 and part.nbytes > most:
                open_ += [part.slice(n // 2), part.slice(0, n // 2)]
            elif n:
                yield part
