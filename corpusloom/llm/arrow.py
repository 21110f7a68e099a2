"""Arrow batches in workers: small parts of them, and texts as numpy arrays without a copy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(b: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: at most ``rows`` rows, each ending with the row by which ``column`` passes ``size`` bytes.

    What a worker builds for a part is freed before the next, so its memory follows the
    largest of ``size`` and the longest text, not the batch.
    """
    total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < b.num_rows:
        high = min(low + rows, int(np.searchsorted(total, (total[low - 1] if low else 0) + size)) + 1, b.num_rows)
        yield b.slice(low, high - low)
        low = high


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and where each value starts in them, and the end; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar(b"" if pa.types.is_binary(texts.type) else "", texts.type))
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]
