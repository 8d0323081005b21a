"""Texts of an Arrow batch as numpy byte arrays, in chunks of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; NULL is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of whole texts of about ``limit`` bytes, more only for a longer text."""
    if not len(column):
        return
    offsets, data = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def trimmed(made: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of a task's batches, which gives the memory it freed back when it ends.

    Python workers outlive their tasks, and the allocators keep freed memory for themselves.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from made(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64."""
    made = np.full(count, base, np.uint64)
    made[:1] = 1
    return np.multiply.accumulate(made)
