"""Arrow batches of texts: bounded slices, whole texts as bytes, words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice holds so many bytes of text, or a single longer text.
SLICE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for hashes of many words at once."""
    if len(_powers.get("up", ())) < length:
        size = max(length, (1 << 20) + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:length], _powers["down"][:length]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows, so that what is derived from a slice stays bounded.

    Workers outlive their tasks, so what the slices took is given back at the end.
    """
    try:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def raw_texts(array: pa.Array) -> list[bytes]:
    """Texts in UTF-8; null is the empty text."""
    return [b"" if t is None else t for t in array.cast(pa.binary()).to_pylist()]


def texts_of(array: pa.Array) -> list[str]:
    """Texts; null is the empty text."""
    return ["" if t is None else t for t in array.to_pylist()]


_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def single_blanks(text: bytes) -> bytes:
    """The words of a text with one blank between, as splitting and joining would give it."""
    line = text.translate(_SPACES).strip(b" ")
    while b"  " in line:
        line = line.replace(b"  ", b" ")
    return line


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, each followed by a blank, and where each starts (one more at the end)."""
    whole = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return whole, starts
