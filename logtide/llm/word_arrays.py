"""Words of Arrow texts, split on bytes by NumPy, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_bytes(gaps: str) -> np.ndarray:
    """Which of the 256 byte values belong to words, where just the ASCII characters of ``gaps`` separate words."""
    table = np.ones(256, bool)
    table[list(gaps.encode("ascii"))] = False
    return table


#: ASCII letters of both cases mapped to lower case, all other bytes to themselves.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def split_words(texts: pa.Array, is_word: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(all words behind one another, number of words of each text); a null text has none.

    Bytes from 0x80 on belong to multi-byte characters and are told by ``is_word`` like any other, so that the text
    is never decoded.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    bounds = ends - ends[0]
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[firsts] = inside[firsts]
    counts = np.diff(np.searchsorted(np.flatnonzero(begins), bounds))
    letters = data[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    letters = LOWER[letters] if lower else letters
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), counts


def chunks(batch: pa.RecordBatch, column: int, max_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``max_bytes`` of text each, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.concatenate([[0], np.cumsum(sizes)]), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + max_bytes, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers are reused, and what they keep would add
    to what the next stage needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
