"""Cutting Arrow columns of texts into words on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ALL_BYTES = np.arange(256, dtype=np.uint8)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text begins and the last ends. No text may be null."""
    _, ends, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(ends, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def cut_words(texts: pa.Array, is_word: np.ndarray, form: np.ndarray = ALL_BYTES) -> tuple[pa.Array, np.ndarray]:
    """All words in a row, and how many each text has.

    A word is a longest run of bytes for which ``is_word`` holds, inside one text; ``form`` says what
    each byte becomes. The table must treat all bytes beyond ASCII alike, so that letters stay whole.
    """
    data, at = text_bytes(texts)
    mask = is_word[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    heads = at[:-1][np.diff(at) > 0]
    first[heads] = mask[heads]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), at))
    kept = form[data[mask]]
    starts = np.append(np.flatnonzero(first[mask]), len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(kept)])
    return words, counts


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
