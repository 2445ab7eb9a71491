"""Words of whole Arrow columns of texts, found in numpy over their UTF-8 bytes and numbered by a dictionary.

A column is taken in chunks of about ``CHUNK`` bytes, whatever the length of its texts: chunks end between texts or, inside a
text longer than a chunk, between two of its words, so memory is bounded by the chunk (and by the longest single word).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 4 << 20


def alphabet(digits: bool) -> np.ndarray:
    """By byte: 0 for what separates words, else the byte in lower case. Letters A-Z and a-z and all bytes from 128 on (which
    are those of characters from U+0080 on) make words, digits where asked."""
    out = np.zeros(256, np.uint8)
    out[128:] = np.arange(128, 256)
    out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    if digits:
        out[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return out


@dataclass
class Chunk:
    """The words of a chunk: ``rows`` and ``ids`` of each in order, ``words`` by id, and whether the first and last row go on
    from the chunk before and into the next."""

    rows: np.ndarray
    ids: np.ndarray
    words: pa.Array
    goes_on: bool
    unfinished: bool


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 texts, bytes) of a column; nulls are empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column: pa.Array, letters: np.ndarray, size: int = CHUNK) -> Iterator[Chunk]:
    """The column's words, a chunk at a time."""
    at, data = layout(column)
    lo, end, goes_on = int(at[0]), int(at[-1]), False
    while lo < end:
        hi = min(lo + size, end)
        row = int(np.searchsorted(at, hi, "right")) - 1  # the row that holds byte hi
        unfinished = False
        if hi < end and at[row] > lo:
            hi = int(at[row])
        elif hi < end:  # one text is longer than a chunk
            stop = int(at[row + 1])
            while hi < stop and letters[data[hi]]:
                gap = np.flatnonzero(letters[data[hi : min(hi + size, stop)]] == 0)
                hi = hi + int(gap[0]) if len(gap) else min(hi + size, stop)
            unfinished = hi < stop
        low = letters[data[lo:hi]]
        word = low != 0
        first = word.copy()
        first[1:] &= ~word[:-1]
        begins = at[np.searchsorted(at, lo, "right") : np.searchsorted(at, hi, "left")] - lo
        first[begins] = word[begins]
        places = np.flatnonzero(first)
        kept = low[word]
        offsets = np.append(np.flatnonzero(first[word]), len(kept)).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        rows = np.searchsorted(at, places + lo, "right") - 1
        yield Chunk(rows, found.indices.to_numpy().astype(np.int64), found.dictionary, goes_on, unfinished)
        lo, goes_on = hi, unfinished


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, the distinct keys by number)."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()
