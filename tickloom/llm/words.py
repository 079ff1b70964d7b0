"""Words of UTF-8 texts as 64-bit numbers, in numpy over the bytes of whole texts.

A word is a run of digits, ASCII letters (A-Z read as a-z) and characters beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; longer texts are cut between words, so memory stays bounded.
PIECE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2**64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (xor-shift and multiply, twice)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def uniform(x: np.ndarray) -> np.ndarray:
    """Mixed 64-bit numbers as doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_CODE[0x41:0x5B] = _CODE[0x61:0x7B]
_POWERS = _powers(_BASE, PIECE_BYTES + 1)
_INVERSE = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), PIECE_BYTES + 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each data[start:end]; the same bytes give the same number at any place."""
    n = len(data)
    if n > PIECE_BYTES:
        raise ValueError("cut the data into pieces first")
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * _POWERS[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64))


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = _IS_WORD[data]
    steps = np.diff(flags)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def pieces(data: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of at most `size` bytes that end between words; a longer word is cut at `size`."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + size)
        if end < n:
            gaps = np.flatnonzero(~_IS_WORD[data[start:end]])
            end = start + int(gaps[-1]) + 1 if len(gaps) else end
        yield start, end
        start = end


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, first byte) of every word of the bytes."""
    found = []
    for start, end in pieces(data):
        part = data[start:end]
        a, b = _edges(part)
        found.append((span_hashes(part, a, b), a + start))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([a for _, a in found])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups_of_texts(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `size` bytes together; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """A number for every run of `n` consecutive words; fewer words, but not none, are one run."""
    if len(words) == 0:
        return words
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xA24BAED4963EE407) + words[k:k + len(out)]
    return mix(out + np.uint64(size))
