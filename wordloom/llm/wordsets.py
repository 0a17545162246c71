"""Hashed word and shingle sets of whole texts, vectorised over Arrow buffers.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased first. A word's
64-bit hash starts from its length and a key and takes in eight bytes at a time, each step ending
in a bijective finaliser; long words have a keyed BLAKE2b. A shingle's hash mixes the hashes of its
words in order. Sets are compared through these 64-bit values: of n values in play, two collide
with a chance of about n**2 / 2**65, as for random values.

Nothing here knows Spark: the operators call it from ``mapInArrow``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text worked on at once; a longer single text is worked on alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 256
_KEY = 0xA0761D6478BD642F
#: Keeps the first k of eight little-endian bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about CHUNK_BYTES; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words stand before each text's end (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:][(offsets[1:] > 0)] - 1
    ends[edges] = inside[edges]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", low, strides=(1,))  # the eight bytes from each place on
    size = e - s
    h = mix((size.astype(_U) + _U(1)) * _U(_KEY))
    at, todo = 0, np.arange(len(s))
    while len(todo) and at < LONG_WORD:
        lane = eight[s[todo] + at] & _FIRST[np.minimum(size[todo] - at, 8)]
        h[todo] = mix(h[todo] ^ lane) + _U(_KEY)
        at += 8
        todo = todo[size[todo] > at]
    for k in todo:
        long = hashlib.blake2b(low[s[k] : e[k]].tobytes(), digest_size=8, key=b"word").digest()
        h[k] = int.from_bytes(long, "little")
    return h, np.searchsorted(s, offsets)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text's words; fewer words count as one shingle."""
    if not len(h):
        return h
    width = min(k, len(h))
    acc = np.full(len(h) - width + 1, width * 0xE7037ED1A0B428DB % 2**64, dtype=_U)
    for j in range(width):
        acc = mix(acc * _U(0x8EBC6AF09C88C6E3) + h[j : len(h) - width + 1 + j])
    return np.unique(acc)


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order."""
    for _, data, offsets in chunks(texts):
        h, at = words(data, offsets)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield shingles(h[a:b], k)


def digest(values: np.ndarray) -> bytes:
    """128 bits that stand for a sorted array of 64-bit values."""
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()
