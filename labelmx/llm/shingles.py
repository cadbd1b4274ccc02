"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow buffers.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A text with fewer words than a shingle gives its whole word sequence as one;
null, empty and blank texts give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .base import chunks

_CHUNK_BYTES = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256, dtype=np.uint64)
    code[65:91] += np.uint64(32)
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return mix(code + np.uint64(1)), ~space


_CODE, _INK = _byte_tables()


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0xD1342543DE82EF95), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string array; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where the words of each text begin."""
    ink = _INK[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | cut[1:-1]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    inside = np.flatnonzero(ink)
    word = np.cumsum(begins)[inside] - 1
    place = inside - starts[word]
    values = _CODE[data[inside]] * _powers(int(place.max()) + 1)[place]
    edges = np.searchsorted(inside, starts)
    lengths = np.diff(np.append(edges, len(inside))).astype(np.uint64)
    return mix(np.add.reduceat(values, edges) + lengths * _STEP), first


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    offsets, data = buffers(texts)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    for a, b in chunks(np.diff(offsets).tolist(), _CHUNK_BYTES):
        at = offsets[a : b + 1]
        hashes, first = _words(at - at[0], data[at[0] : at[-1]])
        n = len(hashes) - width + 1
        rolled = np.zeros(0, np.uint64)
        if n > 0:
            rolled = hashes[:n] * weights[0]
            for k in range(1, width):
                rolled = rolled + hashes[k : k + n] * weights[k]
            rolled = mix(rolled)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
            if e - s >= width:
                yield np.unique(rolled[s : e - width + 1])
            elif e > s:
                short = (hashes[s:e] * weights[: e - s]).sum(dtype=np.uint64, keepdims=True)
                yield mix(short + np.full(1, e - s, np.uint64) * _STEP)
            else:
                yield np.zeros(0, np.uint64)
