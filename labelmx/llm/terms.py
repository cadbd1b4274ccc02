"""Words of whole texts as codes into a dictionary, vectorised over Arrow buffers.

A byte table says what separates words: it maps every separator to a space,
A-Z to a-z, and leaves the bytes of other characters alone, so texts stay UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import buffers


def byte_table(*, digits: bool, newlines: bool = False) -> np.ndarray:
    """Letters, bytes above 0x7F and, if asked for, digits make words; newlines may stay as they are."""
    table = np.arange(256, dtype=np.uint8)
    ascii_ = np.arange(128)
    upper, lower = (ascii_ >= 65) & (ascii_ <= 90), (ascii_ >= 97) & (ascii_ <= 122)
    digit = (ascii_ >= 48) & (ascii_ <= 57)
    table[:128][~(upper | lower | (digit & digits))] = 32
    table[:128][upper] += 32
    if newlines:
        table[10] = 10
    return table


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with every byte mapped; a null is an empty text."""
    at, data = buffers(texts)
    out = table[data[at[0] : at[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(out))


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of mapped texts, the code of each word in order, and where the words of each text begin."""
    lists = pc.split_pattern(texts, " ")
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    parent = parent.filter(full).to_numpy(zero_copy_only=False)
    first = np.searchsorted(parent, np.arange(len(texts) + 1))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``limit`` bytes, so that counts of one batch add up more."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
