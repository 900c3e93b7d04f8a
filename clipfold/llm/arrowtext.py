"""Whole Arrow columns of text as numpy arrays: bytes, words and their codes.

Words are runs of other bytes than space and 0x09-0x0D. Everything here works
on one slice of a record batch and holds no more than a few times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes in ``column`` at most (a longer text or list comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        lengths = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_array(column: pa.Array) -> pa.Array:
    """A text column without nulls, offset or chunks."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([filled]) if filled.offset == 0 else pa.concat_arrays([filled, pa.array([], pa.large_string())])


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts after one another, and where each begins (one entry more)."""
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(text) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each two offsets."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Words:
    """Words of a slice: a code for each, where each text's words begin, and the words by code."""

    codes: np.ndarray
    offsets: np.ndarray
    vocabulary: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word, by code."""
        data, at = raw_bytes(text_array(self.vocabulary))
        whole, digest, at = memoryview(data), xxhash.xxh3_64_intdigest, at.tolist()
        return np.fromiter((digest(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), dtype=np.uint64, count=len(self.vocabulary))

    def owners(self) -> np.ndarray:
        """The index of the text that each word is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words_of(text: pa.Array, lower_ascii: bool = False) -> Words:
    if lower_ascii:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    if not len(flat):
        return Words(np.zeros(0, np.int64), offsets, pa.array([], pa.large_string()))
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(encoded.dictionary, pa.scalar("", encoded.dictionary.type)).as_py()
    if empty >= 0:  # white space at either end of a text
        full = codes != empty
        kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(full, out=kept[1:])
        codes, offsets = codes[full], kept[offsets]
    return Words(codes, offsets, encoded.dictionary)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` successive hashes."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:size])
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= hashes[k : k + size]
        out = mix(out)
    return out


def inside(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which windows of ``n`` lie in one text, of the ``size`` that there are over all texts."""
    ok = np.ones(max(size, 0), dtype=bool)
    for k in range(1, n):
        ends = offsets[1:-1] - k
        ok[ends[(ends >= 0) & (ends < len(ok))]] = False
    return ok
