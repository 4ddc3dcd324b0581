"""Vectorised word scanning over Arrow string buffers.

Texts are read as UTF-8 bytes. ASCII letters are lower-cased, words are runs of
bytes of a given class, and every word gets a 64-bit hash from one prefix sum, so
that a batch costs a few NumPy passes and no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_1, _MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: Text bytes that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    x = x ^ (x >> U64(30))
    x = x * _MIX_1
    x = x ^ (x >> U64(27))
    x = x * _MIX_2
    return x ^ (x >> U64(31))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()


def space_words() -> np.ndarray:
    """Bytes of words that white space (space, tab to carriage return) ends."""
    table = np.ones(256, dtype=bool)
    table[32] = False
    table[9:14] = False
    return table


def letter_words() -> np.ndarray:
    """Bytes of words made of ASCII digits and lower-case letters and of non-ASCII characters."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = True
    table[97:123] = True
    table[128:] = True
    return table


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, CHUNK_BYTES + 4096)
            full = np.full(self.size, _BASE, dtype=U64)
            full[0] = 1
            self.power = np.multiply.accumulate(full)
            full[1:] = U64(_BASE_INVERSE)
            self.inverse = np.multiply.accumulate(full)
        return self.power, self.inverse


@dataclass
class Words:
    """Words of some texts: the text each stands in, byte bounds in ``data``, and hashes."""

    data: np.ndarray
    offsets: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # of each text's words
    sums: np.ndarray
    inverse: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + U64(1))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return pa.array([""] * len(column), pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets at which each begins and ends."""
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    block = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return block, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch whose texts together stay near ``limit`` bytes."""
    texts = text_array(batch.column(batch.schema.get_field_index(column)))
    _, offsets = raw_bytes(texts)
    begin, n = 0, len(texts)
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield batch.slice(begin, end - begin), texts.slice(begin, end - begin)
        begin = end


def scan(texts: pa.Array, word_bytes: np.ndarray, powers: Powers) -> Words:
    """Find and hash the words of some texts."""
    raw, offsets = raw_bytes(texts)
    data = LOWER[raw]
    n = len(data)
    power, inverse = powers.upto(n + 1)
    inside = word_bytes[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # a text begins here
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[first[:n]] = False
        after[-1] = False
        after[:-1] = inside[1:]
        after[first[1:]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[:n], out=sums[1:])
    # a text's words: bounds by position of its first byte
    bounds = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    words = Words(data, offsets, text, start, end, np.zeros(0, U64), bounds, sums, inverse)
    words.hash = words.span_hash(start, end)
    return words


_SHINGLE = [U64(int(x) | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; a
    shorter text with words has one shingle, the whole sequence."""
    h = words.hash
    m = len(h) - width + 1
    factors = [_SHINGLE[i % len(_SHINGLE)] * U64(2 * (i // len(_SHINGLE)) + 1) for i in range(width)]
    rolled = np.zeros(max(m, 0), dtype=U64)
    for i in range(width if m > 0 else 0):
        rolled += h[i : i + m] * factors[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            tail = np.append(h[a:b], U64(b - a))  # the length tells it from any shingle
            place = mix(np.arange(101, 101 + len(tail), dtype=U64))
            out.append(mix((mix(tail) * (place | U64(1))).sum(dtype=U64, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
