"""Benchmark decontamination by edit distance.

A CGK random walk reads a window: at step ``j`` it writes the symbol it stands on and
moves on if a random bit of ``(j, symbol)`` says so. Two windows at a small edit
distance get embeddings at a small Hamming distance, so a few sampled coordinates are
equal with good probability. Each of several walks is sampled several times; a sample
is a table's key.

An item is covered by windows of a fixed length from each of its word starts, and
documents are read at every word start, so that a passage meets the index at each of
its words; each meeting and each table is a further chance. (One embedding of the whole
item does not reach the stated share of edits: walks that an edit has parted are equal
at few of the later coordinates. See the README for figures.)

The work is a join. Keys of items are a table; a bounded number of keys at a time goes
to the scan, which emits the regions of documents that hold one of them. Regions are
joined with the items by key, and each item is verified by its exact edit distance
within the window around where it may begin. A key that meets by chance is told by the
rest of its walk: a bit of every coordinate is kept, and few of them may differ.

Texts are compared by their words: lower-case runs of letters and digits, joined by
single spaces. Scripts without spaces have a start at every character.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .idfilter import marked
from .storage import Scratch, discard, free_name, materialise
from .textscan import LOWER, U64, chunks, letter_words, mix, raw_bytes

#: Edits, as a share of the item's length, up to which a passage is the item.
MOST_EDITS = 0.2
WALKS, SAMPLES = 5, 4
#: Keys of items that a pass over the documents seeks at once (32 bytes each, broadcast).
MOST_KEYS = 1_000_000
#: A candidate is compared exactly if its window has so many of its runs of ``GRAM`` bytes; a share
#: of unlike texts of one language is below, of random edits up to ``MOST_EDITS`` above.
GRAM, GRAM_BITS, LEAST_GRAMS = 4, 14, 0.38
#: Shorter patterns are always compared exactly.
LEAST_COUNTED = 80
#: Items with fewer normalised bytes are sought exactly, as whole words.
LEAST_EDITED = 12
#: Normalised items of up to so many bytes in all are broadcast for verification; more are shuffled.
BROADCAST_BYTES = 16 << 20

FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("distance", T.LongType()),
        T.StructField("item_chars", T.LongType()),
        T.StructField("place", T.LongType()),
    ]
)
REGIONS = "region long, row long, doc_id long, text_a long, text_b long, at long, slice binary, starts array<long>, keys array<long>, sketches array<long>"


@dataclass(frozen=True)
class Grade:
    """How items of a kind are embedded: steps of a walk (an even number), coordinates of a
    sample, and bytes an indexed start must have after it."""

    number: int
    steps: int
    coordinates: int
    tail: int
    differ: int  # bits of all coordinates that may differ where a sample is equal


SHORT = Grade(1, 16, 8, 8, 2)
LONG = Grade(2, 48, 14, 32, 5)
#: Starts of an item that the long grade needs.
LONG_STARTS = 8
#: Starts whose walks are taken together, and bytes of text that are read at once.
BLOCK_STARTS, READ_BYTES = 1 << 15, 1 << 19
#: Spaces between texts: no walk reads into the next one.
GAP = max(SHORT.steps, LONG.steps) + 2


def _separators(data: np.ndarray) -> np.ndarray:
    """Bytes of the usual punctuation beyond ASCII, of two or three bytes each."""
    out = np.zeros(len(data), dtype=bool)
    if len(data) < 2 or not (data >= 0xC2).any():
        return out
    after = np.append(data[1:], np.uint8(0))
    third = np.append(after[1:], np.uint8(0))
    two = (data == 0xC2) & (after < 0xC0)
    wide = (data == 0xEF) & (
        ((after == 0xBC) & ((third <= 0x8F) | ((third >= 0x9A) & (third <= 0xA0)) | (third >= 0xBB)))
        | ((after == 0xBD) & ((third == 0x80) | ((third >= 0x9B) & (third <= 0xA5))))
    )
    three = ((data == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((data == 0xE3) & (after == 0x80)) | wide
    at = np.flatnonzero(two)
    out[at] = out[at + 1] = True
    at = np.flatnonzero(three)
    at = at[at + 2 < len(data)]
    out[at] = out[at + 1] = out[at + 2] = True
    return out


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts with spaces between them, where each begins and ends, and all starts."""
    raw, offsets = raw_bytes(texts)
    data = LOWER[raw]
    accented = np.zeros(len(data), dtype=bool)  # capitals of Latin-1, two bytes each
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[accented] += 0x20
    inside = letter_words()[data] & ~_separators(data)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[first[:-1]] = False
    keep = inside | before  # a word, or the byte that ends one
    alone = (data >= 0xE0) & (data <= 0xE9) & (data != 0xE2)  # characters of scripts that may lack spaces
    starts = np.flatnonzero((inside & (~before | alone))[keep])
    data[~inside] = 32
    kept = data[keep]
    sizes = np.array([np.count_nonzero(keep[a:b]) for a, b in pairwise(offsets.tolist())], np.int64)
    stops = np.cumsum(sizes)
    ends = stops + GAP * np.arange(len(texts))  # a gap follows each text
    begins = ends - sizes
    out = np.full(len(kept) + GAP * (len(texts) + 1), 32, dtype=np.uint8)
    for begin, end, stop in zip(begins.tolist(), ends.tolist(), stops.tolist(), strict=True):
        out[begin:end] = kept[stop - (end - begin) : stop]
    return out, begins, ends, starts + GAP * np.searchsorted(stops, starts, side="right")


def _symbols() -> np.ndarray:
    """Normalised bytes as one of 32 symbols: letters have one each, others share the rest."""
    table = (np.arange(256) * 11 % 32).astype(np.int64)
    table[32] = 0
    table[97:123] = np.arange(1, 27)
    table[48:58] = 27 + np.arange(10) % 5
    return table


class _Walks:
    """The shared randomness of a grade, as tables of three steps at a time.

    Three steps read three neighbouring symbols at most, so a table of 32768 entries tells
    how far they move and what they add to the keys of the samples. A key is the
    exclusive or of what its coordinates add, in one half of a 64-bit lane.
    """

    def __init__(self, grade: Grade) -> None:
        rng = np.random.default_rng(100 + grade.number)
        self.grade, self.symbols = grade, _symbols().astype(np.uint16)
        moves = rng.integers(0, 2, (WALKS, grade.steps, 32), dtype=np.int64)
        adds = rng.integers(0, 1 << 32, (WALKS, SAMPLES, grade.steps, 32), dtype=np.int64).astype(U64)
        for w in range(WALKS):
            for s in range(SAMPLES):
                left_out = rng.permutation(grade.steps)[grade.coordinates :]
                adds[w, s, left_out] = 0
        bits = rng.integers(0, 2, (WALKS, grade.steps, 32), dtype=np.int64).astype(U64)
        lanes = np.ascontiguousarray((adds[:, 0::2] | (adds[:, 1::2] << U64(32))).transpose(0, 2, 3, 1))
        half = grade.steps // 2
        self.parts = [[[_steps(lanes[w], moves[w], range(j, min(j + 3, h + half))) for j in range(h, h + half, 3)] for h in (0, half)] for w in range(WALKS)]
        one, two = np.arange(1024) & 31, np.arange(1024) >> 5
        self.moves, self.bits = [], []
        for w in range(WALKS):
            for j in range(0, grade.steps, 2):
                then = np.where(moves[w, j, one] > 0, two, one)
                self.moves.append(moves[w, j, one] + moves[w, j + 1, then])
                self.bits.append((bits[w, j, one] << U64(j)) | (bits[w, j + 1, then] << U64(j + 1)))

    def codes(self, data: np.ndarray) -> np.ndarray:
        """Each place's symbol and the two after it, five bits each."""
        symbol = self.symbols[data]
        return symbol[:-2] | (symbol[1:-1] << 5) | (symbol[2:] << 10)

    def walk(self, codes: np.ndarray, at: np.ndarray, lanes: np.ndarray, walk: int, half: int) -> None:
        """Half of the steps of a walk, from the places ``at`` on; both arrays are moved on. The lanes of a place lie
        side by side, so that one look-up adds to all of them."""
        code, group, move, add = np.empty(len(at), np.uint16), np.empty(len(at), np.int64), np.empty(len(at), np.int64), np.empty_like(lanes)
        for adds, moves in self.parts[walk][half]:
            codes.take(at, out=code, mode="clip")
            group[:] = code
            adds.take(group, axis=0, out=add, mode="clip")
            lanes ^= add
            moves.take(group, out=move, mode="clip")
            at += move

    def sketches(self, codes: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
        """A bit of each coordinate of a walk, for each start."""
        at, out = starts.astype(np.int64), np.zeros(len(starts), dtype=U64)
        half = self.grade.steps // 2
        for step in range(walk * half, (walk + 1) * half):
            pair = (codes.take(at, mode="clip") & 1023).astype(np.int64)
            out |= self.bits[step].take(pair)
            at += self.moves[step].take(pair)
        return out.view(np.int64)

    def table(self, walk: int, sample: int) -> int:
        return self.grade.number * 64 + walk * SAMPLES + sample

    def keys(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each table and start the key under the table's number, and the same after half of the steps."""
        codes = self.codes(data)
        out = np.empty((2, WALKS * SAMPLES, len(starts)), dtype=np.int64)
        for w in range(WALKS):
            at, lanes = starts.astype(np.int64), np.zeros((len(starts), SAMPLES // 2), dtype=U64)
            for half in (0, 1):
                self.walk(codes, at, lanes, w, half)
                for s in range(SAMPLES):
                    out[1 - half, w * SAMPLES + s] = _own(lanes, s).astype(np.int64) | (self.table(w, s) << 32)
        return out[0], out[1]


def _steps(lanes: np.ndarray, moves: np.ndarray, steps: range) -> tuple[np.ndarray, np.ndarray]:
    """What up to three steps add to the lanes and how far they move, by the code of a place."""
    code = np.arange(1 << 15)
    symbols = np.stack([code & 31, (code >> 5) & 31, code >> 10])
    add, moved = np.zeros((len(code), lanes.shape[2]), dtype=U64), np.zeros(len(code), np.int64)
    for j in steps:
        here = symbols[moved, code]
        add ^= lanes[j].take(here, axis=0)
        moved += moves[j].take(here)
    return add, moved


@lru_cache(maxsize=2)
def _walks_of(grade: Grade) -> _Walks:
    """The tables of a grade, made once in a process."""
    return _Walks(grade)


def _own(lanes: np.ndarray, sample: int) -> np.ndarray:
    """A sample's half of its lane."""
    lane = lanes[:, sample // 2]
    return lane >> U64(32) if sample % 2 else lane & U64(0xFFFFFFFF)


def _exact_keys(data: np.ndarray, starts: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of a whole-word phrase: which starts have one, and its keys."""
    begins = np.zeros(len(data), dtype=bool)
    begins[starts] = True
    held = np.zeros(len(starts), dtype=U64)
    for size in range(1, max(sizes, default=0) + 1):
        held = held * U64(0x9E3779B97F4A7C15) + data[starts + size - 1] + U64(1)
        if size in sizes:
            stop = starts + size
            good = np.flatnonzero((data[stop] == 32) | begins[stop])
            yield size, good, (mix(held[good] + U64(size)) >> U64(32)).astype(np.int64)


def _grade_of(offsets: np.ndarray, size: int) -> int:
    """The grade of an item with word starts at ``offsets``; 0: sought exactly."""
    if size < LEAST_EDITED:
        return 0
    return LONG.number if (size - offsets >= LONG.tail).sum() >= LONG_STARTS else SHORT.number


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch, "text"):
            data, begins, ends, _ = normalise(texts)
            patterns = [data[a:b].tobytes().strip(b" ") for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("item_id")), pa.array(patterns, pa.binary())], names=["item_id", "pattern"])


def _starts_of(pattern: bytes) -> np.ndarray:
    """Offsets of the starts of a normalised item."""
    data = np.frombuffer(pattern, np.uint8)
    before = np.append(np.uint8(32), data[:-1])
    return np.flatnonzero((data != 32) & ((before == 32) | ((data >= 0xE0) & (data <= 0xE9) & (data != 0xE2))))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of every start of an item that a document may meet."""
    walks = {g.number: _walks_of(g) for g in (SHORT, LONG)}
    tails = {g.number: g.tail for g in (SHORT, LONG)}
    for batch in batches:
        for item, pattern in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            offsets, size = _starts_of(pattern), len(pattern)
            grade = _grade_of(offsets, size)
            data = np.frombuffer(pattern + b" " * GAP, np.uint8)
            if grade == 0:
                keys = [k for _, _, found in _exact_keys(data, np.zeros(1, np.int64), {size}) for k in found]
                offsets, keys = np.zeros(len(keys), np.int64), np.array(keys, np.int64)
                sketches = halfway = np.zeros(len(keys), np.int64)
            else:
                offsets = offsets[(size - offsets >= tails[grade]) | (offsets == 0)]
                keys, halfway = (k.ravel() for k in walks[grade].keys(data, offsets))
                codes = walks[grade].codes(data)
                sketches = np.concatenate([np.tile(walks[grade].sketches(codes, offsets, w), SAMPLES) for w in range(WALKS)])
                offsets = np.tile(offsets, WALKS * SAMPLES)
            n = len(keys)
            full = lambda x: pa.array(np.full(n, x, np.int64))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(halfway), pa.array(sketches), full(item), pa.array(offsets.astype(np.int64)), full(size), full(grade)], names=["key", "halfway", "sketch", "item", "offset", "size", "grade"])


class _Index:
    """Keys of a pass: sorted, with what an item may extend before and after the start they stand for."""

    def __init__(self, table: pd.DataFrame) -> None:
        table = table.sort_values("key")
        self.key, self.sketch = table["key"].to_numpy(np.int64), table["sketch"].to_numpy(np.int64)
        self.halfway = table["halfway"].to_numpy(np.int64)
        self.distinct, self.first, self.times = np.unique(self.key, return_index=True, return_counts=True)
        self.before, self.after = table["before"].to_numpy(np.int64), table["after"].to_numpy(np.int64)
        grades = set(table["grade"].tolist())
        self.sizes = set(table.loc[table["grade"] == 0, "after"].tolist())
        self.grades = [g for g in (SHORT, LONG) if g.number in grades]


class _Reader:
    """Finds regions of texts that hold keys of an index."""

    def __init__(self, index: _Index, most_edits: float) -> None:
        self.index, self.most_edits = index, most_edits
        self.walks = [_walks_of(g) for g in index.grades]
        tables = np.bincount(index.key >> 32, minlength=1)
        self.bits = min(20, max(12, int(16 * tables.max(initial=1)).bit_length()))
        self.filters = [{}, {}]
        for half, keys in enumerate((index.halfway, index.key)):
            for walks in self.walks:
                for table in (walks.table(w, s) for w in range(WALKS) for s in range(SAMPLES)):
                    own = keys[(keys >> 32) == table] & 0xFFFFFFFF
                    self.filters[half][table] = np.zeros(1 << self.bits, dtype=bool)
                    # the low bits of a lane's low half, the high bits of its high half
                    self.filters[half][table][own >> (32 - self.bits) if table % 2 else own & ((1 << self.bits) - 1)] = True

    def _maybe(self, walks: _Walks, lanes: np.ndarray, walk: int, sample: int, half: int) -> np.ndarray:
        """Whether an item may have a sample's key, after half of the steps or all."""
        lane = lanes[:, sample // 2]
        place = lane >> U64(64 - self.bits) if sample % 2 else lane & U64((1 << self.bits) - 1)
        return self.filters[half][walks.table(walk, sample)].take(place.view(np.int64))

    def _known(self, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of index rows with their keys."""
        low = np.minimum(np.searchsorted(self.index.distinct, keys), len(self.index.distinct) - 1)
        hit = np.flatnonzero(self.index.distinct[low] == keys)
        first, times = self.index.first[low[hit]], self.index.times[low[hit]]
        rows = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(starts[hit], times), rows

    def _meetings(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts, and numbers of the index rows that they meet."""
        found = [(np.zeros(0, np.int64),) * 2]
        for walks in self.walks:
            codes = walks.codes(data)
            for first in range(0, len(starts), BLOCK_STARTS):
                for w in range(WALKS):
                    block = starts[first : first + BLOCK_STARTS].astype(np.int64)
                    at, lanes = block.copy(), np.zeros((len(block), SAMPLES // 2), dtype=U64)
                    walks.walk(codes, at, lanes, w, 0)
                    on = np.flatnonzero(np.logical_or.reduce([self._maybe(walks, lanes, w, s, 0) for s in range(SAMPLES)]))
                    at, lanes = at[on], lanes[on]
                    walks.walk(codes, at, lanes, w, 1)
                    known = []
                    for s in range(SAMPLES):
                        last = np.flatnonzero(self._maybe(walks, lanes, w, s, 1))
                        if len(last):
                            known.append(self._known(_own(lanes[last], s).astype(np.int64) | (walks.table(w, s) << 32), on[last]))
                    met, row = (np.concatenate(k) for k in zip(*known, strict=True)) if known else found[0]
                    if len(met):
                        sketch = np.zeros(len(block), np.int64)  # one for all meetings of a start
                        seen = np.zeros(len(block), dtype=bool)
                        seen[met] = True
                        own = np.flatnonzero(seen)
                        sketch[own] = walks.sketches(codes, block[own], w)
                        apart = sketch[met] ^ self.index.sketch[row]
                        good = np.bitwise_count(apart.view(U64)) <= walks.grade.differ
                        found.append((block[met[good]], row[good]))
        for _, good, keys in _exact_keys(data, starts, self.index.sizes):
            found.append(self._known(keys, starts[good]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def regions(self, texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """Text number, offset, bytes, starts (within the bytes), keys and their sketches of each region."""
        data, begins, ends, starts = normalise(texts)
        if not len(self.index.key) or not len(starts):
            return
        at, key = self._meetings(data, starts)
        if not len(at):
            return
        before, after = self.index.before[key], self.index.after[key]
        most = (self.most_edits * (before + after)).astype(np.int64)
        text = np.searchsorted(begins, at, side="right") - 1
        lower = np.maximum(begins[text], at - before - most)
        upper = np.minimum(ends[text], at + after + 2 * most)
        order = np.argsort(lower, kind="stable")
        reach = np.maximum.accumulate(upper[order])
        # regions of two texts never meet: a gap lies between them
        cuts = np.flatnonzero(np.concatenate([[True], lower[order][1:] > reach[:-1]]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            rows = order[a:b]
            low, high, own = int(lower[rows[0]]), int(reach[b - 1]), int(text[rows[0]])
            yield own, low - int(begins[own]), data[low:high].tobytes(), at[rows] - low, self.index.key[key[rows]], self.index.sketch[key[rows]]


def _scan(shared, most_edits: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader = _Reader(shared.value, most_edits)
        base, row = TaskContext.get().partitionId() << 40, 0
        region = 0
        for batch in batches:
            for part, texts in chunks(batch, "text", READ_BYTES):
                found = list(reader.regions(texts))
                if found:
                    text, at, slices, *lists = zip(*found, strict=True)
                    columns = [part.column(part.schema.get_field_index(c)).take(pa.array(text)) for c in ("doc_id", "text_a", "text_b")]
                    ids = [pa.array([base + region + i for i in range(len(found))], pa.int64()), pa.array([base + row + t for t in text], pa.int64())]
                    lists = [pa.array(list(c), pa.list_(pa.int64())) for c in lists]
                    yield pa.RecordBatch.from_arrays([*ids, *columns, pa.array(at, pa.int64()), pa.array(slices, pa.binary()), *lists], names=["region", "row", "doc_id", "text_a", "text_b", "at", "slice", "starts", "keys", "sketches"])
                    region += len(found)
                row += len(texts)

    return scan


def edit_distance_within(pattern: bytes, text: bytes, most: int | None = None) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and where that stretch ends.

    With ``most``, distances above it need not be exact: reading ends where the rest of
    ``text``, which lowers the score by one a character at best, cannot reach it.
    """
    m, n = len(pattern), len(text)
    most = m if most is None else most
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    rises, falls, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | falls
        horizontal = (((equal & rises) + rises) ^ rises) | equal
        up = falls | (~(horizontal | rises) & full)
        down = rises & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        rises = down | (~(vertical | up) & full)
        falls = up & vertical
        if score < best:
            best, end = score, j + 1
        elif score - (n - j - 1) > most:
            break
    return best, end


def verified(pattern: bytes, data: bytes, places: list[int], most_edits: float) -> tuple[int, int] | None:
    """Least edit distance of an item around some places of a stretch of text, and where it
    ends; None if it is above the share. A short item counts only exactly, where its key met."""
    size = len(pattern)
    most = int(most_edits * size) if size >= LEAST_EDITED else 0
    best, tried = (most + 1, 0), None
    for place in sorted(places):
        if place >= 0 and data[place : place + size] == pattern:
            return 0, place + size
        if size < LEAST_EDITED or (tried is not None and place - tried <= most // 2):
            continue  # the window around the last place holds this one
        tried, low = place, max(0, place - most)
        distance, end = edit_distance_within(pattern, data[low : max(low, place + size + 2 * most)], most)
        best = min(best, (distance, low + end))
    return best if best[0] <= most else None


def _grams(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``GRAM`` bytes of each stretch, and the number of the stretch."""
    data = np.frombuffer(b"".join(stretches) + b" " * GRAM, np.uint8).astype(np.int64)
    sizes = np.array([len(x) for x in stretches])
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(stretches)), counts)
    at = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    code = np.zeros(len(at), np.int64)
    for k in range(GRAM):
        code = code * 31 + data[at + k]
    return code * 0x9E3779B1 >> 7 & ((1 << GRAM_BITS) - 1), owner


def likely(patterns: list[bytes], windows: list[bytes]) -> np.ndarray:
    """Whether enough of a pattern's runs of bytes occur in its window to be worth an exact comparison."""
    seen = np.zeros(len(patterns) << GRAM_BITS, dtype=bool)
    code, owner = _grams(windows)
    seen[(owner << GRAM_BITS) | code] = True
    code, owner = _grams(patterns)
    met = np.bincount(owner, weights=seen[(owner << GRAM_BITS) | code], minlength=len(patterns))
    brief = np.array([len(p) < LEAST_COUNTED for p in patterns])
    return brief | (met >= LEAST_GRAMS * np.bincount(owner, minlength=len(patterns)))


def _verify(most_edits: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows, found = batch.slice(begin, 256).to_pylist(), []
                windows = []
                for r in rows:
                    most = int(most_edits * len(r["pattern"]))
                    windows.append(r["slice"][max(0, min(r["places"]) - most) : max(r["places"]) + len(r["pattern"]) + 2 * most])
                for r, good in zip(rows, likely([r["pattern"] for r in rows], windows).tolist(), strict=True):
                    if good and (hit := verified(r["pattern"], r["slice"], r["places"], most_edits)):
                        found.append((r["row"], r["doc_id"], r["text_a"], r["text_b"], r["item"], hit[0], len(r["pattern"]), r["at"] + hit[1]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], names=["row", "doc_id", "text_a", "text_b", "item", "distance", "item_chars", "place"])

    return verify


HITS = "row long, doc_id long, text_a long, text_b long, item long, distance long, item_chars long, place long"


def _text_keys():
    """Two hashes that stand for a text."""
    return F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(7), F.col("text")).alias("text_b")


def _hits(docs: DataFrame, benchmark: DataFrame, most_edits: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Verified hits of classes of items with equal normalised texts, and the members of the classes."""
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = scratch.keep(wanted.mapInArrow(_items, "item_id long, pattern binary").where(F.length("pattern") > 0), "items")
    classes = scratch.keep(items.groupBy("pattern").agg(F.min("item_id").alias("item")).select("item", "pattern"), "itemclasses")
    members = items.join(classes.withColumnRenamed("pattern", "own"), F.col("pattern") == F.col("own")).select("item", "item_id")
    entries = scratch.keep(classes.mapInArrow(_entries, "key long, halfway long, sketch long, item long, offset long, size long, grade long"), "itemkeys")
    n = entries.count()
    passes = max(1, -(-n // MOST_KEYS))
    small = (classes.agg(F.sum(F.length("pattern"))).first()[0] or 0) <= BROADCAST_BYTES

    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shaped = shaped.select("doc_id", "text", *_text_keys())
    parts = []
    for p in range(passes):
        mine = entries.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == p) if passes > 1 else entries
        found = mine.groupBy("key", "halfway", "sketch", "grade").agg(F.max("offset").alias("before"), F.max(F.col("size") - F.col("offset")).alias("after"), F.count("*").alias("entries"))
        table = found.toPandas()  # a bounded number of keys
        shared = docs.sparkSession.sparkContext.broadcast(_Index(table))
        regions = scratch.keep(shaped.mapInArrow(_scan(shared, most_edits), REGIONS), "regions")
        met = regions.select("region", F.explode(F.arrays_zip("starts", "keys", "sketches")).alias("m")).select("region", F.col("m.keys").alias("key"), F.col("m.sketches").alias("sketch"), F.col("m.starts").alias("start"))
        side = mine.select("key", "sketch", "item", "offset")
        side = F.broadcast(side) if table["entries"].sum() <= 2 * MOST_KEYS else side
        places = met.join(side, ["key", "sketch"]).groupBy("region", "item").agg(F.collect_set(F.col("start") - F.col("offset")).alias("places"))
        texts = F.broadcast(classes) if small else classes
        full = places.join(regions.drop("starts", "keys", "sketches"), "region").join(texts, "item")
        parts.append(scratch.keep(full.select("row", "doc_id", "text_a", "text_b", "item", "at", "slice", "places", "pattern").mapInArrow(_verify(most_edits), HITS), "hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    return hits, members


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """Benchmark items that documents hold, up to a share of edits.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``;
    other columns are ignored. One row per document row and item found: ``doc_id,
    item_id, distance`` (least edit distance found, in bytes), ``item_chars`` and
    ``place`` (end of the passage in the normalised text). Items of fewer than
    ``LEAST_EDITED`` normalised bytes are found exactly, as whole words. Null or empty
    texts hold nothing, and a null doc_id stays null; items without an id or without
    words are not sought; equal items are found together; repeated rows are each
    searched, so they give equal rows. A very long text is read in one piece, its
    regions are verified apart. Empty tables give no rows. What is found does not
    depend on how rows are dealt.
    """
    scratch = Scratch()
    hits, members = _hits(docs, benchmark, most_edits, scratch)
    best = hits.groupBy("row", "doc_id", "item", "item_chars").agg(F.min(F.struct("distance", "place")).alias("best"))
    named = best.join(members, "item").select("doc_id", "item_id", "best.distance", "item_chars", "best.place")
    found = materialise(named, "leaks")
    scratch.clear()
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """The rows of ``docs``, whole, that hold no benchmark item.

    Whether a row goes depends on its text alone, so repeated rows share their fate.
    Rows without text stay; other columns are kept as they are, whatever their names.
    Only rows that a bitmap of the leaking texts does not clear are shuffled.
    """
    scratch = Scratch()
    hits, _ = _hits(docs, benchmark, most_edits, scratch)
    gone = materialise(hits.select("text_a", "text_b").distinct(), "leaking")
    scratch.clear()
    names = docs.columns
    a, b = free_name(names, "_text_a"), free_name(names, "_text_b")
    maybe = free_name([*names, a, b], "_maybe")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(F.lit(7), text))
    told = marked(keyed, a, gone.select("text_a"), maybe)
    unsure = told.where(F.col(maybe))
    clear = unsure.join(gone, (F.col(a) == gone["text_a"]) & (F.col(b) == gone["text_b"]), "left_anti")
    return told.where(~F.col(maybe)).select(*_quoted(names)).unionAll(clear.select(*_quoted(names)))


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]
