"""Packing token sequences into fixed windows with bounded space.

Every partition of the documents keeps at most ``OPEN`` windows. A piece goes to the
open window that it fills best. When none has room for it, the fullest is topped up
with the piece's first ids, if the gap is worth a cut, and emitted. What is still open
at the end of a partition is merged with the leftovers of other partitions by the same
rule, in rounds of ``MERGED`` partitions, until one group is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialise
from .textscan import chunks

WINDOW, OPEN, MERGED = 2048, 64, 32
#: The shortest piece that is cut off a document only to fill a gap.
LEAST_CUT = 24
#: Distinct words whose ids a task remembers; then it begins anew.
REMEMBERED = 250_000
END_ID = 1

PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "group", "window", "offset", "filled")]
)


#: Ends a word for the second encoder; a text that has it itself takes the first.
MARK = "\x01"
# How the tokenizer splits lower-case text, over the characters of Latin-1.
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer splits a text into words and merges within words alone, so a word's
    ids are found once and remembered. Words that are new are merged together in one
    call of a byte-pair encoder that holds the same vocabulary, with a mark for the
    end of a word; it gives the same ids as merges by rank reach each token by one
    path. Texts beyond Latin-1 go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.split = re.compile(_SPLIT).findall
        byte_of, end = _byte_of(), "</w>"
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks, self.ends = {}, np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, place in self.tokenizer.get_vocab().items():
            if token in added:
                continue
            last = token.endswith(end) and token != end
            raw = bytes(byte_of[c] for c in (token[: -len(end)] if last else token))
            if MARK.encode() in raw and raw != MARK.encode():
                continue
            self.ends[place] = last
            if not (last and raw == MARK.encode()):
                ranks[raw + MARK.encode() * last] = place
        self.merge = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _words(self, text: str) -> list[str] | None:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if MARK in text else self.split(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list(set().union(*(w for w in split if w is not None)) - known.keys())
        if new:
            ids = np.array(self.merge(MARK.join(new) + MARK), dtype="<u4")
            blob, at = ids.tobytes(), 0
            for word, stop in zip(new, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                known[word] = blob[at:stop]
                at = stop
        return [
            b"".join(map(known.__getitem__, words)) if words is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for words, text in zip(split, texts, strict=True)
        ]


class _Space:
    """A bounded set of open windows, ordered by how much each holds."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most, self.made = size, most, 0
        self.order: list[tuple[int, int]] = []  # filled, window
        self.held: dict[int, list] = {}
        self.full: list[tuple[int, list]] = []

    def place(self, length: int) -> int | None:
        """The place, in the order, of the window that an item fits best; None if no window has room."""
        at = bisect_left(self.order, (self.size - length + 1, -1)) - 1
        return at if at >= 0 else None

    def put(self, at: int | None, length: int, item) -> None:
        if at is None:
            filled, window = 0, self.made
            self.made += 1
            self.held[window] = []
        else:
            filled, window = self.order.pop(at)
        self.held[window].append((filled, item))
        filled += length
        if filled == self.size:
            self.full.append((filled, self.held.pop(window)))
        else:
            insort(self.order, (filled, window))

    def emit_fullest(self) -> None:
        filled, window = self.order.pop()
        self.full.append((filled, self.held.pop(window)))

    def drain(self) -> list[tuple[int, list]]:
        out, self.full = self.full, []
        return out


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = np.array(rows, dtype=np.int64).reshape(-1, len(PIECES)).T
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECES.names)


def _packer(path: str, size: int, most: int, least_cut: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        encoder, space, made = WordTokens(path), _Space(size, most), 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        missing = -(1 << 63)

        def rows(windows: list[tuple[int, list]], closed: bool) -> list[tuple]:
            nonlocal made
            out = []
            for filled, items in windows:
                for offset, (doc, start, length, crc, total) in items:
                    out.append((doc, start, length, crc, total, group, made, offset, filled if closed else -filled))
                made += 1
            return out

        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(missing).to_pylist()
                for doc, blob in zip(ids, encoder.encode(texts.to_pylist()), strict=True):
                    blob += end
                    total, at = len(blob) // 4, 0

                    def piece(a: int, b: int):
                        return (doc, a, b - a, zlib.crc32(blob[4 * a : 4 * b]), total)  # noqa: B023

                    while total - at >= size:
                        space.full.append((size, [(0, piece(at, at + size))]))
                        at += size
                    while at < total:
                        left = total - at
                        found = space.place(left)
                        if found is None and len(space.order) >= space.most:
                            gap = size - space.order[-1][0]
                            if gap >= least_cut and left - gap >= least_cut:
                                space.put(len(space.order) - 1, gap, piece(at, at + gap))
                                at += gap
                            else:
                                space.emit_fullest()
                            continue
                        space.put(found, left, piece(at, total))
                        at = total
                if out := rows(space.drain(), True):
                    yield _record(out)
        open_windows = [(filled, space.held[w]) for filled, w in space.order]
        if out := rows(open_windows, False):
            yield _record(out)

    return pack


def _merger(size: int, most: int):
    """Leftover windows are items of their own; their pieces move with them."""

    def merge(key, frame):
        import pandas as pd

        space, out, made = _Space(size, most), [], 0
        frame = frame.sort_values(["filled", "group", "window", "offset"], kind="stable")
        source = frame.to_numpy(dtype=np.int64)
        ends = np.flatnonzero(np.append((frame["group"].diff().ne(0) | frame["window"].diff().ne(0)).to_numpy()[1:], True)) + 1
        begin = 0
        for finish in ends.tolist():
            filled = -int(source[begin, 8])  # largest first: filled is negative here
            at = space.place(filled)
            if at is None and len(space.order) >= space.most:
                space.emit_fullest()
            space.put(at, filled, (begin, finish))
            begin = finish

        def rows(windows, closed):
            nonlocal made
            for filled, items in windows:
                for offset, (a, b) in items:
                    block = source[a:b].copy()
                    block[:, 5], block[:, 6] = key[0], made
                    block[:, 7] += offset
                    block[:, 8] = filled if closed else -filled
                    out.append(block)
                made += 1

        rows(space.drain(), True)
        rows([(filled, space.held[w]) for filled, w in space.order], False)
        return pd.DataFrame(np.concatenate(out), columns=PIECES.names)

    return merge


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = WINDOW, most: int = OPEN, least_cut: int = LEAST_CUT) -> DataFrame:
    """Pieces of all documents, packed into windows of at most ``size`` ids.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document is
    the ids of its text (null: none) and one end id. Returns a row per piece:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Repeated
    rows are packed each for itself; a null doc_id stays null; an empty table gives
    no rows. ``tokenizer_path`` must be readable on every executor.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialise(docs.mapInArrow(_packer(tokenizer_path, size, most, least_cut), PIECES), "pieces")
    finished = [pieces.where("filled > 0").withColumn("round", F.lit(0))]
    left, rounds = pieces.where("filled < 0"), 0
    groups = left.agg(F.max("group")).first()[0]
    while groups is not None:
        rounds += 1
        merged = materialise(left.withColumn("window", F.shiftleft("group", 24).bitwiseOR(F.col("window"))).withColumn("group", F.floor(F.col("group") / MERGED)).groupBy("group").applyInPandas(_merger(size, most), PIECES), "pieces")
        groups //= MERGED
        if groups == 0:
            finished.append(merged.withColumn("round", F.lit(rounds)))
            break
        finished.append(merged.where("filled > 0").withColumn("round", F.lit(rounds)))
        left = merged.where("filled < 0")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    sequence = F.shiftleft(F.col("round").cast("long"), 58).bitwiseOR(F.shiftleft("group", 32)).bitwiseOR(F.col("window"))
    doc = F.when(F.col("doc_id") != F.lit(-(1 << 63)).cast("long"), F.col("doc_id"))
    return out.select(doc.alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset")
