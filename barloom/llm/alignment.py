"""Alignment of two tokenizers' tokens on the bytes that they share.

1. Texts are encoded by a byte-level and by a piece vocabulary. Packed bitsets over the
   bytes mark where tokens end; their AND are the shared cuts, and popcount ranks map a
   cut to the token ranges that end there. Between two cuts lies a group: all its tokens
   of one side are linked with all of the other.
2. Each document is written once, with its distinct pairs of linked ids and how often
   it holds each. Documents lie in blocks of some megabytes of text.
3. Pairs are counted over all documents, summed within tasks before the shuffle, and
   compared with the highest count of their first id.
4. A block asks for the distinct pairs of its documents, not a document for its own, so
   that a frequent pair is one row a block. The answers meet the block in a cogroup.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch, materialise
from .textscan import chunks

#: Characters that are encoded at once, and of white space or without any that only the tokenizer takes.
SLICE, SPACES = 1 << 16, 4096
#: Bytes of text of the documents that ask for pairs together.
BLOCK_BYTES = 4 << 20
#: A group of more links is summed by ids instead of listed; links that are listed at once.
LISTED, AT_ONCE = 1024, 1 << 21
#: Distinct pairs that a task sums before it hands them on.
SUMMED = 1 << 21

ALIGNED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("block", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())]
)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = (
    "doc_id long, a_ids array<int>, b_ids array<int>, "
    "groups array<struct<byte_start: long, byte_end: long, a_start: int, a_end: int, b_start: int, b_end: int>>"
)


def _class(kinds: str, more: str = "") -> str:
    """Characters of ``_COMMON`` whose Unicode category begins so, for a character class."""
    return re.escape("".join(chr(c) for low, high in _COMMON for c in range(low, high) if unicodedata.category(chr(c))[0] in kinds) + more)


#: Latin letters and general punctuation: all versions of Unicode class them alike.
_COMMON = ((0, 0x250), (0x2010, 0x2060))
_SPACES = _class("Z", "\t\n\x0b\x0c\r\x85")
#: What the encoder of byte-level ids is not given: other characters, and runs of white space over which its pattern would recurse.
_UNCOMMON = re.compile(f"[^{''.join(f'{chr(low)}-{chr(high - 1)}' for low, high in _COMMON)}]|[{_SPACES}]{{{SPACES}}}|[^{_SPACES}]{{{SPACES}}}")
#: How the byte-level vocabulary splits a text (a fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Both vocabularies begin a token here: a space between two characters that are none.
_APART = re.compile(r"(?<=\S) (?=\S)")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def slices(text: str, limit: int = 0) -> list[str]:
    """Parts of a text of about ``limit`` characters (``SLICE``), cut where both vocabularies begin a token."""
    limit, out, begin = limit or SLICE, [], 0
    while len(text) - begin > limit and (cut := _APART.search(text, begin + limit)):
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]]


class ByteTokens:
    """A byte-level vocabulary whose ids are in the order of merges, as those of public ones are.

    Common texts are encoded by its ranks; the tokenizer itself takes the others, whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_of()
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in added}
        self.raw = [b""] * self.tokenizer.get_vocab_size()
        for raw, i in ranks.items():
            self.raw[i] = raw
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.ranked = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, part: str) -> np.ndarray:
        return np.array(self.whole(part) if _UNCOMMON.search(part) else self.ranked(part), np.int64)


class PieceTokens:
    """A vocabulary of pieces, over texts that begin with the space which it adds itself."""

    SPACE = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.apart = not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)  # or tokens would cross the places where texts are cut

    def encode(self, part: str) -> np.ndarray | None:
        """None where the bytes of the pieces are not those of the text."""
        ids = self.model.encode(part[1:], num_threads=1)
        return np.array(ids, np.int64) if b"".join([self.raw[i] for i in ids]) == part.encode() else None


class Bits:
    """A packed bitset with popcount ranks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(((size + 1) // 64 + 1) * 64, np.uint8)  # ranks reach one place beyond
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many bits are set below each place."""
        word = place >> 6
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def places(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


@dataclass
class Aligned:
    """Tokens of some texts and their groups; texts, tokens and groups are each in one row, with bounds."""

    a: np.ndarray
    b: np.ndarray
    cuts: np.ndarray  # the byte after each group
    a_stop: np.ndarray  # tokens up to the end of each group
    b_stop: np.ndarray
    a_bounds: np.ndarray  # of each text's tokens
    b_bounds: np.ndarray
    group_bounds: np.ndarray
    byte_bounds: np.ndarray

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each group on either side."""
        return np.diff(self.a_stop, prepend=0), np.diff(self.b_stop, prepend=0)


class Aligner:
    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.bytes, self.pieces = ByteTokens(byte_path), PieceTokens(piece_path)
        self.n_a, self.n_b = len(self.bytes.raw), len(self.pieces.raw)

    def align(self, texts: list[str]) -> Aligned:
        """Texts that are empty, or whose tokens do not hold exactly their bytes, get no tokens."""
        none = np.zeros(0, np.int64)
        found_a, found_b = [], []
        for text in texts:
            parts = [] if not text else slices(" " + text) if self.pieces.apart else [" " + text]
            whole = [self.pieces.encode(p) for p in parts]
            good = bool(parts) and all(ids is not None for ids in whole)
            found_a.append(np.concatenate([self.bytes.encode(p) for p in parts]) if good else none)
            found_b.append(np.concatenate(whole) if good else none)
        a, b = (np.concatenate([none, *f]) for f in (found_a, found_b))
        a_bounds, b_bounds = (np.cumsum([0, *map(len, f)]) for f in (found_a, found_b))
        a_ends, b_ends = np.cumsum(self.bytes.size[a]), np.cumsum(self.pieces.size[b])
        size = int(a_ends[-1]) if len(a_ends) else 0
        in_a, in_b = Bits.of(a_ends, size), Bits.of(b_ends, size)
        shared = in_a & in_b
        cuts = shared.places()
        byte_bounds = np.concatenate([[0], a_ends])[a_bounds]
        return Aligned(a, b, cuts, in_a.rank(cuts + 1), in_b.rank(cuts + 1), a_bounds, b_bounds, shared.rank(byte_bounds + 1), byte_bounds)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def linked_pairs(x: Aligned, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``(text * n_a + a) * n_b + b`` of all linked ids of each text, in order, and how often it holds each."""
    in_a, in_b = x.counts()
    links, text = in_a * in_b, np.repeat(np.arange(len(x.group_bounds) - 1), np.diff(x.group_bounds))
    a_start, b_start = x.a_stop - in_a, x.b_stop - in_b
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(links <= LISTED)
    upto = np.cumsum(links[small])
    begin = 0
    while begin < len(small):
        done = int(upto[begin - 1]) if begin else 0
        end = max(int(np.searchsorted(upto, done + AT_ONCE, side="right")), begin + 1)
        g = small[begin:end]
        of_a = np.repeat(g, in_a[g])  # the group of each of their tokens
        left = np.repeat(text[of_a] * n_a + x.a[_ranges(a_start[g], in_a[g])], in_b[of_a])
        key = left * n_b + x.b[_ranges(b_start[of_a], in_b[of_a])]
        key, n = np.unique(key, return_counts=True)
        keys.append(key)
        times.append(n)
        begin = end
    for g in np.flatnonzero(links > LISTED).tolist():
        a, times_a = np.unique(x.a[a_start[g] : x.a_stop[g]], return_counts=True)
        b, times_b = np.unique(x.b[b_start[g] : x.b_stop[g]], return_counts=True)
        keys.append((((text[g] * n_a + a) * n_b)[:, None] + b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
    return _summed(np.concatenate(keys), np.concatenate(times))


class _Written:
    """The groups of each text as bytes ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int) -> None:
        table = lambda n, ends: np.array([b"%d%c" % (i, end) for end in ends for i in range(n)], dtype=object)
        self.a, self.b, self.n_a, self.n_b = table(n_a, b",|"), table(n_b, b",;"), n_a, n_b

    def texts(self, x: Aligned) -> Iterator[bytes]:
        in_a, in_b = x.counts()
        whole = np.empty(len(x.a) + len(x.b), dtype=object)
        for table, n, ids, count, stop, other in ((self.a, self.n_a, x.a, in_a, x.a_stop, x.b_stop - in_b), (self.b, self.n_b, x.b, in_b, x.b_stop, x.a_stop)):
            last = np.zeros(len(ids), np.int64)
            last[stop - 1] = n
            whole[np.arange(len(ids)) + np.repeat(other, count)] = table[ids + last]
        bounds = (x.a_bounds + x.b_bounds).tolist()
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            yield b"".join(whole[begin:end].tolist())[:-1]


def _column(batch: pa.RecordBatch | pa.Table, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _aligned_rows(byte_path: str, piece_path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(byte_path, piece_path)
        n_a, n_b = aligner.n_a, aligner.n_b
        written = _Written(n_a, n_b)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                x = aligner.align(texts.to_pylist())
                keys, times = linked_pairs(x, n_a, n_b)
                per = n_a * n_b
                bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * per)
                totals = np.concatenate([[0], np.cumsum(times)])[bounds]
                keys = (keys % per).astype("<i8")
                blobs = [[v[p:q].tobytes() for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] for v in (keys, times.astype("<i8"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        _column(part, "doc_id"),
                        pa.array(np.full(len(texts), block)),
                        *(pa.array(np.diff(v)) for v in (x.a_bounds, x.b_bounds, x.group_bounds, totals)),
                        pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written.texts(x)], pa.string()),
                        *(pa.array(v, pa.binary()) for v in blobs),
                    ],
                    names=ALIGNED.names,
                )
                held += int(x.byte_bounds[-1])
                if held >= BLOCK_BYTES:
                    block, held = block + 1, 0

    return rows


def _numbers(column: pa.Array) -> np.ndarray:
    """The 64-bit integers that the binaries of a column hold, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair, summed over as many batches as the bound on pairs allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        pair, n = _summed(*(np.concatenate(v) for v in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.unique(_numbers(batch.column(0)), return_counts=True))
            size += len(held[-1][0])
            if size > SUMMED:
                merged = out()
                held, size = [(merged.column(0).to_numpy(), merged.column(1).to_numpy())], merged.num_rows
                if size > SUMMED // 2:
                    yield merged
                    held, size = [], 0
    if held:
        yield out()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each block; the documents of a block follow each other."""
    block, held = None, []

    def out() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs)], names=["block", "pair"])

    for batch in batches:
        for this in _column(batch, "block").unique().to_pylist():
            if this != block and held:
                yield out()
                held = []
            block = this
            mine = batch.filter(pa.array(_column(batch, "block").to_numpy() == this))
            held.append(np.unique(_numbers(_column(mine, "pairs"))))
    if held:
        yield out()


def _answered(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """Counts of the links of a block's documents."""
    pair, n = (answers.column(c).to_numpy() for c in ("pair", "n"))
    pair, first = np.unique(pair, return_index=True)  # a block that two tasks read asks twice
    n, best = n[first], answers.column("best").to_numpy()[first]
    high, total = [], []
    for pairs, times in zip(documents.column("pairs").to_pylist(), documents.column("times").to_pylist(), strict=True):
        at, m = np.searchsorted(pair, np.frombuffer(pairs, "<i8")), np.frombuffer(times, "<i8")
        high.append(int(m[best[at]].sum()))
        total.append(int((m * n[at]).sum()))
    named = {c: documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(named | {"n_best": pa.array(high, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": documents.column("groups_sha256")})


def _shaped(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_groups(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Token ids of both vocabularies and the groups between shared cuts, for every row of ``docs``.

    ``doc_id, a_ids, b_ids, groups``; a group has its bytes in a space and the text, and the
    ranges of its tokens on both sides. Null and empty texts, and texts that a
    vocabulary does not give back byte by byte, have no tokens and no groups. Repeated
    rows are aligned each, a null doc_id stays null, a very long text is encoded whole;
    other columns are ignored. An empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                x = aligner.align(texts.to_pylist())
                counts, group_offsets = np.diff(x.group_bounds), pa.array(x.group_bounds, pa.int32())
                origin = [np.repeat(v[:-1], counts) for v in (x.byte_bounds, x.a_bounds, x.b_bounds)]
                fields = []
                for stop, first, kind in zip((x.cuts, x.a_stop, x.b_stop), origin, (pa.int64(), pa.int32(), pa.int32()), strict=True):
                    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
                    fields += [pa.array(start - first, kind), pa.array(stop - first, kind)]
                groups = pa.StructArray.from_arrays(fields, names=["byte_start", "byte_end", "a_start", "a_end", "b_start", "b_end"])
                ids = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((x.a_bounds, x.a), (x.b_bounds, x.b))]
                yield pa.RecordBatch.from_arrays([_column(part, "doc_id"), *ids, pa.ListArray.from_arrays(group_offsets, groups)], names=["doc_id", "a_ids", "b_ids", "groups"])

    return _shaped(docs).mapInArrow(rows, GROUPS)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """``pair, n, best``: documents that hold a pair of ids linked, and whether no pair of its first id has more."""
    counts = aligned.select("pairs").mapInArrow(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "paircounts")
    first = F.floor(F.col("pair") / n_b)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    out = counts.withColumn("a", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    out._scratch = counts._scratch
    return out


def link_profile(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """How the tokens of every row of ``docs`` are linked, against counts over all rows.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. A pair of ids
    counts once for each row that holds it linked (repeated rows count each);
    ``n_best`` are the links whose count is the highest of their first id, ties
    included, ``count_sum`` sums the counts over links, and ``groups_sha256`` hashes the
    groups as written. Null and empty texts, and texts that a vocabulary does not give
    back byte by byte, have no tokens: zeros, and no hash. A null doc_id stays null; a
    very long text is encoded whole; other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch()
    aligned = scratch.keep(_shaped(docs).mapInArrow(_aligned_rows(byte_path, piece_path), ALIGNED), "aligned")
    counts = pair_counts(aligned, PieceTokens(piece_path).model.vocab_size())
    scratch.tables.append(counts)
    asked = aligned.select("block", "pairs").mapInArrow(_asked, "block long, pair long")
    answers = asked.join(counts, "pair").select("block", "pair", "n", "best")
    found = aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered, COUNTED)
    result = materialise(found, "profile")
    scratch.clear()
    return result
