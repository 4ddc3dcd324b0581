"""Languages of words in code-switched text: a linear-chain conditional random field.

A word has affixes (its first and last 1 to 4 bytes), runs of three bytes, and its place
in a lexicon of words that several documents of the sample hold; each adds a learned weight per
language, and a learned matrix weighs the step from one word's language to the next
one's. The field is fitted on a bounded sample, equal shares of each language, cut into
runs of words and put together anew, so that steps between languages occur. Forward-backward
gives each word of a whole text its probabilities; a document's are their mean.

Texts are worked on in blocks of words: the blocks' transfer matrices are found
side by side, chained within each document, and replayed, so that a very long document
takes few sequential steps.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialise
from .textscan import U64, Powers, Words, chunks, mix, scan

#: Bound on the sample: learnable rows altogether, of one language, and bytes of a text (longer ones are not learnt from).
FIT_ROWS, FIT_OF_LANGUAGE, FIT_TEXT = 4000, 1000, 16 << 10
#: Coordinates of hashed affixes and runs (a power of two), and words of the lexicon at most.
BITS, LEXICON = 17, 50_000
AFFIXES, RUN = (1, 2, 3, 4), 3
#: Words of a block of forward-backward.
BLOCK = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    rate: float = 0.3
    decay: float = 1e-4
    epochs: int = 2
    together: int = 128  # sequences of a step
    length: int = 64  # words of a sequence
    runs: tuple[int, int] = (8, 40)  # words of one language that are put together


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the field does not learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_sample(docs: DataFrame, language: str = "lang") -> DataFrame:
    """``lang, text`` of a bounded number of learnable rows, an equal share of each language at most.

    Rows are taken in the order of a hash of their id; null ids, null languages, held-out rows,
    texts without a letter and texts of more than ``FIT_TEXT`` bytes are left out. The result is a scratch table.
    """
    text = F.col("text").cast("string")
    usable = docs.where(F.col("doc_id").isNotNull() & F.col(language).isNotNull() & ~is_held_out() & (F.octet_length(text) <= FIT_TEXT))
    usable = usable.select(F.xxhash64(F.col("doc_id").cast("long")).alias("place"), F.col(language).cast("string").alias("lang"), text.alias("text"))
    held = materialise(usable.groupBy("lang").agg(F.count("*").alias("held")), "languages")
    share = max(2, min(FIT_OF_LANGUAGE, FIT_ROWS // max(1, held.count())))
    # few rows beyond the share are ordered
    near = F.pmod("place", F.lit(1 << 20)) < F.lit(1.3 * share * (1 << 20)) / F.col("held") + F.lit(64 << 20) / F.col("held")
    some = usable.join(held, "lang").where(near & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 20)), "place", F.xxhash64("text"))
    sample = materialise(some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= share).select("lang", F.lower("text").alias("text")), "sample")
    discard(held)
    return sample


def language_words() -> np.ndarray:
    """Bytes of words: lower-case ASCII letters, and those of characters beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[97:123] = True
    table[128:] = True
    return table


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def word_features(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers within ``chosen`` and hashed coordinates of the affixes and runs of these words."""
    start, end = words.start[chosen], words.end[chosen]
    length, number = end - start, np.arange(len(chosen))
    of, hashes = [], []
    for n in AFFIXES:
        long = length >= n
        of += [number[long]] * 2
        hashes += [words.span_hash(start[long], start[long] + n) ^ U64(n), words.span_hash(end[long] - n, end[long]) ^ U64(16 + n)]
    runs = np.maximum(length - RUN + 1, 0)
    at = _ranges(start, runs)
    of.append(np.repeat(number, runs))
    hashes.append(words.span_hash(at, at + RUN) ^ U64(32))
    return np.concatenate(of), (mix(np.concatenate(hashes)) >> U64(64 - BITS)).astype(np.int64)


def lexicon_places(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted lexicon; words that are not there take the place behind it."""
    at = np.searchsorted(lexicon, hashes)
    inside = at < len(lexicon)
    inside[inside] = lexicon[at[inside]] == hashes[inside]
    return np.where(inside, at, len(lexicon))


@dataclass
class Field:
    """Weights of the field: of hashed coordinates, of the lexicon and words not in it, of first words and of steps."""

    languages: np.ndarray
    hashed: np.ndarray
    lexicon: np.ndarray
    known: np.ndarray
    first: np.ndarray
    step: np.ndarray

    def emissions(self, of: np.ndarray, coordinates: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Summed weights per word and language."""
        out = self.known[places].astype(np.float64)
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(of, weights=self.hashed[coordinates, k], minlength=len(places))
        return out

    def packed(self) -> bytes:
        blob = io.BytesIO()
        np.savez(blob, **{f.name: getattr(self, f.name) for f in fields(self)})
        return blob.getvalue()

    @staticmethod
    def unpacked(blob: bytes) -> Field:
        with np.load(io.BytesIO(blob)) as held:
            return Field(**{f.name: held[f.name] for f in fields(Field)})


def _normal(x: np.ndarray, axis: int | tuple[int, ...] = -1) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def marginals(emissions: np.ndarray, bounds: np.ndarray, first: np.ndarray, step: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Probabilities of each language for every word of sequences with the given bounds.

    ``emissions`` and the weights are logarithms. Blocks never reach over a bound.
    """
    n, k = emissions.shape
    if not n:
        return np.zeros((0, k))
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    move, begin = np.exp(step - step.max()), np.exp(first - first.max())
    lengths = np.diff(bounds)
    of_doc = -(-lengths // block)  # blocks of each sequence
    doc = np.repeat(np.arange(len(lengths)), of_doc)
    place = _ranges(np.zeros(len(lengths), np.int64), of_doc)  # of a block within its sequence
    start = bounds[doc] + place * block
    size = np.minimum(block, bounds[doc + 1] - start)
    opens = place == 0
    longest = int(size.max())
    at = np.minimum(start[:, None] + np.arange(longest), n - 1)
    inside = np.arange(longest) < size[:, None]
    # transfer matrices
    through = np.where(opens[:, None, None], begin, move)
    for t in range(longest):
        if t:
            through = np.where(inside[:, t, None, None], through @ move, through)
        through = _normal(through * np.where(inside[:, t, None], e[at[:, t]], 1.0)[:, None, :], (1, 2))
    # chained within sequences: what enters a block from the left and from the right
    head = np.cumsum(of_doc) - of_doc
    order = np.argsort(-of_doc, kind="stable")
    enough = np.searchsorted(-of_doc[order], -np.arange(1, int(of_doc.max()) + 1), side="right")  # sequences of more than j blocks
    left, right = np.full((len(doc), k), 1.0 / k), np.full((len(doc), k), 1.0 / k)
    for j in range(1, len(enough)):
        b = head[order[: enough[j]]] + j
        left[b] = _normal(np.einsum("bi,bij->bj", left[b - 1], through[b - 1]))
    for j in range(len(enough) - 1, 0, -1):
        b = head[order[: enough[j]]] + j
        right[b - 1] = _normal(np.einsum("bij,bj->bi", through[b], right[b]))
    # replayed
    ahead = np.empty((longest, len(doc), k))
    a = np.where(opens[:, None], begin, left @ move)
    for t in range(longest):
        if t:
            a = a @ move
        ahead[t] = a = _normal(a * e[at[:, t]])
    out, b = np.empty((n, k)), right
    for t in range(longest - 1, -1, -1):
        here = inside[:, t]
        out[at[here, t]] = _normal(ahead[t][here] * b[here])
        if t:
            b = np.where(here[:, None], _normal((b * e[at[:, t]]) @ move.T), b)
    return out


def _expected(e: np.ndarray, y: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the log-likelihood of equally long labelled sequences (``e``: sequences, words, languages)."""
    s, n, k = e.shape
    bounds = np.arange(s + 1) * n
    p = marginals(e.reshape(-1, k), bounds, first, step, n).reshape(s, n, k)
    x = np.exp(e - e.max(axis=2, keepdims=True))
    move, begin = np.exp(step - step.max()), np.exp(first - first.max())
    a, b = np.empty((n, s, k)), np.empty((n, s, k))
    a[0] = _normal(begin * x[:, 0])
    for t in range(1, n):
        a[t] = _normal((a[t - 1] @ move) * x[:, t])
    b[-1] = 1.0
    for t in range(n - 1, 0, -1):
        b[t - 1] = _normal((b[t] * x[:, t]) @ move.T)
    pairs = _normal(a[:-1, :, :, None] * move * (b[1:] * x.transpose(1, 0, 2)[1:])[:, :, None, :], (2, 3)).sum(axis=(0, 1))
    seen = np.eye(k)[y]
    steps = np.einsum("sti,stj->ij", seen[:, :-1], seen[:, 1:]) - pairs
    return seen - p, (seen[:, 0] - p[:, 0]).sum(axis=0), steps


def train(texts: pa.Array, labels: list[str], settings: Settings = Settings()) -> Field:
    """Fit the field on labelled texts by AdaGrad on the log-likelihood of its sequences."""
    languages = sorted(set(labels))
    y_of = np.array([languages.index(x) for x in labels], np.int64)
    words = scan(texts, language_words(), Powers())
    hashes, first_at, word = np.unique(words.hash, return_index=True, return_inverse=True)
    held = np.bincount(np.unique(words.text.astype(np.int64) * len(hashes) + word) % max(len(hashes), 1), minlength=len(hashes))  # texts of each word
    ranked = np.lexsort((hashes, -held))[:LEXICON]
    lexicon = np.sort(hashes[ranked[held[ranked] >= 2]])
    of, coordinates = word_features(words, first_at)
    places = lexicon_places(lexicon, hashes)
    k = len(languages)
    field = Field(np.array(languages, dtype=str), np.zeros((1 << BITS, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros(k), np.zeros((k, k)))
    squares = [np.full_like(w, 1e-8) for w in (field.hashed, field.known, field.first, field.step)]
    order = np.argsort(of, kind="stable")
    coordinates, row = coordinates[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(hashes)))])
    rng = np.random.default_rng(11)
    for _ in range(settings.epochs):
        stream = _runs(words.bounds, rng, settings.runs)
        usable = len(stream) // settings.length * settings.length
        sequences = stream[:usable].reshape(-1, settings.length) if usable else stream[None, :]
        for i in range(0, len(sequences), settings.together):
            at = sequences[i : i + settings.together]
            used, inverse = np.unique(word[at], return_inverse=True)
            count = row[used + 1] - row[used]
            mine, c = np.repeat(np.arange(len(used)), count), coordinates[_ranges(row[used], count)]
            e = field.emissions(mine, c, places[used])[inverse.reshape(at.shape)]
            d_words, d_first, d_step = _expected(e, y_of[words.text[at]], field.first, field.step)
            g = np.stack([np.bincount(inverse.ravel(), weights=d_words[..., j].ravel(), minlength=len(used)) for j in range(k)], axis=1)
            touched, slot = np.unique(c, return_inverse=True)
            g_hashed = np.stack([np.bincount(slot, weights=g[mine, j], minlength=len(touched)) for j in range(k)], axis=1)
            lex, slot = np.unique(places[used], return_inverse=True)
            g_known = np.stack([np.bincount(slot, weights=g[:, j], minlength=len(lex)) for j in range(k)], axis=1)
            whole = (field.hashed, touched, g_hashed), (field.known, lex, g_known), (field.first, slice(None), d_first), (field.step, slice(None), d_step)
            for (w, rows, grad), square in zip(whole, squares, strict=True):
                grad = grad / len(at) - settings.decay * w[rows]
                square[rows] += grad * grad
                w[rows] += settings.rate * grad / np.sqrt(square[rows])
    field.hashed, field.known = field.hashed.astype(np.float32), field.known.astype(np.float32)
    return field


def _runs(bounds: np.ndarray, rng: np.random.Generator, lengths: tuple[int, int]) -> np.ndarray:
    """All word numbers, cut into runs within texts, the runs in random order."""
    cuts = [bounds]
    mean = sum(lengths) / 2
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        inner = a + np.cumsum(rng.integers(*lengths, int((b - a) / mean) + 1))
        cuts.append(inner[inner < b])
    cuts = np.unique(np.concatenate(cuts))
    order = rng.permutation(len(cuts) - 1)
    return _ranges(cuts[:-1][order], np.diff(cuts)[order])


def fit(docs: DataFrame, language: str = "lang", settings: Settings = Settings()) -> Field | None:
    """Fit on a bounded sample in one task; None if there is no row to learn from.

    The driver gets the weights alone: ``2**BITS`` and at most ``LEXICON`` rows of them for each language.
    """
    sample = language_sample(docs, language)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        rows.sort()  # the order of arrival must not matter
        if rows:
            field = train(pa.array([t for _, t in rows], pa.large_string()), [x for x, _ in rows], settings)
            yield pa.RecordBatch.from_arrays([pa.array([field.packed()], pa.binary())], names=["field"])

    found = sample.select("lang", "text").repartition(1).mapInArrow(fitted, "field binary").collect()
    discard(sample)
    return Field.unpacked(bytes(found[0].field)) if found else None


def _probabilities(field: Field, texts: pa.Array, powers: Powers) -> tuple[Words, np.ndarray]:
    """The words of some texts and each one's probabilities."""
    words = scan(texts, language_words(), powers)
    hashes, at, word = np.unique(words.hash, return_index=True, return_inverse=True)
    of, coordinates = word_features(words, at)
    e = field.emissions(of, coordinates, lexicon_places(field.lexicon, hashes))[word]
    return words, marginals(e, words.bounds, field.first, field.step)


def _shaped(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(r"\p{L}"), F.lower(text)).alias("text"))


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """Runs of words of one language in every row's whole text: ``doc_id, n_words, runs``.

    A run has its first and last word (from 0), its language and the mean probability
    of that. Words are runs of letters; digits and ASCII signs end them. Texts without
    a letter, and null ones, have no words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                words, p = _probabilities(shared.value, texts, powers)
                best = p.argmax(axis=1)
                new = np.ones(len(best), bool)
                new[1:] = (best[1:] != best[:-1]) | (words.text[1:] != words.text[:-1])
                first = np.flatnonzero(new)
                stop = np.append(first[1:], len(best))[: len(first)]
                mean = np.add.reduceat(p[np.arange(len(best)), best], first) / (stop - first) if len(first) else np.zeros(0)
                origin = words.bounds[words.text[first]]
                runs = pa.StructArray.from_arrays(
                    [pa.array(first - origin), pa.array(stop - 1 - origin), pa.array(shared.value.languages[best[first]].tolist(), pa.string()), pa.array(mean)], names=["first", "last", "lang", "probability"]
                )
                offsets = pa.array(np.searchsorted(first, words.bounds), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(offsets, runs)], names=["doc_id", "n_words", "runs"])

    return _shaped(docs).mapInArrow(rows, "doc_id long, n_words long, runs array<struct<first: long, last: long, lang: string, probability: double>>")


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the language with the highest mean probability over
    all words, and that mean. Texts that are null or have no letter get ``und`` and 0, and so do all without a field."""
    if field is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, languages = Powers(), [*shared.value.languages.tolist(), UNKNOWN]
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                words, p = _probabilities(shared.value, texts, powers)
                n = np.diff(words.bounds)
                mean = np.stack([np.bincount(words.text, weights=p[:, k], minlength=len(texts)) for k in range(p.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
                best = np.where(n > 0, mean.argmax(axis=1), len(languages) - 1)
                score = np.clip(mean.max(axis=1), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([languages[i] for i in best.tolist()], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return _shaped(docs).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def classify(docs: DataFrame, language: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    The field learns from a bounded sample of rows that are not held out; the language, the
    source and the id are no inputs of a prediction. Texts that are null, empty or have no
    letter get ``und`` and score 0. A null doc_id stays null and is not held out; repeated rows
    are predicted each; of equally likely languages the first by name is taken; a very long text is
    read whole. Other columns are ignored. An empty table gives no rows; with no row to
    learn from every prediction is ``und``.
    """
    found = identify(docs, fit(docs, language))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
