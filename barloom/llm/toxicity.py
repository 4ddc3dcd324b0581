"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text are the presence of its words, word pairs, skip-grams (pairs with
one word between) and word stems, hashed into ``2**BITS`` coordinates. A stem is the
beginning of a longer word, of 4 to 8 bytes: languages that build words from parts
carry their signal there. FTRL-proximal with per-coordinate rates and L1 leaves few
weights other than zero; these are broadcast. Scoring reads a text once and looks at
the coordinates with a weight alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, free_name, materialise
from .textscan import U64, Powers, Words, chunks, letter_words, mix, scan

BITS = 21
STEMS = (4, 5, 6, 7, 8)
#: Labelled rows that the model is fitted on, and bytes of their texts, at most.
FIT_ROWS, FIT_BYTES = 10_000, 64 << 20
#: A text longer than this share of the bytes is not learnt from.
FIT_TEXT = 1 / 64

_PAIR, _SKIP = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 5


def is_held_out(doc_id="doc_id"):
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = FIT_BYTES) -> DataFrame:
    """``doc_id, label, text`` of at most ``most`` learnable labelled ids and ``most_bytes`` of text.

    Ids are taken in the order of a hash. Labels outside 0 and 1, null ids, held-out
    rows and texts of more than a 64th of the bytes are left out; an id labelled more than
    once counts by its largest label, and of an id's texts the one with the least hash is
    read. Where the bytes don't suffice, the first id of each label stays. The result is a scratch table.
    """
    place = F.xxhash64("doc_id")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~is_held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    n = usable.count()
    share = F.pmod(place, F.lit(1 << 20)) / F.lit(float(1 << 20))
    near = usable if n <= most else usable.where(share < 1.2 * most / n)  # so that few rows are ordered
    chosen = near.orderBy(share, place).limit(most)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).where(F.octet_length("text") <= int(most_bytes * FIT_TEXT)).join(F.broadcast(chosen), "doc_id")
    sample = materialise(held.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    first = F.row_number().over(Window.partitionBy("label").orderBy(share, place)) == 1
    sized = sample.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), first.alias("first"))
    if (sized.agg(F.sum("bytes")).first()[0] or 0) <= most_bytes:
        return sample
    upto = Window.orderBy(F.desc("first"), share, place).rowsBetween(Window.unboundedPreceding, 0)  # of at most ``most`` rows
    within = sized.withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") <= most_bytes).select("doc_id")
    bounded = materialise(sample.join(F.broadcast(within), "doc_id", "left_semi"), "sample")
    discard(sample)
    return bounded


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of text number and 64-bit feature hash, in several streams."""
    h, text = words.hash, words.text
    out = [(text, h)]
    if len(h) > 1:
        same = text[1:] == text[:-1]
        out.append((text[1:][same], mix(h[:-1] * _PAIR + h[1:])[same]))
    if len(h) > 2:
        same = text[2:] == text[:-2]
        out.append((text[2:][same], mix(h[:-2] * _SKIP + h[2:] + U64(1))[same]))
    length = words.end - words.start
    for n in STEMS:
        longer = length > n
        start = words.start[longer]
        out.append((text[longer], words.span_hash(start, start + n) ^ U64(n)))
    return out


def _coordinates(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int32)


def _featurise(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kind = Powers(), letter_words()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                found = features(scan(texts, kind, powers))
                text = np.concatenate([t for t, _ in found]).astype(np.int64)
                key = np.unique((text << bits) | _coordinates(np.concatenate([h for _, h in found]), bits))
                bounds = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) << bits)
                values = (key & ((1 << bits) - 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("label")).cast(pa.int32()), lists], names=["label", "features"])

    return rows


def ftrl(examples: list[tuple[float, np.ndarray]], bits: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights other than zero, and the bias, after some passes over the examples."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    a, b, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2
    rng = np.random.default_rng(7)
    for _ in range(settings.epochs):
        for i in rng.permutation(len(examples)).tolist():
            y, x = examples[i]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((b + root) / a + l2))
            bias = -zb / ((b + nb**0.5) / a)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            z[x] += g - (np.sqrt(nx + g * g) - root) / a * w
            n[x] = nx + g * g
            step = ((nb + g * g) ** 0.5 - nb**0.5) / a
            zb, nb = zb + g - step * bias, nb + g * g
    kept = np.flatnonzero(np.abs(z) > l1)
    weights = (np.sign(z[kept]) * l1 - z[kept]) / ((b + np.sqrt(n[kept])) / a + l2)
    return kept, weights, -zb / ((b + nb**0.5) / a)


def _trainer(bits: int, settings: Settings):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[float, np.ndarray]] = []
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            examples += [(float(y), values[p:q].copy()) for y, p, q in zip(labels, bounds[:-1], bounds[1:], strict=True)]
        # the order of arrival must not matter
        examples.sort(key=lambda e: (e[0], len(e[1]), zlib.crc32(e[1])))
        if not examples:
            return
        kept, weights, bias = ftrl(examples, bits, settings)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1), pa.int64()), pa.array(np.append(weights, bias), pa.float64())], names=["coordinate", "weight"])

    return train


@dataclass(frozen=True)
class Model:
    bits: int
    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    learnt: bool = True  # from any row


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS, bits: int = BITS, settings: Settings = Settings()) -> Model:
    """Fit on a sample of labelled rows of documented size and bytes, in one task.

    What the driver gets are the weights that L1 leaves, at most ``2**bits`` of them.
    """
    sample = labelled_sample(docs, labels, label, most)
    found = sample.mapInArrow(_featurise(bits), "label int, features array<int>")
    rows = found.repartition(1).mapInArrow(_trainer(bits, settings), "coordinate long, weight double").toPandas()
    learnt = len(rows)
    discard(sample)
    bias = float(rows.loc[rows.coordinate < 0, "weight"].sum())
    rows = rows[rows.coordinate >= 0].sort_values("coordinate")
    return Model(bits, rows.coordinate.to_numpy(np.int64), rows.weight.to_numpy(np.float64), bias, bool(learnt))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        slot = np.full(1 << model.bits, -1, dtype=np.int32)
        slot[model.coordinates] = np.arange(len(model.coordinates))
        powers, kind = Powers(), letter_words()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                keys = []
                for text, hashes in features(scan(texts, kind, powers)):
                    found = slot[_coordinates(hashes, model.bits)]
                    hit = found >= 0
                    keys.append((text[hit].astype(np.int64) << 32) | found[hit])
                key = np.unique(np.concatenate(keys))
                total = np.bincount(key >> 32, weights=model.weights[key & 0xFFFFFFFF], minlength=len(texts)) + model.bias
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(part.num_columns - 1)), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))],
                    names=[*part.schema.names[:-1], "score"],
                )

    return score


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` (the text not among them) and ``score``, the probability that a whole text is toxic.

    Null and empty texts get the score of a text without features. Repeated rows are
    scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_scorer(shared), T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels are learnt from rows whose held-out test is false; ids, languages, sources
    and labels are no inputs of a score. Null and empty texts are scored as texts without
    features, a null doc_id stays null and is not held out, repeated rows are scored each,
    a very long text is scored whole. Other columns are ignored; an empty table gives no
    rows, and without labels every score is one half.
    """
    model = fit(docs, labels)
    scored = score_documents(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole, whose text is not judged toxic.

    A row's text alone decides, so repeated rows share their fate; null and empty texts are
    judged as texts without features, very long ones whole. Other columns are kept,
    whatever their names; an empty table gives no rows, and without any labelled row all rows stay.
    """
    model, names = fit(docs, labels), docs.columns
    if not model.learnt:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = free_name(names, "_text")
    rows = docs.withColumn(extra, F.col("text").cast("string"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared)
        for batch in batches:
            inner = batch.select([extra]).rename_columns(["text"])
            scores = [b.column(b.num_columns - 1).to_numpy() for b in score(iter([inner]))]
            yield batch.select(names).filter(pa.array(np.concatenate([*scores, np.zeros(0)]) < threshold))

    return rows.mapInArrow(keep, T.StructType(docs.schema.fields))
