"""Quality: a regularised quadratic discriminant over transformed document statistics.

A scan of the text gives each document a short vector of statistics, transformed to be
near normal within a class (square roots of shares, logarithms of counts). Class means
and covariances come from one aggregation over a labelled sample; covariances are
shrunk towards their diagonal and factored once. A score is the calibrated difference
of the two log densities, each a Mahalanobis distance through the cached inverse
Cholesky factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, free_name, materialise
from .textscan import Powers, chunks, raw_bytes, scan, space_words
from .toxicity import is_held_out, labelled_sample

#: Labelled rows that the moments are taken of, and bytes of their texts, at most.
FIT_ROWS, FIT_BYTES = 20_000, 128 << 20
SHRINKAGE = 0.05
#: Added to the variances, which some statistics have hardly any of.
FLOOR = 5e-3
#: Log-density differences are calibrated within these bounds.
EXTREME = 40.0
NAMES = (
    "words", "upper", "symbols", "digits", "word_length", "repeats", "distinct",
    "lines_repeated", "line_length", "pipes", "bangs", "stops", "short_words",
)


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many positions with a flag lie in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each text."""
    out = np.zeros(n)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        out[i] = len(np.unique(hashes[a:b]))
    return out


def statistics(texts: pa.Array, powers: Powers, kind: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; an empty text has the values of no words."""
    n = len(texts)
    raw, offsets = raw_bytes(texts)
    words = scan(texts, kind, powers)
    size = np.maximum(np.diff(offsets), 1)
    count = np.diff(words.bounds)
    some = np.maximum(count, 1)
    upper = _within((raw >= 65) & (raw <= 90), offsets)
    lower = _within((raw >= 97) & (raw <= 122), offsets)
    digits = _within((raw >= 48) & (raw <= 57), offsets)
    plain = np.zeros(256, dtype=bool)
    plain[[33, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True
    symbols = _within(plain[raw], offsets)
    pipes, bangs, stops = (_within(raw == x, offsets) for x in (124, 33, 46))
    length = words.end - words.start
    same = np.zeros(len(words.hash), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    per_text = lambda x: np.bincount(words.text, weights=x, minlength=n)
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = starts[starts < len(raw)]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(raw))[: len(starts)]
    lines = np.maximum(np.bincount(owner, minlength=n), 1)
    distinct_lines = np.maximum(_distinct(owner, words.span_hash(starts, ends), n), 1)
    distinct_words = np.maximum(_distinct(words.text, words.hash, n), 1)
    rows = np.stack(
        [
            np.log1p(count),
            np.sqrt(upper / np.maximum(upper + lower, 1)),
            np.sqrt(symbols / size),
            np.sqrt(digits / size),
            np.log(np.maximum(per_text(length), 1) / some),
            np.sqrt(per_text(same) / some),
            np.log(distinct_words + 1) / np.log(some + 1),
            np.sqrt(1 - distinct_lines / lines),
            np.log1p(count / lines),
            np.sqrt(pipes / some),
            np.sqrt(bangs / some),
            np.sqrt(stops / some),
            np.sqrt(per_text(length <= 3) / some),
        ],
        axis=1,
    )
    return rows


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, kind = Powers(), space_words()
    for batch in batches:
        for part, texts in chunks(batch, "text"):
            rows = statistics(texts, powers, kind)
            label = part.column(part.schema.get_field_index("label")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([label, *(pa.array(c) for c in rows.T)], names=["label", *NAMES])


@dataclass(frozen=True)
class Model:
    means: np.ndarray  # class, statistic
    factors: np.ndarray  # class: inverse Cholesky factors
    constants: np.ndarray  # class: log prior less half the log determinant
    slope: float
    offset: float
    learnt: bool = True  # from any row

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with priors."""
        logs = [c - 0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return np.clip(logs[1] - logs[0], -EXTREME, EXTREME)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(rows) + self.offset, -35, 35)))


def _moments(sample: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of each class by one aggregation."""
    k = len(NAMES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)]
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for row in sample.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        n, mean = float(row["n"]), np.array([row[f"s{i}"] for i in range(k)]) / row["n"]
        cov = np.zeros((k, k))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / n - mean[i] * mean[j]
        out[row["label"]] = (n, mean, cov)
    return out


def _calibrate(model: Model, sample: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic fit to the differences, from counts of tenths."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(i + 1).to_numpy() for i in range(len(NAMES))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.difference(rows) * 10).astype(np.int64))], names=["label", "tenth"])

    counts = sample.mapInArrow(binned, "label int, tenth long").groupBy("label", "tenth").count().toPandas()
    x, y, w = counts["tenth"].to_numpy() / 10, counts["label"].to_numpy(float), counts["count"].to_numpy(float)
    design, beta = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    loss = lambda v: float((w * np.logaddexp(0, np.where(y > 0, -1, 1) * (design @ v))).sum()) + 5e-4 * float(v @ v)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        gradient = design.T @ (w * (p - y)) + 1e-3 * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step, now = np.linalg.solve(hessian, gradient), loss(beta)
        while np.abs(step).max() > 1e-9 and loss(beta - step) > now:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS, shrinkage: float = SHRINKAGE) -> Model:
    """Class moments, factors and calibration from a labelled sample of documented size.

    A class without rows has the other's mean and covariance and the prior of half a
    row; without any labelled row every score is one half.
    """
    texts = labelled_sample(docs, labels, label, most, FIT_BYTES)
    sample = materialise(texts.mapInArrow(_measure, "label int, " + ", ".join(f"{n} double" for n in NAMES)), "statistics")
    discard(texts)
    k, found = len(NAMES), _moments(sample)
    none = next(iter(found.values()), (0.0, np.zeros(k), np.eye(k)))
    total = sum(n for n, _, _ in found.values()) + 1
    means, factors, constants = [], [], []
    for c in (0, 1):
        n, mean, cov = found.get(c, (0.0, *none[1:]))
        shrunk = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + FLOOR * np.eye(k)
        lower = np.linalg.cholesky(shrunk)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log((n + 0.5) / total) - np.log(np.diag(lower)).sum())
    model = Model(np.array(means), np.array(factors), np.array(constants), 1.0, 0.0)
    slope, offset = _calibrate(model, sample) if found else (0.0, 0.0)
    discard(sample)
    return Model(model.means, model.factors, model.constants, slope, offset, bool(found))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are ignored, and ids, languages,
    sources and labels are no inputs of a score. Null and empty texts are scored by
    the statistics of no words, very long ones whole; a null doc_id stays null and is not
    held out; repeated rows are scored each; an empty table gives no rows.
    """
    model = fit(docs, labels)
    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kind = Powers(), space_words()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(texts, powers, kind)))], names=["doc_id", "score"])

    scored = shaped.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, whole, whose text is judged of good quality.

    A row's text alone decides, so repeated rows share their fate; null and empty texts are
    judged by the statistics of no words, very long ones whole. Other columns are kept,
    whatever their names; an empty table gives no rows, and without any labelled row all rows stay.
    """
    model, names = fit(docs, labels), docs.columns
    if not model.learnt:
        return docs
    extra = free_name(names, "_text")
    rows = docs.withColumn(extra, F.col("text").cast("string"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kind = Powers(), space_words()
        for batch in batches:
            for part, texts in chunks(batch, extra):
                good = model.score(statistics(texts, powers, kind)) >= threshold
                yield part.select(names).filter(pa.array(good))

    return rows.mapInArrow(keep, T.StructType(docs.schema.fields))
