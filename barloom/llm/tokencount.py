"""Exact token-length histogram and what follows from it by suffix sums."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise
from .textscan import chunks

#: Lengths that share a bucket of the two-level sums.
SPAN = 256
#: White space of so many characters is encoded apart: a pattern that looks ahead recurses over it.
LONG_SPACE = 4096
_LONG = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")


def parts_of(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text whose ids are those of the text, and whether a part is one long run of white space.

    A run's last character goes with what follows it, as the pattern has it.
    """
    begin = 0
    for run in _LONG.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield text[begin : run.start()], False
        yield text[run.start() : end], True
        begin = end
    yield text[begin:], False


def _counter(path: str, pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode, run = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (pattern, r"\s+"))
        length = lambda t: sum(len(run(x) if apart else encode(x)) for x, apart in parts_of(t))
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([length(t) for t in texts.to_pylist()], pa.int64())], names=["n_tokens"])

    return count


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``n_tokens`` of every row's whole text (null or empty: 0)."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(ranks_path, pattern), "n_tokens long")


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Documents per encoded length, with suffix sums.

    ``docs`` needs ``text``; other columns are ignored, repeated rows count each.
    One row per length that occurs: ``n_tokens, n_docs, tokens`` (of these
    documents), ``docs_at_least, tokens_at_least`` (suffix sums from this length),
    ``docs_total, tokens_total``, ``quantile`` (share of documents at most this
    long) and ``truncated_total``, the tokens that are left if every document is cut
    to a context of ``n_tokens``. Between two rows all of these follow from the
    next row, see :func:`at_limits`. An empty table gives no rows.

    A very long text is encoded whole, long runs of white space apart from what surrounds
    them, which gives the same ids. The histogram is written once, as it is read
    several times; the sums run in two levels, within spans of lengths and over the
    spans, so no task holds more than a span or the list of spans.
    """
    histogram = materialise(encoded_lengths(docs, ranks_path, pattern).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")
    histogram = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    inner = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    own = histogram.withColumn("docs_in", F.sum("n_docs").over(inner)).withColumn("tokens_in", F.sum("tokens").over(inner))
    whole = Window.partitionBy("span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("_docs", F.sum("n_docs").over(whole)).withColumn("_tokens", F.sum("tokens").over(whole))
    spans = own.groupBy("span").agg(F.first("_docs").alias("_d"), F.first("_tokens").alias("_t"))
    outer = Window.orderBy(F.desc("span"))
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select(
        "span",
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("tokens_after"),
        F.sum("_d").over(total).alias("docs_total"),
        F.sum("_t").over(total).alias("tokens_total"),
    )
    joined = own.join(spans, "span")
    docs_at_least = F.col("docs_in") + F.col("docs_after")
    tokens_at_least = F.col("tokens_in") + F.col("tokens_after")
    return joined.select(
        "n_tokens",
        "n_docs",
        "tokens",
        docs_at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        "docs_total",
        "tokens_total",
        ((F.col("docs_total") - docs_at_least + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
        (F.col("tokens_total") - tokens_at_least + F.col("n_tokens") * docs_at_least).alias("truncated_total"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Documents and tokens for given context limits, from a histogram's rows.

    ``context, docs_over`` (longer than the limit), ``tokens_kept`` and
    ``tokens_cut``; a limit above every length cuts nothing.
    """
    contexts = F.explode(F.array(*[F.lit(int(x)) for x in limits]))
    over = F.col("n_tokens") > F.col("context")
    return (
        histogram.withColumn("context", contexts)
        .groupBy("context")
        .agg(
            F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
            F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("tokens_kept"),
            F.sum(F.when(over, (F.col("n_tokens") - F.col("context")) * F.col("n_docs")).otherwise(0)).alias("tokens_cut"),
        )
    )
