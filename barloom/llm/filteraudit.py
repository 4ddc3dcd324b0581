"""How filters interact: what each removes, in every order in which they can be applied.

Native expressions give each text a mask with a bit per filter that it fails. Documents
are aggregated to a histogram of masks, 32 cells a part, from which every order of
the filters follows: a filter removes the cells that have its bit and none of an earlier filter.

Whether a text has a smaller doc_id elsewhere needs the least doc_id of equal texts. They are
grouped by their SHA-256 instead of the text itself, and rows of a group are summed by part
and label first, so a text that a third of all rows repeat is a few rows in the shuffle.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A filter's bit in a mask is its place here.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: Percent of distinct words and of capitals; words end at white space of ASCII.
_SPACE, _BLANKS, _SIGNS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r", r"[#$%&*|]"


def _bits(failures: list[Column]) -> Column:
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failures)), F.lit(0))


def failure_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``doc_id, part, mask, digest``: the bits of filters A to D, which look at the text alone, for every row.

    A: fewer than 200 words; B: under 50 % of the words are distinct; C: over 3 % of the
    characters are capitals A-Z; D: holds one of ``#$%&*|``. A null text is empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANKS))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)))
    n_words = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failures = [
        n_words < LEAST_WORDS,
        F.size(F.array_distinct("words")).cast("long") * 100 < n_words.cast("long") * LEAST_DISTINCT,
        capitals.cast("long") * 100 > F.length("text").cast("long") * MOST_CAPITALS,
        F.col("text").rlike(_SIGNS),
    ]
    return rows.select("doc_id", "part", _bits(failures).alias("mask"), F.sha2("text", 256).alias("digest"))


def mask_histogram(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, mask, docs, good, toxic``: documents that fail exactly the filters of a mask, and those labelled so.

    Bit E: the text equals that of a smaller doc_id anywhere in the table. Rows that repeat a
    doc_id and its text do not count as smaller; a null doc_id is not compared. A
    document labelled more than once counts as good or toxic if any label says so.
    """
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = failure_masks(docs, part).join(told, "doc_id", "left").fillna(0, ["good", "toxic"])
    same = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("doc_id", *same).agg(F.count("*").alias("times"))
    known = F.col("doc_id").isNotNull()
    grouped = rows.groupBy(*same, known.alias("known")).agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "times")).alias("least"))
    first = F.min(F.when(F.col("known"), F.col("least.doc_id"))).over(Window.partitionBy("digest"))
    passing = F.when(~F.col("known"), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.times")).otherwise(F.lit(0))
    split = grouped.withColumn("first", first).withColumn("passing", passing)
    again = 1 << FILTERS.index("E")
    halves = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("docs")), F.struct((F.col("mask") + again).alias("mask"), (F.col("n") - F.col("passing")).alias("docs")))
    cells = split.select("part", "good", "toxic", F.explode(halves).alias("half")).select("part", "good", "toxic", "half.*").where("docs > 0")
    return cells.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), *[F.sum(F.col("docs") * F.col(c)).alias(c) for c in ("good", "toxic")])


def interactions(cells: DataFrame) -> DataFrame:
    """What each filter does in each of the orders, from the cells of :func:`mask_histogram`.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``; the filter of a step is that letter of the order.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {f: F.instr("filter_order", f) for f in FILTERS}
    steps = steps.withColumn("before", _bits([place[f] < F.col("step") for f in FILTERS])).withColumn("own", _bits([place[f] == F.col("step") for f in FILTERS]))
    earlier, fails = F.col("mask").bitwiseAND(F.col("before")) > 0, F.col("mask").bitwiseAND(F.col("own")) > 0
    total = lambda yes, c="docs": F.sum(F.when(yes, F.col(c)).otherwise(0))
    found = steps.groupBy("part", "filter_order", "step").agg(
        total(~earlier & ~fails).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return found.withColumn("shapley", F.sum("removed").over(of_filter))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """:func:`interactions` of every part of ``docs``, zeros included.

    Parts are the values of column ``part``; null counts as the empty string. Whole texts are
    looked at, however long; a null text is empty. Repeated rows count each. Other
    columns are ignored, whatever their names; an empty table has no parts and gives no rows.
    """
    return interactions(mask_histogram(docs, labels, part))
