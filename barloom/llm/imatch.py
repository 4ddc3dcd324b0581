"""Document fingerprints by I-Match, with DataFrame functions only.

Terms whose document frequency lies in a band are the lexicon. A document's terms of
the lexicon, distinct and sorted, are hashed once for each of several randomised
subsets of it. Documents that share many of these hashes share most of their terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialise

#: A level has ``SUBSETS`` subsets, each with one in so many of the lexicon's terms, at
#: random: thick ones tell short texts apart, thin ones survive edits of long texts. The
#: first level divides the whole lexicon, so that every term enters a fingerprint.
LEVELS, SUBSETS = (8, 32, 128, 512), 8
#: The band, as shares of all documents that have a term. With d distinct terms in a
#: document on average, at most d / LEAST_SHARE terms are in it, whatever the corpus.
LEAST_SHARE, MOST_SHARE = 0.002, 0.25
#: A lexicon of up to so many terms (16 bytes each) is broadcast; a larger one is joined by shuffling.
BROADCAST_TERMS = 500_000
#: Stands for a null doc_id, and so comes last in descending order.
NO_ID = -(1 << 63)


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def lexicon(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """``term`` (64-bit hash) of every term within the band; two documents at least."""
    n = docs.count()
    counted = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).where("word <> ''").groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= max(2, least_share * n)) & (F.col("df") <= max(2, most_share * n))).select("term")


def _followers(docs: DataFrame) -> DataFrame:
    """``key, follower, need``: for each document the next one in descending order of id,
    after the last the first, and how many of its characters are needed.

    Only ids and lengths are sorted, by ranges; a range's end looks up the first id of
    the next range, of which there is one row per range.
    """
    ids = docs.groupBy("key").agg(F.max(F.floor(F.length("text") / 3)).alias("need"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(ids.repartitionByRange(parts, F.desc("key")).withColumn("part", F.spark_partition_id()), "order")
    firsts = ranged.groupBy("part").agg(F.max("key").alias("first"))
    by_part = Window.orderBy("part")
    ends = firsts.select("part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(by_part)).alias("after"))
    inner = Window.partitionBy("part").orderBy(F.desc("key"))
    return ranged.withColumn("inside", F.lead("key").over(inner)).join(ends, "part").select("key", F.coalesce("inside", "after").alias("follower"), "need")


def _slots(term: Column) -> Column:
    """Numbers of the subsets that hold a term: one at most of each level."""
    places = [F.pmod(F.xxhash64(term, F.lit(seed)), F.lit(n)) for seed, n in enumerate(LEVELS)]
    return F.array_compact(F.array(*[F.when(p < SUBSETS, p + i * SUBSETS).cast("int") for i, p in enumerate(places)]))


def _hash_of(terms: Column) -> Column:
    """The hash of a subset's distinct terms in order; null where there are none."""
    return F.when(F.size(terms) > 0, F.xxhash64(F.sort_array(terms)))


def _blank(hashes: Column) -> Column:
    return ~F.exists(hashes, lambda h: h.isNotNull())


def _text_of(hashes: Column, plain: Column) -> Column:
    """The fingerprint as a string; a text without lexicon terms has its own hash instead."""
    joined = F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), ".")
    return F.coalesce(F.concat(F.lit("text-"), plain), joined)


def _likeness(a: Column, plain_a: Column, b: Column, plain_b: Column) -> Column:
    """Share of subsets with equal hashes, among those where either has one."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    either = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    return F.when(plain_a == plain_b, 1.0).when(either > 0, equal / either).otherwise(0.0).cast("double")


def fingerprints(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    ``docs`` needs ``doc_id`` and ``text`` (null: empty); other columns are ignored.
    The edited text has its last third replaced by the beginning of the next document
    in descending order of id. One row per input row: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Rows
    that repeat an id and a text give equal rows. Where an id has several texts, the
    least of them stands for it as a next document. A null id comes last. A very long text
    is one row's work. An empty table gives no rows.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = materialise(lexicon(docs, least_share, most_share), "lexicon")
    order = materialise(_followers(docs), "followers")
    lent = order.select(F.col("follower").alias("key"), F.col("key").alias("borrower"), "need")
    pieces = docs.join(lent, "key").select("borrower", F.expr("substring(text, 1, cast(need as int))").alias("piece")).groupBy("borrower").agg(F.min("piece").alias("piece"))
    whole = docs.join(pieces, F.col("key") == F.col("borrower")).select("key", "text", "piece", F.length("text").alias("n"))
    whole = whole.withColumn("edited", F.expr("concat(substring(text, 1, n - cast(floor(n / 3) as int)), substring(piece, 1, cast(floor(n / 3) as int)))"))

    # words that lie in both texts are split once: those before the last separator of what is kept
    kept = F.expr("substring(text, 1, n - cast(floor(n / 3) as int))")
    whole = whole.withColumn("shared", F.regexp_extract(kept, r"(?s)^(.*)[^\p{L}\p{N}]", 1))
    rest = lambda c: F.expr(f"substring({c}, length(shared) + 1)")
    own = F.struct(F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.md5("text").alias("plain"), F.md5("edited").alias("edited_plain"))
    whole = whole.withColumn("copy", F.xxhash64("text"))
    # what a text has but once stays off the rows of its words
    owns = whole.select("key", "copy", own.alias("own")).groupBy("key", "copy").agg(F.first("own").alias("own"), F.count("*").alias("times"))
    split = whole.select("key", "copy", _words(F.col("shared")).alias("both"), _words(rest("text")).alias("first"), _words(rest("edited")).alias("second"))
    sized = split.select("key", "copy", F.size("both").alias("upto"), (F.size("both") + F.size("first")).alias("then"), F.posexplode(F.concat("both", "first", "second")).alias("at", "word"))
    entries = sized.select("key", "copy", "upto", "then", "at", F.xxhash64("word").alias("term"))
    entries = entries.join(F.broadcast(words) if words.count() <= BROADCAST_TERMS else words, "term")
    spread = entries.withColumn("slot", F.explode(_slots(F.col("term"))))
    first = F.col("at") < F.col("then")
    second = (F.col("at") < F.col("upto")) | (F.col("at") >= F.col("then"))
    by_slot = spread.groupBy("key", "copy", "slot").agg(_hash_of(F.collect_set(F.when(first, F.col("term")))).alias("h"), _hash_of(F.collect_set(F.when(second, F.col("term")))).alias("e"))
    slots = range(len(LEVELS) * SUBSETS)
    of_slot = lambda c: F.array(*[F.max(F.when(F.col("slot") == s, F.col(c))) for s in slots])
    hashed = by_slot.groupBy("key", "copy").agg(of_slot("h").alias("hashes"), of_slot("e").alias("edited_hashes"))
    none = F.array(*[F.lit(None).cast("long") for _ in slots])
    hashed = owns.join(hashed, ["key", "copy"], "left").select("key", "times", F.col("own.n_chars").alias("n_chars"), F.col("own.sha").alias("sha"), "own", F.coalesce("hashes", none).alias("hashes"), F.coalesce("edited_hashes", none).alias("edited_hashes"))
    printed = hashed.withColumn("plain", F.when(_blank(F.col("hashes")), F.col("own.plain"))).withColumn("edited_plain", F.when(_blank(F.col("edited_hashes")), F.col("own.edited_plain"))).drop("own")
    printed = materialise(printed, "fingerprints")
    discard(words)

    following = printed.groupBy(F.col("key").alias("follower")).agg(F.min(F.struct("hashes", "plain")).alias("next"))
    rows = printed.join(order.select("key", "follower"), "key").join(following, "follower").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    hashes, plain = F.col("hashes"), F.col("plain")
    return rows.select(
        F.when(F.col("key") != F.lit(NO_ID), F.col("key")).alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        _text_of(hashes, plain).alias("fingerprint"),
        _text_of(F.col("edited_hashes"), F.col("edited_plain")).alias("edited_fingerprint"),
        _likeness(hashes, plain, F.col("edited_hashes"), F.col("edited_plain")).alias("near_edited"),
        _likeness(hashes, plain, F.col("next.hashes"), F.col("next.plain")).alias("near_next"),
    )
