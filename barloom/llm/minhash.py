"""Near-duplicate documents: universal hash minima, banding, verification, components.

1. A scan turns each text into its set of distinct word shingles, ``BANDS * ROWS``
   minima of universal hashes (multiply and add modulo 2^64), one key per band and a
   short signature of the minima.
2. Texts with equal sets form a class, worked on by its least document.
3. Class members are linked to the least member of each band bucket. Pairs pass a
   signature test that is wider than its error, then an exact test on full sets.
4. Buckets that still span several components are finished exactly. Pairs of small
   buckets are listed. Members of large buckets go through a prefix-filter join:
   a pair over the threshold shares one of the rarest shingles of each side, and a
   shingle that no other member has starts no pair. Members that reach a common
   shingle within their prefix are first linked to the most central of them; what stays
   outside the main component is joined with the rest, where the smaller set of a pair
   must have the shingle in a shorter prefix.
5. Components by large-star and small-star.

Band keys, classes and hubs that hold a large share of all rows are salted.

With 24 bands of 4 rows, a pair at similarity 0.85 shares no band with probability
2e-8, at 0.8 with 3e-6, and less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import skew  # noqa: F401
from .components import connected_components
from .idfilter import marked
from .skew import hot_keys, join_split
from .storage import Scratch, discard, free_name, materialise, unbroadcast
from .textscan import U64, Powers, chunks, mix, scan, shingle_sets, space_words

BANDS, ROWS, WIDTH = 24, 4, 5
#: Buckets (and prefix shingles) of at most so many members are joined with themselves.
LISTED = 64
#: Standard errors by which an estimate from the signature may lie under the threshold.
SLACK = 5.5

SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("signature", T.BinaryType()),
    ]
)
SETS = "doc_id long, set_a long, set_b long, shingles binary"
SIZED = "doc_id long, text_a long, text_b long, set_a long, set_b long, n long"


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U64)
    return a, b


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _set_hashes(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=U64).view(np.int64)), int(mix(s ^ U64(0xABCDEF)).sum(dtype=U64).view(np.int64))


def _signer(bands: int, rows: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kind = Powers(), space_words()
        a, b = _hash_family(bands * rows)
        weights = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
        tags = mix(np.arange(1000, 1000 + bands, dtype=U64))
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = shingle_sets(scan(texts, kind, powers), width)
                keys, signatures, counts, set_a, set_b = [], [], [], [], []
                for s in sets:
                    counts.append(len(s))
                    if not len(s):
                        keys.append(None)
                        signatures.append(b"")
                        set_a.append(0)
                        set_b.append(0)
                        continue
                    least = np.full(bands * rows, ~U64(0), dtype=U64)
                    for i in range(0, len(s), 4096):  # a very long text in blocks
                        block = np.multiply.outer(a, s[i : i + 4096])
                        block += b[:, None]
                        np.minimum(least, block.min(axis=1), out=least)
                    keys.append(mix((least.reshape(bands, rows) * weights).sum(axis=1, dtype=U64) + tags).view(np.int64))
                    signatures.append((mix(least) & U64(255)).astype(np.uint8).tobytes())
                    first, second = _set_hashes(s)
                    set_a.append(first)
                    set_b.append(second)
                yield pa.RecordBatch.from_arrays(
                    [
                        _column(part, "doc_id").cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(set_a, pa.int64()),
                        pa.array(set_b, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(signatures, pa.binary()),
                    ],
                    names=SIGNED.names,
                )

    return sign


def _setter(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kind = Powers(), space_words()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                found = shingle_sets(scan(texts, kind, powers), width)
                a, b = zip(*map(_set_hashes, found), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [_column(part, "doc_id").cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["doc_id", "set_a", "set_b", "shingles"],
                )

    return sets


def _sizer(width: int):
    """The sets' hashes and sizes, in place of the texts."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, kind = Powers(), space_words()
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                found = shingle_sets(scan(texts, kind, powers), width)
                a, b = zip(*map(_set_hashes, found), strict=True)
                yield pa.RecordBatch.from_arrays([*(_column(part, c) for c in ("doc_id", "text_a", "text_b")), *(pa.array(list(x), pa.int64()) for x in (a, b, map(len, found)))], names=["doc_id", "text_a", "text_b", "set_a", "set_b", "n"])

    return sized


def _estimate(threshold: float, n: int):
    """Keeps pairs whose signatures agree often enough for ``threshold`` less the slack."""
    share = threshold + (1 - threshold) / 256
    least = n * share - SLACK * (n * share * (1 - share)) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(_column(batch, "sig_u").to_pylist()), np.uint8).reshape(-1, n)
            y = np.frombuffer(b"".join(_column(batch, "sig_v").to_pylist()), np.uint8).reshape(-1, n)
            good = (x == y).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([_column(batch, "u"), _column(batch, "v")], names=["u", "v"]).filter(pa.array(good))

    return keep


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = _column(batch, "set_u"), _column(batch, "set_v")
            good = []
            for x, y in zip(xs, ys, strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([_column(batch, "u"), _column(batch, "v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return confirm


class _Linker:
    """Verifies candidate pairs of class representatives.

    A bucket's pairs all have its least member on one side, so the rows of such a member are
    dealt over salts, and its one signature or set is repeated.
    """

    def __init__(self, reps: DataFrame, sets: DataFrame, percent: int) -> None:
        self.reps, self.sets, self.percent = reps, sets, percent

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs that pass the length filter and the signature test."""
        side = self.reps.select("doc_id", "n_shingles", "signature")
        u = side.toDF("u", "n_u", "sig_u")
        v = side.toDF("v", "n_v", "sig_v")
        close = (100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v"))
        return self._beside(pairs, u).join(v, "v").where(close).select("u", "v", "sig_u", "sig_v").mapInArrow(_estimate(self.percent / 100, BANDS * ROWS), "u long, v long")

    @staticmethod
    def _beside(pairs: DataFrame, u: DataFrame) -> DataFrame:
        hot = hot_keys(pairs.groupBy("u").agg(F.count("*").alias("n")), "u", "n")
        return join_split(pairs, u, ["u"], "u", hot, "v")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets meet the threshold."""
        u, v = self.sets.toDF("u", "set_u"), self.sets.toDF("v", "set_v")
        return self._beside(pairs, u).join(v, "v").select("u", "v", "set_u", "set_v").mapInArrow(_confirm(self.percent), "u long, v long")


def _labelled(table: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """``table`` with the component of ``key``; a node without a link is its own."""
    named = labels.select(F.col("node").alias(key), F.col("component").alias("_c"))
    return table.join(named, key, "left").withColumn(name, F.coalesce("_c", key)).drop("_c")


#: Counters of the table of token frequencies; tokens share them when there are more.
COUNTERS = 1 << 20


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tokens = np.frombuffer(b"".join(batch.column(0).to_pylist()), U64)
            counter, n = np.unique(tokens % U64(COUNTERS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(counter.astype(np.int64)), pa.array(n.astype(np.int64))], names=["counter", "n"])


def _prefixes(shared, percent: int):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        up = lambda numerator, divisor: -(-numerator // divisor)
        for batch in batches:
            for doc, blob in zip(_column(batch, "doc_id").to_pylist(), _column(batch, "shingles"), strict=True):
                s = np.frombuffer(blob.as_buffer(), U64)
                n, df = len(s), held[(s % U64(COUNTERS)).astype(np.int64)]
                first = np.lexsort((s, df))[: n - up(n * percent, 100) + 1]
                place = np.arange(len(first))
                shared_by = df[first] > 1  # a token that no other set holds takes its place, but starts no pair
                # of a pair the smaller set shares one of fewer tokens
                brief = place < n - up(2 * percent * n, 100 + percent) + 1
                columns = s[first].view(np.int64), df[first].astype(np.int64), np.full(len(first), doc, np.int64), np.full(len(first), n, np.int64), place, brief.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c[shared_by]) for c in columns], names=["token", "df", "doc_id", "n", "place", "brief"])

    return prefixes


def _rare_prefix(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """``token, df, doc_id, n, place, brief`` of the first tokens of each set: as many as a
    pair over the threshold must share one of.

    The order is by frequency over the given ids, then by hash. Frequencies are counted by
    ``COUNTERS`` counters, a table of fixed size that is broadcast: ``df`` is the sum over the tokens of
    a counter, so at least a token's own, and any order that all sets share loses no pair.
    """
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = sets.join(ids, "doc_id").repartition(tasks)  # crowded documents may lie in few files
    counted = chosen.select("shingles").mapInArrow(_counters, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()  # at most a row per counter
    held = np.zeros(COUNTERS, np.int32)
    held[counted["counter"].to_numpy(np.int64)] = np.minimum(counted["n"].to_numpy(np.int64), 1 << 30)
    shared = sets.sparkSession.sparkContext.broadcast(held)
    return chosen.select("doc_id", "shingles").mapInArrow(_prefixes(shared, percent), "token long, df long, doc_id long, n long, place long, brief long")


def _could_link(percent: int):
    """Length filter, and positional filter for the first token that two sets share:
    what follows it on either side must suffice for the overlap that is needed."""
    length = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    reach = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv"))
    return length & ((100 + percent) * reach >= percent * (F.col("nu") + F.col("nv")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def _node() -> Column:
    """Stands for one of several texts that share a doc_id: a negative number from the id and the set."""
    return -(F.xxhash64("doc_id", "set_a", "set_b").bitwiseAND((1 << 62) - 1)) - 1


def _with_nodes(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``rows`` (``doc_id, set_a, set_b``) with ``node``: the doc_id, but where it has several sets."""
    if repeated is None:
        return rows.withColumn("node", F.col("doc_id"))
    flagged = rows.join(repeated.withColumn("_several", F.lit(True)), "doc_id", "left")
    return flagged.withColumn("node", F.when(F.col("_several"), _node()).otherwise(F.col("doc_id"))).drop("_several")


def _linked(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame, bool, Scratch]:
    """Rows (``doc_id, n_shingles, node``) of ``docs`` (``doc_id, text``), the edges between
    nodes with near or equal sets, whether ids have several sets, and the tables to clear after.

    A node is a doc_id; where several sets share one, each of them is a node of its own.
    """
    signed = materialise(docs.mapInArrow(_signer(BANDS, ROWS, width), SIGNED), "signed")
    scratch = Scratch()
    keep = scratch.keep
    some = signed.where("n_shingles > 0 and doc_id is not null")
    repeated = some.groupBy("doc_id").agg(F.min("set_a").alias("a"), F.max("set_a").alias("z"), F.min("set_b").alias("b"), F.max("set_b").alias("y")).where("a <> z or b <> y").select("doc_id")
    repeated = keep(repeated, "repeated") if repeated.count() else None
    usable = _with_nodes(some, repeated).withColumnRenamed("doc_id", "id").withColumnRenamed("node", "doc_id")
    same = ["set_a", "set_b", "n_shingles"]
    # only classes of several rows are joined, from a table of their own
    shared = keep(usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "classes")
    hot = hot_keys(shared, "set_a", "rows")
    members = keep(join_split(usable.select("doc_id", *same), shared.drop("rows"), same, "set_a", hot, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "members")
    rep_ids = members.select(F.col("rep").alias("doc_id")).distinct()
    reps = keep(usable.join(rep_ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "reps")
    inside = reps.select("doc_id", F.posexplode("bands").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("key")).distinct()
    sizes = keep(inside.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("size")).where("size > 1"), "sizes")
    hot = hot_keys(sizes, "key", "size")
    buckets = keep(join_split(inside, sizes, ["key"], "key", hot, "doc_id"), "buckets")
    candidates = buckets.select("doc_id").distinct()
    ids = candidates if repeated is None else reps.join(candidates, "doc_id", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    needed = marked(docs, "doc_id", ids, "maybe").where("maybe").select("doc_id", "text").join(ids, "doc_id", "left_semi")
    found = _with_nodes(needed.mapInArrow(_setter(width), SETS), repeated).select(F.col("node").alias("doc_id"), "shingles")
    if repeated is not None:  # rows that repeat an id have sets of several nodes
        found = found.join(candidates, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("shingles").alias("shingles"))
    sets = keep(found, "sets")
    linker = _Linker(reps, sets, percent)

    stars = _ordered(buckets.select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")))
    links = keep(linker.links(keep(linker.filtered(stars), "starpairs")), "links")
    labels = keep(connected_components(links), "labels")

    # what is left: buckets that span components
    tagged = _labelled(buckets, labels, "doc_id", "component")
    spans = tagged.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("members")).where("c1 < c2").select("key", "members")
    spans = keep(spans, "spans") if hot else spans
    open_ = keep(join_split(tagged.select("key", "doc_id", "component"), spans, ["key"], "key", hot, "doc_id"), "open")
    small = open_.where(F.col("members") <= LISTED)
    mine = small.select("key", F.col("doc_id").alias("u"), F.col("component").alias("cu"))
    other = small.select("key", F.col("doc_id").alias("v"), F.col("component").alias("cv"))
    listed = mine.join(other, "key").where("u < v and cu <> cv").select("u", "v").distinct()

    crowd = open_.where(F.col("members") > LISTED).select("doc_id", "component").distinct()
    prefix = keep(_rare_prefix(sets, crowd.select("doc_id").distinct(), percent).join(crowd, "doc_id"), "prefix")
    left = F.col("token"), F.col("doc_id").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), F.col("place").alias("pu")
    right = F.col("token"), F.col("doc_id").alias("v"), F.col("component").alias("cv"), F.col("n").alias("nv"), F.col("place").alias("pv")
    rare = prefix.where(F.col("df") <= LISTED)
    by_rare = rare.select(*left).join(rare.select(*right), "token").where(F.expr("u < v and cu <> cv") & _could_link(percent)).select("u", "v").distinct()

    # a common token's most central member has the fewest rarer tokens: most others are near it
    common = prefix.where(F.col("df") > LISTED)
    central = common.groupBy("token").agg(F.min_by("doc_id", F.struct("place", "doc_id")).alias("v"))
    second = _ordered(common.select("token", F.col("doc_id").alias("u")).join(central, "token").select("u", "v"))
    near_centre = keep(linker.links(keep(linker.filtered(second), "starpairs")), "links")
    labels = keep(connected_components(links.unionAll(near_centre)), "labels")
    common = keep(_labelled(common.drop("component"), labels, "doc_id", "component"), "common")
    main = common.groupBy("token", "component").agg(F.count("*").alias("held")).groupBy("token").agg(F.max_by("component", F.struct("held", "component")).alias("main"))
    outside = common.join(main, "token").where("component <> main").drop("main")
    apart = F.expr("u <> v and cu <> cv") & _could_link(percent)
    brief = F.col("brief") == 1
    larger = outside.select(*left).join(common.where(brief).select(*right), "token").where(apart & F.expr("nu >= nv"))
    smaller = outside.where(brief).select(*left).join(common.select(*right), "token").where(apart & F.expr("nu <= nv"))
    by_common = larger.unionAll(smaller).select("u", "v").distinct()

    rest = _ordered(listed.unionAll(by_rare).unionAll(by_common))
    more = keep(linker.links(keep(linker.filtered(rest), "restpairs")), "links")
    equal = members.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    edges = links.unionAll(near_centre).unionAll(more).unionAll(equal)
    rows = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    if repeated is not None:
        rows = materialise(_with_nodes(rows, repeated), "nodes")
        discard(signed)
    else:
        rows = rows.withColumn("node", F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", "node"), edges, repeated is not None, scratch


def _shaped(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = WIDTH) -> DataFrame:
    """Component of every document under set similarity of word shingles.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. Two
    documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets
    of distinct ``width``-word shingles. Returns one row per input row: ``doc_id,
    n_shingles, component_id, kept``. Null or empty texts, and texts without words,
    have the empty set and are linked with nothing. Rows that repeat a doc_id are
    one node for its component, whatever their texts; each row keeps its own set size.
    A row whose doc_id is null gets a null component and is kept. A very long text is
    signed in blocks of shingles. An empty table gives no rows.
    """
    with unbroadcast(docs.sparkSession):
        return _components(docs, percent, width)


def _components(docs: DataFrame, percent: int, width: int) -> DataFrame:
    rows, edges, repeats, scratch = _linked(_shaped(docs), percent, width)
    if repeats:  # the texts of a repeated id are one node here
        several = rows.where("node <> doc_id and n_shingles > 0").select("node", "doc_id").distinct()
        edges = edges.join(several.toDF("u", "a"), "u", "left").join(several.toDF("v", "b"), "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    final = connected_components(edges)
    scratch.clear()
    named = rows.select("doc_id", "n_shingles").join(final.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, whole, with one document of each component of near-duplicates.

    The least doc_id stays; where it has several texts in the component, one of them.
    Texts that share a doc_id, but are not near each other, are documents of their own.
    Of rows with the same id and set of shingles one stays (the least by a hash of all
    columns). Rows without an id or without words stay, all of them, and so does an
    empty table. A very long text is signed in blocks of shingles. Other columns are kept,
    whatever their names.
    """
    with unbroadcast(docs.sparkSession):
        return _kept(docs, percent, width)


def _kept(docs: DataFrame, percent: int, width: int) -> DataFrame:
    rows, edges, repeats, scratch = _linked(_shaped(docs), percent, width)
    final = connected_components(edges)
    named = rows.where("doc_id is not null and n_shingles > 0").groupBy("node", "doc_id").agg(F.count("*").alias("times"))
    named = named.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = _fates(named) if repeats else materialise(named.withColumn("goes", F.col("node") != F.col("component")).where("goes or times > 1").select("doc_id", "node", "goes"), "gone")
    discard(final)
    scratch.clear()
    names = docs.columns
    maybe, key = free_name(names, "_maybe"), free_name(names, "_key")
    ids = told.select(F.col("doc_id").alias(key)).distinct()
    split = marked(docs, "doc_id", ids, maybe)
    clear, unsure = split.where(~F.col(maybe)).drop(maybe), split.where(F.col(maybe)).drop(maybe)
    if told.where("node <> doc_id or not goes").isEmpty():  # every id is of one row
        return clear.unionAll(unsure.join(ids, unsure["doc_id"].cast("long") == ids[key], "left_anti"))
    return clear.unionAll(_sorted_out(unsure, told, width))


def _fates(named: DataFrame) -> DataFrame:
    """Nodes that go, and nodes of several rows, where ids may have several nodes."""
    named = materialise(named, "named")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("held")).where("held > 1").select("component", "first.node")
    gone = named.join(first.withColumnRenamed("node", "stays"), "component").where("node <> stays")
    told = gone.select("doc_id", "node", F.lit(True).alias("goes")).unionAll(named.where("times > 1").join(gone.select("node"), "node", "left_anti").select("doc_id", "node", F.lit(False).alias("goes")))
    found = materialise(told, "gone")  # only rows of these ids are shuffled
    discard(named)
    return found


def _sorted_out(rows: DataFrame, told: DataFrame, width: int) -> DataFrame:
    """Rows of repeated ids: without those whose node goes, and one of each node that stays."""
    names = rows.columns
    whole = F.struct(*[F.col(f"`{n}`") for n in names]).alias("whole")
    hashed = F.xxhash64(*[F.col(f"`{n}`") for n, t in rows.dtypes if not t.startswith("map")]).alias("hash")
    text = F.col("text").cast("string")
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(7), text).alias("text_b"), text.alias("text"), whole, hashed)
    sets = own.select("doc_id", "text_a", "text_b", "text").mapInArrow(_sizer(width), SIZED).distinct().withColumn("several", _node())
    seen = told.select(F.col("doc_id").alias("id"), "node", "goes")
    fate = sets.join(seen, (F.col("doc_id") == F.col("id")) & F.col("node").isin(F.col("several"), F.col("doc_id")), "left")
    fate = fate.select("doc_id", "text_a", "text_b", "n", F.coalesce("node", "several").alias("node"), F.coalesce("goes", F.lit(False)).alias("goes"))
    placed = own.drop("text").join(fate, ["doc_id", "text_a", "text_b"]).where("not goes")
    wordless = placed.where("n = 0").select("whole.*")
    rest = placed.where("n > 0").groupBy("doc_id", "node").agg(F.min_by("whole", "hash").alias("whole")).select("whole.*")
    return wordless.unionAll(rest)
