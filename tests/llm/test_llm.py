import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from barloom.llm import compaction, components, decontaminate, imatch, licenses, minhash, packing, quality, textscan, tokencount, toxicity, warc  # noqa: E402
from barloom.llm import queries as Q  # noqa: E402
from barloom.llm.storage import scratch_path, shared_root  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, and clashing extra columns."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (2, "THE quick brown\tfox jumps over the lazy dog", None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "a", 3),
        (None, "no id here but some words in it", "en", None, 5),
        (6, LONG, "en", "a", len(LONG)),
        (7, "idiot", "en", "a", 5),
        (8, "Released under the MIT License.\nçé MIT license ñ", "fr", "b", 40),
        (9, "x" * 5000, "en", "b", 5000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_text", "label", "score", "key", "component_id", "kept", "_gone", "word", "term", "group", "window"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in documents(spark, sf_dir).select("doc_id", "text").collect()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# scanning


def test_scan_matches_regular_expressions():
    rng = random.Random(1)
    kinds = [(textscan.space_words(), r"[^\x20\x09-\x0D]+"), (textscan.letter_words(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]
    sample = ["", "a", " a b ", "É Ça1 x", *("".join(rng.choice("aB1 .\n\té\x1c") for _ in range(rng.randrange(40))) for _ in range(300))]
    for kind, pattern in kinds:
        words = textscan.scan(pa.array(sample, pa.large_string()), kind, textscan.Powers())
        seen = defaultdict(set)
        for i, t in enumerate(sample):
            found = re.findall(pattern, t.translate(LOWER))
            a, b = words.bounds[i], words.bounds[i + 1]
            assert b - a == len(found)
            for w, h in zip(found, words.hash[a:b].tolist(), strict=True):
                seen[w].add(h)
        assert all(len(h) == 1 for h in seen.values())
        assert len({h for s in seen.values() for h in s}) == len(seen)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5), (7, None)] + [(i, i + 1) for i in range(300, 340)]
    u = Union({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if b is not None:
            u.join(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(u.find(n) == c for n, c in got.items())
    assert {x for a, b in edges if b is not None and a != b for x in (a, b)} == set(got)


def test_id_filter_keeps_every_id(spark):
    from barloom.llm.idfilter import marked

    ids = spark.range(0, 3000, 3).toDF("x")
    got = marked(spark.range(6000).toDF("doc_id"), "doc_id", ids, "maybe").collect()
    assert all(r.maybe for r in got if r.doc_id < 3000 and r.doc_id % 3 == 0)
    assert sum(r.maybe for r in got) < 1000 + 600
    assert not any(r.maybe for r in marked(spark.range(9).toDF("doc_id"), "doc_id", ids.where("false"), "maybe").collect())


# near-duplicates


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, sf_dir, percent):
    own = {i: shingles(t) for i, t in texts(spark, sf_dir).items()}
    u = Union(own)
    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(own[a] & own[b])
            if both and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                u.join(a, b)
    got = minhash.near_duplicates(documents(spark, sf_dir), percent).collect()
    assert len(got) == len(own)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(own[r.doc_id]), u.find(r.doc_id), u.find(r.doc_id) == r.doc_id)


@pytest.mark.parametrize("percent", [80, 85])
def test_crowded_near_copies(spark, monkeypatch, percent):
    """A large group of near copies goes through the exact finish of crowded buckets."""
    monkeypatch.setattr(minhash, "LISTED", 8)
    monkeypatch.setattr(minhash.skew, "LEAST_HOT", 20)
    monkeypatch.setattr(minhash.skew, "SHARE", 50)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    own = {i: shingles(t) for i, t in rows}
    u = Union(own)
    for a in own:
        for b in own:
            both = len(own[a] & own[b])
            if a < b and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                u.join(a, b)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == {i: u.find(i) for i in own}


def test_near_duplicates_of_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1 and not by[2].kept
    assert all(by[i].kept and by[i].n_shingles == 0 for i in (3, 4, 5))
    assert [r.kept for r in got if r.doc_id is None] == [True]
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.near_duplicates(odd.where("false")).count() == 0


def test_ids_with_several_texts(spark):
    """Texts that share an id, but are not near each other, are documents of their own for the filter."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    far = " ".join(f"v{i}" for i in range(60))
    alone = " ".join(f"u{i}" for i in range(60))
    rows = [(1, " ".join(base), "a"), (1, far, "b"), (1, near, "c"), (1, far, "b"), (2, near, "d"), (2, alone, "e"), (3, far + " more", "f"), (4, "", "g"), (4, None, "h"), (5, alone, "i"), (5, alone, "j"), (6, "single words", "k"), (6, "single words", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _maybe string")
    own = [(i, shingles(t)) for i, t, _ in rows]
    for parts in (1, 7):
        kept = [tuple(r) for r in minhash.keep_one(docs.repartition(parts)).collect()]
        assert len(kept) == len([r for r in kept if r[1]]) + 2
        assert Counter(kept) - Counter(rows) == Counter()
        left = [(i, shingles(t)) for i, t, _ in kept if t]
        assert sorted(i for i, _ in left) == [1, 1, 2, 6]
        for k, (_, a) in enumerate(left):  # no two near each other, and each row that went is near one that stays
            assert all(10 * len(a & b) < 8 * len(a | b) for _, b in left[k + 1 :])
        assert all(any(10 * len(a & b) >= 8 * len(a | b) for _, b in left) for _, a in own if a)
        assert {r[2] for r in kept if r[0] == 2} == {"e"}
    got = minhash.near_duplicates(docs, 80).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 6)}


def test_mixed_template_pages(spark, monkeypatch):
    """Pages mixed from common lines, most alike in part: exact, with salted keys."""
    monkeypatch.setattr(minhash, "LISTED", 6)
    monkeypatch.setattr(minhash.skew, "LEAST_HOT", 10)
    monkeypatch.setattr(minhash.skew, "SHARE", 100)
    rng = random.Random(9)
    lines = [" ".join(f"l{i}x{j}" for j in range(14)) for i in range(14)]
    rows = []
    for i in range(160):
        own = sorted(rng.sample(range(14), rng.choice([7, 8, 9])))
        rows.append((i, " ".join([*(lines[k] for k in own), *(f"own{i}y{j}" for j in range(rng.choice([0, 4, 12])))])))
    own = {i: shingles(t) for i, t in rows}
    u = Union(own)
    for a in own:
        for b in own:
            both = len(own[a] & own[b])
            if a < b and 100 * both >= 80 * (len(own[a]) + len(own[b]) - both):
                u.join(a, b)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == {i: u.find(i) for i in own}


# classifiers


def test_is_held_out(spark):
    got = spark.range(300).select(F.col("id").alias("doc_id"), toxicity.is_held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


@pytest.mark.parametrize(("module", "label", "threshold"), [(toxicity, "toxic", 0.3), (quality, "quality", 0.7)])
def test_classifiers_on_held_out_rows(spark, module, label, threshold):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = module.classify(documents(spark, sf), labels).join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    assert np.mean([r.predicted == r[label] for r in got]) > 0.97
    positive = [r.predicted for r in got if r[label] == 1]
    negative = [r.predicted for r in got if r[label] == 0]
    assert np.mean(positive) > 0.85 and np.mean(negative) < 0.06


@pytest.mark.parametrize(("module", "keep"), [(toxicity, "drop_toxic"), (quality, "keep_good")])
def test_classifiers_on_odd_rows(spark, odd, module, keep):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (9, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.classify(odd, labels).count() == odd.count()
    kept = getattr(module, keep)(odd, labels)
    assert kept.columns == odd.columns and kept.where("label <> 'clash' or _text <> 'clash'").count() == 0
    for none in (labels.where("false"), labels):
        assert module.classify(odd.where("false"), none).count() == 0
    assert module.classify(odd, labels.where("false")).where("score between 0 and 1").count() == odd.count()


def test_ftrl_matches_plain_python():
    """The same passes over dictionaries, one coordinate at a time."""
    rng = np.random.default_rng(0)
    data = [(float(y), np.array(sorted({int(y) + 10, *rng.integers(20, 200, 5).tolist()}))) for y in rng.integers(0, 2, 400)]
    s = toxicity.Settings(l1=1.0)
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= s.l1 else -(z[i] - (s.l1 if z[i] > 0 else -s.l1)) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)
    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(data)).tolist():
            y, x = data[k]
            w, bias = {i: weight(i) for i in x.tolist()}, -zb / ((s.beta + nb**0.5) / s.alpha)
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            for i, wi in w.items():
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha
                z[i] += g - sigma * wi
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / s.alpha * bias
            nb += g * g
    where, weights, bias = toxicity.ftrl(data, 8, s)
    want = {i: weight(i) for i in z if weight(i)}
    assert set(where.tolist()) == set(want) and len(want) < 150 and want[11] > 0.5
    assert weights == pytest.approx([want[i] for i in where.tolist()], abs=1e-9)
    assert bias == pytest.approx(-zb / ((s.beta + nb**0.5) / s.alpha))


def test_features_match_plain_python():
    """Coordinates are equal exactly where words, pairs, skips and stems are."""
    rng = random.Random(4)
    sample = [" ".join(rng.choice(["damned", "damnable", "fox", "é", "x1"]) for _ in range(rng.randrange(7))) for _ in range(60)]
    streams = toxicity.features(textscan.scan(pa.array(sample, pa.large_string()), textscan.letter_words(), textscan.Powers()))
    got = [set() for _ in sample]
    for text, hashes in streams:
        for t, h in zip(text.tolist(), hashes.tolist(), strict=True):
            got[t].add(h)
    want = []
    for t in sample:
        w = t.split()
        stems = {("stem", x.encode()[:n], n) for x in w for n in toxicity.STEMS if len(x.encode()) > n}
        want.append({("word", x) for x in w} | set(zip(w, w[1:], strict=False)) | {(a, None, b) for a, b in zip(w, w[2:], strict=False)} | stems)
    assert [len(x) for x in got] == [len(x) for x in want]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(a & b) == len(got[i] & got[j])


def test_scores_of_the_discriminant_match_plain_formulas(spark, sf_dir):
    from barloom.llm.storage import discard

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = toxicity.labelled_sample(docs, labels, "quality", quality.FIT_ROWS)
    rows = sample.collect()
    discard(sample)
    measured = quality.statistics(pa.array([r.text for r in rows], pa.large_string()), textscan.Powers(), textscan.space_words())
    y, k = np.array([r.label for r in rows]), len(quality.NAMES)
    logs = []
    for c in (0, 1):
        x = measured[y == c]
        cov = np.cov(x.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(k)
        apart = measured - x.mean(axis=0)
        prior = np.log((len(x) + 0.5) / (len(y) + 1))
        logs.append(prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", apart, np.linalg.inv(cov), apart))
    model = quality.fit(docs, labels)
    want = np.clip(logs[1] - logs[0], -quality.EXTREME, quality.EXTREME)
    assert model.difference(measured) == pytest.approx(want, abs=1e-6)
    # the calibration is the best logistic fit of the differences in tenths: its gradient vanishes
    x = np.round(want * 10) / 10
    off = 1 / (1 + np.exp(-(model.slope * x + model.offset))) - y
    assert abs((off * x).sum() + 1e-3 * model.slope) < 1e-3 and abs(off.sum() + 1e-3 * model.offset) < 1e-3


def test_the_sample_is_bounded(spark):
    """Rows that repeat a labelled id give one row, and texts a bounded number of bytes."""
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionAll(spark.range(100, 400).select(F.col("id"), F.repeat(F.lit("word "), 200)))
    labels = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    for most, size in ((100, 1 << 20), (10_000, 50_000), (10_000, 1 << 20)):
        rows = toxicity.labelled_sample(docs, labels, "toxic", most, size).collect()
        assert len(rows) == len({r.doc_id for r in rows}) <= most and sum(len(r.text) for r in rows) <= size
        assert not any(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
        assert sorted(map(tuple, toxicity.labelled_sample(docs.repartition(9), labels, "toxic", most, size).collect())) == sorted(map(tuple, rows))
    assert len(rows) > 200


def test_a_very_long_text_does_not_empty_the_sample(spark):
    docs = spark.range(200).select("id", F.when(F.col("id") % 7 == 0, F.repeat(F.lit("word "), 10_000)).otherwise(F.concat(F.lit("text "), "id")).alias("text")).withColumnRenamed("id", "doc_id")
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") == 191).cast("int").alias("toxic"))
    rows = toxicity.labelled_sample(docs, labels, "toxic", 10_000, 20_000).collect()
    want = [i for i in range(200) if i % 7 and zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(r.doc_id for r in rows) == want
    few = toxicity.labelled_sample(docs, labels, "toxic", 10_000, 640).collect()
    assert {r.label for r in few} == {0, 1} and sum(len(r.text) for r in few) <= 640


@pytest.mark.parametrize("keep", [quality.keep_good, toxicity.drop_toxic])
def test_filters_without_a_labelled_row_keep_all(spark, odd, keep):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert keep(odd, labels).count() == odd.count()


# archives


def test_round_trip_of_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    big = "y\r\n\r\nz" * 60_000
    extra = [(900001, "u", None), (900002, "u", "é" * 700), (900003, None, "é" * 700), (None, "u", "é" * 700), (900004, "u", "x" * 900), (900005, "u", "x" * 900), (900006, "a\r\nb", big), (900006, "a", big)]
    pages = pages.unionAll(spark.createDataFrame(extra, pages.schema))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    largest = {}
    for i, b in rows:
        if i is not None:
            largest[b] = max(largest.get(b, i), i)
    want = Counter()
    for i, b in rows:
        again = len(b) >= 1000 and largest.get(b) is not None and largest[b] != i
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", largest[b] if again else None, True, True)] += 1
    for name in ("payload", "digest", "kept_id", "refers_to", "maybe", "block", "row_key"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = warc.archive_round_trip(pages)
    assert got.where("segments > 1").count() > got.count() / 2
    assert Counter(map(tuple, got.drop("segments").collect())) == want
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_lost_and_reordered_segments(spark):
    path = scratch_path(spark, "warctest")
    page = spark.createDataFrame([(1, "u", "abc" * 5000), (2, "v", "short")], "page_id long, url string, html string")
    shaped = page.select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    warc.write_archives(warc.plan_revisits(shaped), path, segment_bytes=1000, chunk_bytes=300)
    parts = warc.read_segments(spark, path)
    whole = {r.page_id: r for r in warc.reassemble(parts.orderBy(F.rand(3))).collect()}
    assert bytes(whole[1].payload) == b"abc" * 5000 and whole[1].length_ok and whole[1].segments > 10
    assert bytes(whole[2].payload) == b"short"
    broken = {r.page_id: r for r in warc.reassemble(parts.where("segment is null or segment <> 4")).collect()}
    assert not broken[1].length_ok and not broken[1].digest_ok and broken[2].length_ok
    twice = warc.reassemble(parts.unionAll(parts.where("segment = 2"))).where("page_id = 1").first()
    assert not twice.length_ok


def test_revisits_are_compared_with_their_response(spark, monkeypatch):
    monkeypatch.setattr(warc.skew, "LEAST_HOT", 2)
    page = spark.createDataFrame([(i, "u", "abc" * 1000) for i in range(9)] + [(20, "v", "x" * 1500), (21, "v", "x" * 1500)], "page_id long, url string, html string")
    path = scratch_path(spark, "warctest")
    warc.write_archives(warc.plan_revisits(page.select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))), path)
    records = warc.reassemble(warc.read_segments(spark, path)).persist()
    good = {r.page_id: r.digest_ok for r in warc.check_revisits(records).collect()}
    assert len(good) == 11 and all(good.values())
    lost = {r.page_id: r.digest_ok for r in warc.check_revisits(records.where("page_id <> 8")).collect()}
    assert [i for i, ok in lost.items() if ok] and not any(lost[i] for i in range(8)) and lost[20] and lost[21]
    other = records.withColumn("payload_bytes", F.when(F.col("page_id") == 21, 7).otherwise(F.col("payload_bytes")))
    assert [r.page_id for r in warc.check_revisits(other).where("not digest_ok").collect()] == [20]


def test_archives_of_many_members():
    import gzip

    record = lambda k: b"WARC/1.1\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (k, k) + b"z" * k + b"\r\n\r\n"
    whole = [record(k) for k in (0, 5, 70_000, 3)]
    for blob in (b"".join(whole), gzip.compress(b"".join(whole)), b"".join(map(gzip.compress, whole))):
        assert [(h["warc-record-id"], len(b)) for h, b in warc._records(pa.py_buffer(blob))] == [(f"<{k}>", k) for k in (0, 5, 70_000, 3)]


# licenses


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_licenses(text, templates):
    """Every window of every template, counted word by word: labels and score."""
    w, hits = license_words(text), []
    for t, (label, must, body) in enumerate(templates):
        tokens, reach = set(license_words(body)), len(license_words(body)) * 5 // 4
        own = []
        for s in range(len(w)):
            seen, end = set(), s
            if w[s] not in tokens:
                continue
            for k in range(s, min(s + reach, len(w))):
                if w[k] in tokens and w[k] not in seen:
                    seen.add(w[k])
                    end = k + 1
            if 10 * len(seen) >= 8 * len(tokens) and set(license_words(must)) <= seen:
                own.append((-len(seen), end - s, s, end))
        taken = []
        for n, size, s, end in sorted(own):
            if all(end <= a or z <= s for _, _, _, a, z in taken):
                taken.append((-n, -n / len(tokens), label, s, end))
        hits += taken
    better = lambda y, x: (y[0], y[1]) > (x[0], x[1]) and 2 * (min(y[4], x[4]) - max(y[3], x[3])) >= x[4] - x[3]
    kept = [x for x in hits if not any(better(y, x) for y in hits)]
    return {x[2] for x in kept}, max((x[1] for x in kept), default=0.0)


def test_licenses_match_brute_force(spark, sf_dir, odd):
    clash = odd.select("doc_id", "text", F.lit("x").alias("labels"), F.lit(1).alias("n_words"))
    rng = random.Random(12)
    made = []
    for k in range(60):  # notices that overlap, are cut, shuffled or mixed with text
        parts = [license_words(rng.choice(licenses.TEMPLATES)[2]) for _ in range(rng.choice([1, 1, 2]))]
        words = [x for p in parts for x in (p if rng.random() < 0.5 else p[rng.randrange(3) : len(p) - rng.randrange(1 + len(p) // 4)])]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"other{rng.randrange(9)}"
        made.append((5000 + k, " ".join([f"start{k}", *words, "and the rest is under the license"])))
    df = documents(spark, sf_dir).select("doc_id", "text").unionAll(clash.select("doc_id", "text")).unionAll(spark.createDataFrame(made, "doc_id long, text string"))
    want = Counter()
    for r in df.collect():
        w = license_words(r.text)
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        found, best = brute_licenses(r.text, licenses.TEMPLATES)
        base = {label for _, label in at}
        want[(r.doc_id, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | found)), best)] += 1
    assert Counter(tuple(r) for r in licenses.scan_licenses(df).drop("n_blocks").collect()) == want
    assert Counter(licenses.scan_licenses(clash).collect()) == Counter(licenses.scan_licenses(odd).collect())
    assert licenses.scan_licenses(odd.where("false")).count() == 0


def test_labels_of_notices(spark):
    """Every notice wrapped and commented out, and texts that only resemble one."""
    import textwrap

    rows, want = [], {}
    for label, _, body in licenses.TEMPLATES:
        for width, mark in ((72, "# "), (80, " * "), (9999, "")):
            want[len(rows)] = {label}
            rows.append(f"int x = 1;\n{textwrap.indent(textwrap.fill(' '.join(body.split()), width), mark)}\n\nint main() {{ return x; }}")
    for text, labels in (
        ("Released under the Apache License.", {"apache"}),
        ("The film was released under the license of the studio and later sold", set()),
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", {"mit", "apache", "apache-2.0"}),
        ("the mit of software is a permission granted by any person to a copy of the person", set()),
    ):
        want[len(rows)] = labels
        rows.append(text)
    got = {r.doc_id: set(r.labels.split(",")) - {""} - ({"mit", "apache", "gpl"} - want[r.doc_id] if want[r.doc_id] else set()) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == want


# fingerprints


def test_fingerprints(spark, sf_dir):
    own = texts(spark, sf_dir)
    ids = sorted(own, reverse=True)
    got = {r.doc_id: r for r in imatch.fingerprints(documents(spark, sf_dir)).collect()}
    assert len(got) == len(own)
    same = defaultdict(set)
    for k, i in enumerate(ids):
        t, after = own[i], own[ids[(k + 1) % len(ids)]]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same[t].add(r.fingerprint)
    assert all(len(f) == 1 for f in same.values())
    assert np.mean([r.near_edited for r in got.values()]) > 10 * np.mean([r.near_next for r in got.values()])


def test_fingerprints_match_brute_force(spark, sf_dir):
    """Lexicon, subsets and hashes by plain Python."""
    import regex
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of_text = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))
    chain = lambda h, blob: xxhash.xxh64_intdigest(blob, seed=h)
    of_long = lambda x, h=42: chain(h, x.to_bytes(8, "little", signed=True))
    docs = documents(spark, sf_dir)
    own = texts(spark, sf_dir)
    words = {i: {of_text(w) for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w} for i, t in own.items()}
    df, n = Counter(x for w in words.values() for x in w), len(own)
    held = {x for x, c in df.items() if max(2, imatch.LEAST_SHARE * n) <= c <= max(2, imatch.MOST_SHARE * n)}
    for r in imatch.fingerprints(docs).collect():
        terms, out = words[r.doc_id] & held, []
        for level, m in enumerate(imatch.LEVELS):
            place = lambda x: signed(chain(of_long(x), level.to_bytes(4, "little"))) % m  # noqa: B023, E731
            for s in range(imatch.SUBSETS):
                chosen, h = sorted(x for x in terms if place(x) == s), 42
                for x in chosen:
                    h = of_long(x, h)
                out.append(f"{h:x}" if chosen else "-")
        if set(out) == {"-"}:
            assert r.fingerprint == "text-" + hashlib.md5((own[r.doc_id] or "").encode()).hexdigest()
        else:
            assert r.fingerprint == ".".join(out)


def test_fingerprints_of_odd_rows(spark, odd):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[3].fingerprint == by[4].fingerprint and by[3].near_next == 0 or by[3].near_next == 1
    assert imatch.fingerprints(odd.where("false")).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_unlike_short_texts_have_unlike_fingerprints(spark):
    """Texts of two lexicon terms each, no two with the same terms."""
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    rows = [(i, f"term{a} term{b}") for i, (a, b) in enumerate(pairs)]
    got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in got}) == len(rows)


# packing and counting


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    fast, rng = packing.WordTokens(WORDS), random.Random(2)
    wide = [chr(c) for c in range(256)] + list("''''sstrelvemd  \n\t") + ["œ", "Σ", "İ", "é", "日", "🙂", "ﬁ"]
    sample = ["", "it's WE'LL don't", "<|endoftext|>", "\x01 a", *("".join(rng.choice(wide[: 274 if k % 3 else None]) for _ in range(rng.randrange(50))) for k in range(2000))]
    for t, got in zip(sample, fast.encode(sample), strict=True):
        assert got == np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def check_pieces(rows, docs, size):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    ids = [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")) for i, t in docs]
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in ids)
    for i, x in ids:
        if [j for j, _ in ids].count(i) > 1:
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(x))
            assert r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
            at += r.length
        assert at == len(x)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append(r)
    for parts in held.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    return len(held)


def test_packing(spark, sf_dir):
    own = texts(spark, sf_dir)
    docs = documents(spark, sf_dir).coalesce(1)
    rows = packing.pack_documents(docs, WORDS).collect()
    n = check_pieces(rows, list(own.items()), 2048)
    assert sum(r.length for r in rows) / (n * 2048) > 0.93


def test_leftovers_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    rows = [(i, "word " * (1 + i % 50)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = packing.pack_documents(docs, WORDS, size=64, most=4, least_cut=8).collect()
    n = check_pieces(got, rows, 64)
    assert sum(r.length for r in got) / (n * 64) > 0.9


def test_packing_of_odd_rows(spark, odd):
    got = packing.pack_documents(odd, WORDS).collect()
    check_pieces(got, [(r.doc_id, r.text) for r in odd.collect()], 2048)
    assert {r.length for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert packing.pack_documents(odd.where("false"), WORDS).count() == 0


def test_length_histogram(spark, sf_dir, odd):
    import base64

    import tiktoken

    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    df = documents(spark, sf_dir).select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    n = np.array([len(encode(r.text or "")) for r in df.collect()])
    got = tokencount.length_histogram(df, BYTES, public_tokenizers.PATTERN)
    rows = got.collect()
    assert {r.n_tokens for r in rows} == set(n.tolist())
    for r in rows:
        x = r.n_tokens
        assert (r.n_docs, r.tokens, r.docs_at_least, r.tokens_at_least) == ((n == x).sum(), n[n == x].sum(), (n >= x).sum(), n[n >= x].sum())
        assert (r.docs_total, r.tokens_total, r.truncated_total) == (len(n), n.sum(), np.minimum(n, x).sum())
        assert r.quantile == pytest.approx((n <= x).mean())
    for r in tokencount.at_limits(got, [0, 100, 10**9]).collect():
        assert (r.docs_over, r.tokens_kept, r.tokens_cut) == ((n > r.context).sum(), np.minimum(n, r.context).sum(), np.maximum(n - r.context, 0).sum())
    assert tokencount.length_histogram(odd.where("false"), BYTES, public_tokenizers.PATTERN).count() == 0


def test_many_notices_in_one_text(spark):
    """Time grows in proportion to a text's notices."""
    import time

    notice = "Some words before it.\n# Released under the MIT License.\nLicensed under CC BY-SA 4.0.\nThis work is licensed under the GNU General Public License, version 3.\n"
    index = licenses._Index(licenses.TEMPLATES, np.ones(len(licenses._vocabulary(licenses.TEMPLATES)), np.int64), licenses.THRESHOLD)
    took = {}
    for n in (1000, 8000):
        words = textscan.scan(pa.array([notice * n], pa.large_string()), textscan.letter_words(), textscan.Powers())
        slots = licenses._slots(index.vocabulary, words.hash)
        places = np.flatnonzero(slots >= 0)
        start = time.perf_counter()
        hits = index.hits(places, slots[places], len(words.hash))
        took[n] = time.perf_counter() - start
        assert {index.templates[h.template].label for h in hits} == {"mit", "cc-by-sa-4.0", "gpl-3.0"} and len(hits) >= 3 * n
    assert took[8000] < 24 * took[1000]


def test_round_trip_leaves_no_archives(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "page " * 400 + str(i % 3)) for i in range(12)], "page_id long, url string, html string")
    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    assert warc.archive_round_trip(pages).where("record_type = 'revisit' and digest_ok").count() == 9
    assert [d.split("-")[1] for d in set(os.listdir(root)) - before] == ["records"]


@pytest.mark.parametrize("space", [" ", "\n", " \n\t", "\xa0", "\u2003"])
def test_long_white_space(spark, monkeypatch, space):
    """Runs over which the pattern recurses; shorter ones give the ids of the whole text."""
    import base64

    import tiktoken

    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = [a + space * n + b for n in (1, 2, 5, 4095, 4096, 5000, 99_000) for a in ("", "x", "x.") for b in ("", "y", "7", "!", "'s")]
    for limit in (2, 4096):
        monkeypatch.setattr(tokencount, "_LONG", re.compile(tokencount._LONG.pattern.replace("4096", str(limit))))
        for t in texts:
            whole = tiktoken.Encoding("run", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            assert [i for p, apart in tokencount.parts_of(t) for i in (whole(p) if apart else encode(p))] == encode(t)
    monkeypatch.undo()
    long = [("x" + space * (n // len(space)) + "y",) for n in (1_000_000, 5_000_000)] + [("a b",)]
    lengths = [r.n_tokens for r in tokencount.encoded_lengths(spark.createDataFrame(long, "text string"), BYTES, public_tokenizers.PATTERN).collect()]
    assert len(lengths) == 3 and min(lengths[:2]) > 1000


# decontamination


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return min(row)


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(1, 30)))
        b = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(0, 60)))
        assert decontaminate.edit_distance_within(a, b)[0] == brute_distance(a, b)


def flat(text):
    """The normalised bytes of one text."""
    data, begins, ends, _ = decontaminate.normalise(pa.array([text], pa.large_string()))
    return data[begins[0] : ends[0]].tobytes().strip()


def edited_at(rng, text, rate):
    out = list(text)
    for p in rng.sample(range(len(out)), int(rate * len(out))):
        other = rng.choice("abcdefghijklmnopqrstuvwxyz")
        out[p] = rng.choice(["", out[p] + other, other])
    return "".join(out)


def test_normalise_handles_scripts_and_punctuation():
    assert flat("Ça  va\u2014BIEN\u00a0\u00abÉTÉ\u00bb 12!") == "ça va bien été 12".encode()
    data, _, _, starts = decontaminate.normalise(pa.array(["一二\u3002三 ab", "", "x"], pa.large_string()))
    assert [data[s : s + 3].tobytes().decode() for s in starts[:3]] == list("一二三")
    assert len(starts) == 5
    for text in ("一二 ab cd", "ab é日本 x"):
        data, begins, _, starts = decontaminate.normalise(pa.array([text], pa.large_string()))
        assert decontaminate._starts_of(flat(text)).tolist() == (starts - begins[0]).tolist()


def test_leaks_match_brute_force(spark, sf_dir):
    """Every document against every item by full edit distance, with items split over neighbouring rows, mid-word and at a space."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    items += [(900, "tiny"), (901, "one two"), (902, "is"), (903, items[0][1]), (904, "日本語の試験問題です")]
    rng = random.Random(6)
    filler = lambda n: " ".join(f"filler{rng.randrange(999)}" for _ in range(n))
    rows = []
    for _, text in items[:12]:
        space, middle = text.index(" ", len(text) // 2), len(text) // 2 + (text[len(text) // 2] == " ")
        for cut in (space, space + 1, middle):
            rows += [f"{filler(5)} {text[:cut]}", f"{text[cut:]} {filler(5)}"]
        rows += [f"{filler(9)}\n{text.upper()}! {filler(9)}", f"{filler(9)} {edited_at(rng, text, 0.1)} {filler(9)}", text]
    rows += ["tiny", "a TINY bit", "tinyer", "one\ttwo", "one, two!", "one  twofold", "", "これは日本語の試験問題です。", "日本語の試験"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in enumerate(rows):
        body = flat(t)
        for item, text in items:
            pattern = flat(text)
            if len(pattern) < decontaminate.LEAST_EDITED:
                if re.search(rb"(^| )" + pattern + rb"( |$)", body):
                    want[i, item] = 0
            else:
                least = decontaminate.edit_distance_within(pattern, body)[0]
                if least <= int(0.2 * len(pattern)):
                    want[i, item] = least
    assert len(want) > 50
    for parts in (1, 50):
        dealt = docs.repartition(parts)
        assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(dealt, bench).collect()} == want
        clean = {r.doc_id for r in decontaminate.drop_leaks(dealt, bench).collect()}
        assert clean == set(range(len(rows))) - {i for i, _ in want}


def test_passes_and_odd_items(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(1, "quick brown fox jumps"), (2, "no id here but some"), (3, None), (None, "words in it all"), (4, "zzz"), (5, "MIT   license n"), (6, "Idiot"), (7, " ;; "), (1, "quick brown fox jumps")], "item_id long, text string")
    whole = Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, bench).collect())
    assert {(1, 1), (2, 1), (None, 2), (7, 6), (8, 5)} == set(whole)
    monkeypatch.setattr(decontaminate, "MOST_KEYS", 50)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, bench).collect()) == whole
    kept = decontaminate.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 9}
    monkeypatch.undo()
    assert decontaminate.find_leaks(odd, bench.where("false")).count() == 0
    assert decontaminate.find_leaks(odd.where("false"), bench).count() == 0
    assert decontaminate.drop_leaks(odd, bench.where("false")).count() == odd.count()
    clash = odd.withColumn("text_a", F.lit(1)).withColumn("row", F.lit(2)).withColumn("slice", F.lit("x"))
    assert decontaminate.drop_leaks(clash, bench).columns == clash.columns


@pytest.mark.parametrize(("rate", "least"), [(0.05, 0.99), (0.1, 0.99), (0.15, 0.97), (0.2, 0.93)])
def test_edited_items_are_found(spark, rate, least):
    """Recall of random character edits up to the share that counts as the item, of whole items and of short ones."""
    rows = pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist()[:120]
    items = {r["item_id"]: flat(r["text"]).decode() for r in rows}
    for k, text in enumerate(list(items.values())[:60]):
        words = text.split()
        items[10_000 + k] = " ".join(words[k % 3 : k % 3 + 3 + k % 5])
    items = {i: t for i, t in items.items() if len(t.encode()) >= decontaminate.LEAST_EDITED}
    rng, docs, planted = random.Random(8), [], []
    for item, text in items.items():
        for _ in range(2):
            around = " ".join(f"filler{rng.randrange(999)}" for _ in range(20))
            doc = f"{around} {edited_at(rng, text, rate)} {around}"
            if decontaminate.edit_distance_within(text.encode(), flat(doc))[0] <= int(0.2 * len(text.encode())):
                planted.append((len(docs), item))
                docs.append(doc)
    found = decontaminate.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(planted) > 150 and np.mean([p in found for p in planted]) >= least


# sharding


def test_compaction_keeps_every_row(spark, odd):
    back = compaction.compacted(odd, scratch_path(spark, "shards"), arrivals=6, fanout=2)
    key = lambda df: Counter(map(str, df.select(*sorted(odd.columns)).collect()))
    assert key(back) == key(odd)
    assert compaction.compacted(odd.where("false"), scratch_path(spark, "shards")).count() == 0


def test_tiers_versions_and_conflicts(spark):
    store = compaction.ShardStore(spark, scratch_path(spark, "shards"), fanout=3, smallest=1)
    schema = spark.range(1).schema
    for i in range(7):
        store.append(spark.range(i * 10, i * 10 + 10))
    before = store.manifest()
    assert before.version == 7 and len(before.shards) == 7
    after = store.compact(schema, keep_versions=2)
    assert len(after.shards) < 7 and max(s.tier for s in after.shards) > max(s.tier for s in before.shards)
    assert sorted(r.id for r in store.read(schema).collect()) == list(range(70))
    assert store.versions() == [after.version - 1, after.version]
    assert sorted(r.id for r in store.read(schema, after.version - 1).collect()) == list(range(70))
    with pytest.raises(compaction.ConcurrentCommit):
        store.commit(compaction.Manifest(after.version - 1, ()), ())
    assert store.manifest() == after


def test_two_writers(spark):
    """Commits that interleave are both kept; a merge whose runs are gone is dropped."""
    root = scratch_path(spark, "shards")
    a, b = (compaction.ShardStore(spark, root, fanout=3, smallest=1) for _ in range(2))
    schema = spark.range(1).schema
    stale = a.manifest()
    b.append(spark.range(5))
    a.manifest = lambda version=None, first=[True]: (first.pop(), stale)[1] if first else compaction.ShardStore.manifest(a, version)  # noqa: B006
    a.append(spark.range(5, 9))
    assert sorted(r.id for r in b.read(schema).collect()) == list(range(9))
    b.append(spark.range(9, 12))
    runs = a._full_tier(b.manifest())
    made = a._measured(runs[0].name)
    b.compact(schema)
    before = b.manifest()
    spark.range(1).write.parquet(a._folder("late"))
    assert a._replace(runs, compaction.Shard("late", made.bytes, 1, 1)) == before
    assert sorted(r.id for r in a.read(schema).collect()) == list(range(12))
    b._context = type("Broken", (), {"rename": lambda *_: (_ for _ in ()).throw(OSError("disk"))})()
    with pytest.raises(OSError, match="disk"):
        b.append(spark.range(1))


# the pipeline and the registered queries


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, sf_dir)
    own, kept = docs, []
    for name, stage in pipeline.STAGES:
        own = stage(spark, own, sf_dir).persist()
        kept.append((name, own))
        if name != "packing":
            assert own.columns == docs.columns
            assert own.join(docs, docs.columns, "left_anti").count() == 0
    counts = [df.count() for _, df in kept]
    assert docs.count() > counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    left = {r.doc_id: r.text for r in kept[3][1].collect()}
    check_pieces(kept[4][1].collect(), list(left.items()), 2048)
    bench = [flat(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for t in left.values():
        body = flat(t)
        assert not any(b in body for b in bench)


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(Q.oracle_sql()) <= set(Q.queries())
