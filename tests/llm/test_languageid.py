import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import languageid
from barloom.llm import queries as Q
from barloom.llm.textscan import Powers, scan

SWITCHED = {
    "en": "the of and to in that with this for are was which from they have ending sentence house water people",
    "de": "der die und das nicht ein mit auf für ist werden schule zeitung möglichkeit straße über wasser haus",
    "fr": "le les des une dans est pour que qui avec château être français maison eau gens très où déjà été",
}


def switched_docs(spark, n=240, seed=1):
    """Documents of one language, and a few that mix two or three."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SWITCHED))
        rows.append((i, " ".join(rng.choices(SWITCHED[lang].split(), k=rng.randint(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def brute_marginals(e, first, step):
    """By listing all paths."""
    n, k = e.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(first[path[0]] + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[t, s] for t, s in enumerate(path)))
        for t, s in enumerate(path):
            out[t, s] += w
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_marginals_equal_all_paths(block):
    rng = np.random.default_rng(block)
    lengths = [0, 1, 5, 7, 0, 2, 6]
    bounds, k = np.cumsum([0, *lengths]), 3
    e, first, step = rng.normal(size=(bounds[-1], k)) * 3, rng.normal(size=k), rng.normal(size=(k, k))
    got = languageid.marginals(e, bounds, first, step, block)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            assert np.allclose(got[a:b], brute_marginals(e[a:b], first, step))


def test_long_chains_do_not_vanish():
    n = 50_000
    e = np.zeros((n, 2))
    e[: n // 2, 0], e[n // 2 :, 1] = 900.0, 900.0
    p = languageid.marginals(e, np.array([0, n]), np.zeros(2), np.array([[5.0, -5.0], [-5.0, 5.0]]))
    assert p[: n // 2, 0].min() > 0.99 and p[n // 2 :, 1].min() > 0.99


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(3)
    s, n, k = 4, 5, 3
    e, first, step, y = rng.normal(size=(s, n, k)), rng.normal(size=k), rng.normal(size=(k, k)), rng.integers(0, k, (s, n))

    def likelihood(e, first, step):
        total = 0.0
        for i in range(s):
            score = lambda path, i=i: first[path[0]] + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[i, t, q] for t, q in enumerate(path))
            total += score(y[i].tolist()) - np.log(sum(np.exp(score(p)) for p in itertools.product(range(k), repeat=n)))
        return total

    d_e, d_first, d_step = languageid._expected(e, y, first, step)
    for weights, gradient, at in ((e, d_e, (1, 2, 0)), (e, d_e, (3, 4, 1)), (first, d_first, (2,)), (step, d_step, (0, 1)), (step, d_step, (2, 2))):
        up, base = weights.copy(), likelihood(e, first, step)
        up[at] += 1e-6
        moved = likelihood(*[up if w is weights else w for w in (e, first, step)])
        assert abs((moved - base) / 1e-6 - gradient[at]) < 1e-4


def test_features_of_words():
    texts = pa.array(["schule ab", "schul"], pa.large_string())
    words = scan(texts, languageid.language_words(), Powers())
    of, coordinates = languageid.word_features(words, np.arange(3))
    sets = [set(coordinates[of == i].tolist()) for i in range(3)]
    # schule and schul share their first four prefixes and three runs; ab has 2 + 2 affixes and no run
    assert len(sets[0] & sets[2]) == 7 and len(sets[1]) == 4 and len(sets[0]) == 12


def test_held_out_rows(spark, sf_dir):
    rows = Q.op12_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_nothing_from_held_out_rows(spark):
    docs = switched_docs(spark)
    held = languageid.is_held_out()
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("text", F.when(held, F.lit("zz zz")).otherwise(F.col("text")))
    a, b = (languageid.fit(d) for d in (docs, other))
    assert a.packed() == b.packed()


def test_labels_of_switched_text(spark):
    field = languageid.fit(switched_docs(spark))
    parts = [SWITCHED["en"].split()[:9], SWITCHED["fr"].split()[:8], SWITCHED["de"].split()[:10]]
    docs = spark.createDataFrame([(1, " ".join(w for p in parts for w in p)), (2, "1 2 3"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in languageid.label_words(docs, field).collect()}
    got = [(r["first"], r["last"], r["lang"]) for r in rows[1].runs]
    assert got == [(0, 8, "en"), (9, 16, "fr"), (17, 26, "de")]
    assert rows[1].n_words == 27 and all(r["probability"] > 0.6 for r in rows[1].runs)
    assert rows[2].n_words == 0 == rows[3].n_words and rows[2].runs == [] == rows[3].runs


def test_odd_rows(spark, odd_docs):
    rows = languageid.classify(odd_docs).collect()
    want = odd_docs.select("doc_id", "text").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in want)
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in want}
    assert all((r.lang_pred != "und") == letters[r.doc_id] for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1}) == 1


def test_no_row_to_learn_from(spark, odd_docs):
    rows = languageid.classify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(rows) == odd_docs.count() and {r.lang_pred for r in rows} == {"und"}
    assert languageid.classify(odd_docs.limit(0)).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(languageid, "FIT_ROWS", 60)
    counts = languageid.language_sample(switched_docs(spark)).groupBy("lang").count().collect()
    assert {r["count"] for r in counts} == {20}
