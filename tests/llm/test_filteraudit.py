import re
from collections import Counter
from itertools import permutations

from barloom.llm import filteraudit
from barloom.llm import queries as Q

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and least is not None and least < doc_id,
    }
    return {k for k, v in tests.items() if v}


def brute(docs, labels):
    """The audit of ``(doc_id, text, part)`` rows, filter by filter."""
    least, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    rows = [(part or "", i, failures(text or "", i, least.get(text or ""))) for i, text, part in docs]
    out = []
    for part in {p for p, _, _ in rows}:
        own, shapley, found = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                goes = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(goes)
                failing = sum(f in r[2] for r in own)
                found.append((part, order, step, len(left), len(goes), failing - len(goes), sum(r[2] == {f} for r in own), sum(r[1] in good for r in goes), sum(r[1] in toxic for r in goes)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def audit(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert audit(Q.op11_filter_audit(spark, sf_dir)) == brute(docs, labels)


def test_odd_rows(spark, odd_docs):
    told = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (4, None, 1), (99, 1, 1)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text, r.lang) for r in odd_docs.select("doc_id", "text", "lang").collect()]
    assert audit(filteraudit.filter_audit(odd_docs, labels)) == brute(docs, [t for t in told if t[0] is not None])


def test_equal_texts_across_parts(spark):
    docs = [(i, "same text", "en" if i % 3 else "de") for i in range(50)] + [(0, "same text", "de")] * 3 + [(70, "", "fr"), (71, None, "fr"), (72, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    assert audit(filteraudit.filter_audit(df, labels)) == brute(docs, [(i, i % 2, (i + 1) % 2) for i in range(50)])


def test_empty_table(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.filter_audit(odd_docs.limit(0), labels).count() == 0
    assert filteraudit.filter_audit(odd_docs, labels).agg({"good_lost": "max"}).first()[0] == 0
