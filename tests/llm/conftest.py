import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and ids, odd characters, and clashing extra columns."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog", "de", None, None),
        (2, "another text of the same id", None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "de", "a", 0),
        (5, " \n\t  \x0b", "en", "a", 3),
        (None, "no id here & SOME words in it", "en", None, 5),
        (None, "no id here & SOME words in it", "en", None, 5),
        (6, long, "en", "a", len(long)),
        (7, "a▁b and <s> </s> <|endoftext|> <0x0A>", None, "a", 5),
        (8, "漢字 と かな 😀 “quoted” — ½ ǅ ́x\x00y\x1cz\x85\xa0w\r\n\r\n", "fr", "b", 40),
        (9, "x" * 5000 + " " * 40_000 + "y\n\n\n\nz", "en", "b", 5000),
        (10, "12345 ... !!! 678", "es", "b", 17),
        (11, "é à ñ ß", "fr", "b", 7),
        (12, "def f(x):\n    return x  # it's\n\n\tdone", "en", "b", 7),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("block", "pair", "n", "part", "mask", "digest", "quality", "toxic", "score", "lang_pred", "held_out", "_text"):
        df = df.withColumn(name, F.lit("clash"))
    return df
