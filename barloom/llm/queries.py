"""The registered queries over the text tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .storage import bound_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .compaction import compacted
    from .storage import scratch_path

    live = compacted(_table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return live.select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("text_md5"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import length_histogram

    return length_histogram(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filteraudit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .languageid import classify

    return classify(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import link_profile

    return link_profile(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_toxicity": op2_toxicity,
        "op3_quality": op3_quality,
        "op4_sharding": op4_sharding,
        "op5_minhash": op5_minhash,
        "op6_licenses": op6_licenses,
        "op7_imatch": op7_imatch,
        "op8_packing": op8_packing,
        "op9_token_counts": op9_token_counts,
        "op10_decontaminate": op10_decontaminate,
        "op11_filter_audit": op11_filter_audit,
        "op12_language": op12_language,
        "op13_alignment": op13_alignment,
    }


#: Of a page: its payload, whether a larger page_id has the same one, and how many segments of
#: 2048 bytes its block takes: a head of 87 bytes, and chunks of at most 8192 bytes with their sizes.
OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept,
    87 + payload_bytes + 8 * (payload_bytes // 8192)
      + CASE WHEN payload_bytes % 8192 > 0 THEN 4 + length(format('{:x}', payload_bytes % 8192)) ELSE 0 END + 5 AS block
  FROM d
), r AS (
  SELECT *, payload_bytes >= 1000 AND kept IS DISTINCT FROM page_id AND kept IS NOT NULL AS again FROM k
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN kept END AS refers_to,
  CASE WHEN again THEN 1 ELSE CAST((block + 2047) // 2048 AS BIGINT) END AS segments,
  true AS length_ok, true AS digest_ok
FROM r
"""


#: What was appended and compacted is the table itself.
OP4_SQL = "SELECT doc_id, source, lang, n_chars, md5(text) AS text_md5 FROM documents"


#: Each document's failures, then every order step by step, without cells.
OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY text) AS least FROM t
), g AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    map {
      'A': len(words) < 200,
      'B': 100 * len(list_distinct(words)) < 50 * len(words),
      'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'),
      'E': coalesce(least < doc_id, false)
    } AS fails
  FROM w LEFT JOIN g USING (doc_id)
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders
), s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, good, toxic,
    fails[substr(filter_order, step, 1)] AS here,
    len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda x: x <> '' AND fails[x])) > 0 AS earlier,
    len(list_filter(map_values(fails), lambda x: x)) AS failed
  FROM f, steps
), r AS (
  SELECT part, filter_order, step, letter,
    count(*) FILTER (WHERE NOT here AND NOT earlier) AS kept,
    count(*) FILTER (WHERE here AND NOT earlier) AS removed,
    count(*) FILTER (WHERE here AND earlier) AS redundant,
    count(*) FILTER (WHERE here AND failed = 1) AS unique_fails,
    count(*) FILTER (WHERE here AND NOT earlier AND good = 1) AS good_lost,
    count(*) FILTER (WHERE here AND NOT earlier AND toxic = 1) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_sharding": OP4_SQL, "op11_filter_audit": OP11_SQL}
