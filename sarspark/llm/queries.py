"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from . import decontam, html_text, packing, pii, quality, shard, simhash, tokencount, urlfilter, warc

#: The rules of the URL query, as (host and path, action).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(_table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.interleave(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return scored.select(*first, F.round("p_good", 6).alias("p_good"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlfilter.rule_table(spark, [urlfilter.host_rule(*r) for r in URL_RULES] + urlfilter.PATTERNS)
    judged = urlfilter.judge(_table(spark, sf_dir, "pages"), rules)
    given = [r for r, _ in URL_RULES]
    named = F.when(F.col("rule").isin(given), F.col("rule"))
    return judged.select("page_id", "host", "path", named.alias("rule"), "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_simhash, op3_html, op4_shards, op5_tokens, op6_warc, op7_quality, op8_packing, op9_decontamination, op10_urls)}


_WORDS = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"
_SHINGLES = "list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)])"


def oracle_sql() -> dict[str, str]:
    host = "translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, '{verdict}' AS action, '{rule.partition('/')[0]}' AS h, '/{rule.partition('/')[2]}' AS p" for rule, verdict in URL_RULES
    )
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha1(h), 5 * i + 1, 5))::BIGINT >> j) % 32 + 1, 1)"
    own = " OR ".join(f"regexp_matches(host || path, '{pattern}')" for _, _, pattern, _, _ in urlfilter.PATTERNS)
    return {
        "op6_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
            SELECT page_id, strlen(h) AS payload_bytes, list_aggregate(flatten([[{digit} for j in [15, 10, 5, 0]] for i in range(8)]), 'string_agg', '') AS payload_digest,
                   CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
            FROM p JOIN f USING (h)
        """,
        "op9_decontamination": f"""
            WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
            ds AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM d), s AS (SELECT item_id, {_SHINGLES} AS l FROM i WHERE len(w) > 4),
            e AS (SELECT item_id, len(l) AS n_item, unnest(l) AS s FROM s),
            c AS (SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM (SELECT DISTINCT doc_id, s FROM ds) ds JOIN e USING (s) GROUP BY ALL),
            f AS (SELECT DISTINCT doc_id, item_id, 1::BIGINT AS n_item, 1::BIGINT AS n_shared FROM d, i WHERE len(i.w) < 5 AND i.w[1] <> '' AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' '))
            SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment FROM (SELECT * FROM c WHERE n_shared >= 0.8 * n_item UNION ALL BY NAME SELECT * FROM f)
        """,
        "op10_urls": f"""
            WITH u AS (SELECT row_number() OVER () AS n, page_id, {host} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
            r AS ({fits}),
            f AS (SELECT n, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM u JOIN r
                  ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY n)
            SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN action WHEN {own} THEN 'block' ELSE 'allow' END AS verdict
            FROM u LEFT JOIN f USING (n)
        """,
    }
