"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, decontam, html_text, katz, merkle, quality, simhash, tokenbin, urlfilter, warc


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.index(table(spark, sf_dir, "documents"), word_tokenizer())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_neighbours(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), word_tokenizer())


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_decontamination, op3_quality, op4_merkle, op5_html, op6_warc, op7_simhash, op8_katz, op9_url_filter, op10_bpe)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, {WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[k + 1 : k + n], ' ') AS g FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(0, greatest(len(ws) - 12, 1))) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, pos, n, array_to_string(ws[pos + 1 : pos + n], ' ') AS g FROM (SELECT r, ws, n, unnest(range(0, len(ws) - n + 1)) AS pos FROM d JOIN sizes ON len(ws) >= n)),
hits AS (SELECT r, pos, n, item_id FROM grams JOIN win USING (n, g)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)"""

BITS = "array_to_string(list_transform(string_split(h, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '')"
DIGIT = " + ".join(f"{1 << (4 - k)} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
BASE32 = f"array_to_string(list_transform(range(0, 32), lambda i: substr('{UPPER}234567', 1 + {DIGIT}, 1)), '')"

OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h), b AS (SELECT *, {BITS} AS bits FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM b JOIN g USING (h)"""

#: The other operations need what SQL lacks here: tokenizers, XXH64, BLAKE2b, HTML parsing, matrix factors, or models too
#: slow in SQL over whole tables. Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op6_warc": OP6_SQL}
