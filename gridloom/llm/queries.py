"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, fim, hard_negatives, html_text, imatch, licenses, ngram_lm, quality, sharding, simhash, token_files, warc
from ._common import table
from .license_texts import NOTICES, SPELLINGS

#: Bytes of text in a shard at most: few enough that the smallest tables are split several times.
SHARD_BYTES = 64 << 10


def crc_is_two(modulus: int):
    """True for a modulus-th of the rows, by the text of their doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 2


def op1_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), crc_is_two(7))


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, decoded=True))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_is_two(4))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = token_files.write_token_files(docs, tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, files, kind=docs.schema["doc_id"].dataType)


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.compare_with_edits(docs, imatch.build_lexicon(docs))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.page_records(warc.read_warc(spark, warc.write_warc(pages)), pages.schema["page_id"].dataType)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_lm, op2_extendible_sharding, op3_decontamination, op4_simhash_near_dedup, op5_byte_level_bpe, op6_quality_classifier, op7_token_files, op8_imatch_fingerprints, op9_html_extraction, op10_license_scan, op11_hard_negatives, op12_warc, op13_fill_in_middle)}


def sharding_sql(max_bytes: int = SHARD_BYTES) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
n AS (
  SELECT doc_id, n_bytes, depth, substr(bits, 1, depth) AS shard,
         CAST(sum(n_bytes) OVER w AS BIGINT) AS shard_bytes, count(*) OVER w AS shard_rows
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(40))
  WINDOW w AS (PARTITION BY depth, substr(bits, 1, depth)))
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_rows FROM n
WHERE shard_bytes <= {max_bytes} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""


def contamination_sql(window: int = 10) -> str:
    def words(x: str) -> str:
        x = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"list_filter(string_split_regex({x}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {words('text')} AS w FROM benchmark),
v AS (SELECT item_id, list_slice(w, i, i + {window - 1}) AS v FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
k AS (SELECT DISTINCT len(v) AS n FROM v),
g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS s FROM d, k WHERE len(w) >= n),
h AS (SELECT DISTINCT doc_id, i, item_id, n FROM g JOIN (SELECT DISTINCT item_id, array_to_string(v, ' ') AS s FROM v) u USING (s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_sql() -> str:
    def same(x: str, some: list[tuple[str, str]]) -> str:
        for a, b in some:
            x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
        return x

    def lines(x: str) -> str:
        x = rf"regexp_replace(lower(coalesce({x}, '')), '(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright[ \t]*(?:\(c\)|©|:|<|\[|\{{|yyyy|[0-9])[^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved[^\p{{L}}\p{{N}}\n]*)$', '', 'g')"
        x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
        x = rf"regexp_replace(chr(10) || chr(10) || {x} || chr(10) || chr(10), '(\n *\n) *copyright [^\n]*(\n *\n)', '\1\2', 'g')"
        return same(x, SPELLINGS)

    def whole(x: str) -> str:
        return same(rf"trim(regexp_replace({x}, '[ \n]+', ' ', 'g'))", [s for s in SPELLINGS if " " in s[0].strip()])

    texts = ", ".join(f"({_quoted(i)}, {_quoted(x)})" for i, x in licenses.texts())
    notices = ", ".join(f"({_quoted(i)}, {_quoted(x)})" for i, x in NOTICES)
    return f"""
WITH t AS (SELECT md5({whole(lines('text'))}) AS digest, min(license_id) AS license_id FROM (VALUES {texts}) v(license_id, text) GROUP BY 1),
n AS (SELECT md5({whole(lines('text'))}) AS digest, min(license_id) AS license_id FROM (VALUES {notices}) v(license_id, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS n, doc_id, {lines('text')} AS l FROM documents),
w AS (SELECT n, doc_id, md5({whole('l')}) AS digest FROM d),
e AS (SELECT n, md5({whole('x')}) AS digest FROM (SELECT n, unnest(string_split(l, chr(10))) AS x FROM d)),
f AS (SELECT e.n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM e JOIN n USING (digest) GROUP BY e.n)
SELECT w.doc_id, w.digest, t.license_id, coalesce(f.notices, '') AS notices
FROM w LEFT JOIN t USING (digest) LEFT JOIN f ON w.n = f.n"""


def oracle_sql() -> dict[str, str]:
    return {"op2_extendible_sharding": sharding_sql(), "op3_decontamination": contamination_sql(), "op10_license_scan": license_sql()}
