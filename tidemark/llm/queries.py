"""The queries of this subpackage: thin uses of the operators with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, langid, mixing, packing, pii, quality, sentencepiece, sharding, simhash, spelling, toxicity, urls, winnow
from tidemark.llm.common import table

#: Target weights of the documents' sources; any other source shares the weight of ``other``.
WEIGHTS = {"src0": 20} | {f"src{i}": 5 if i < 10 else 4 for i in range(1, 20)}


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(table(spark, sf_dir, "documents"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, other=1)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.count_words(table(spark, sf_dir, "documents"), least_length=5, least_count=3, damage=97))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {"a_file": public_tokenizers.path("byte_bpe_50k.json"), "b_file": public_tokenizers.path("piece_bpe_32k.model")}
    return alignment.align(table(spark, sf_dir, "documents"), **files)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = packing.Limits(tokens=1_024, segments=256, loss=1_024)
    return packing.report(packing.pack(table(spark, sf_dir, "documents"), limits=limits, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii, "op2_toxicity": op2_toxicity, "op3_urls": op3_urls, "op4_sentencepiece": op4_sentencepiece, "op5_simhash": op5_simhash, "op6_quality": op6_quality, "op7_winnow": op7_winnow, "op8_shard": op8_shard, "op9_mix": op9_mix, "op10_langid": op10_langid,
    "op11_spelling": op11_spelling, "op12_alignment": op12_alignment, "op13_packing": op13_packing,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in urls.RULES)

ORACLES: dict[str, str] = {
    "op3_urls": f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, rverdict) AS (VALUES {_RULES}),
m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
         arg_max(rverdict, length(rhost || rpath) * 1000 + length(rhost)) AS rverdict
  FROM (SELECT DISTINCT page_id, host, path FROM h) JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id""",
    "op6_quality": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT doc_id, t, host, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), tri AS (
  SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, t, trim(l) AS line, len(string_split(trim(l), ' ')) AS n FROM (
    SELECT doc_id, host, t, unnest(string_split(regexp_replace(regexp_replace(lower(t), '[0-9]+', '0', 'g'), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10))) AS l FROM d)
  WHERE trim(l) <> ''
), freq AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS docs FROM lines GROUP BY host, line)
  JOIN (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host) USING (host)
  WHERE docs >= greatest({quality.MIN_DOCS}, {quality.MAX_SHARE} * host_docs)
), gone AS (
  SELECT doc_id, sum(n) AS n FROM lines JOIN freq USING (host, line) GROUP BY doc_id
), c AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w
), b AS (
  SELECT c.*, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed FROM c LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, n_removed::BIGINT AS n_removed, NOT base_failed AND n_words - n_removed >= {quality.MIN_KEPT_SHARE} * n_words AS kept FROM f""",
}
