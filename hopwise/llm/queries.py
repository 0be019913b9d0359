"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hopwise.llm.bpe import bpe_digests
from hopwise.llm.common import RID, table
from hopwise.llm.exact_dedup import exact_dedup
from hopwise.llm.lines import LINES, REACH, repeated_units
from hopwise.llm.packing import packed
from hopwise.llm.quality import factor_scores, fit_factor_machine, fit_ngram_model, quality_rules
from hopwise.llm.repeats import remove_repeats
from hopwise.llm.sharding import SEED, SHARDS, interleaved_shards
from hopwise.llm.simhash import near_duplicates
from hopwise.llm.wrapper import extract_main_text


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_hashed_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_ngram_model(docs, table(spark, sf_dir, "labels")))


def op4_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op6_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"))


def op7_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op8_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return factor_scores(docs, fit_factor_machine(docs, table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents")).drop(RID)


def op10_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_induction": op1_wrapper_induction,
    "op2_suffix_intervals": op2_suffix_intervals,
    "op3_hashed_ngram_rules": op3_hashed_ngram_rules,
    "op4_pivot_simhash": op4_pivot_simhash,
    "op5_bounded_packing": op5_bounded_packing,
    "op6_stratified_sharding": op6_stratified_sharding,
    "op7_streaming_bpe": op7_streaming_bpe,
    "op8_factor_machine": op8_factor_machine,
    "op9_line_dedup": op9_line_dedup,
    "op10_tree_merge_dedup": op10_tree_merge_dedup,
}

_OP6 = f"""
WITH bits AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size,
    flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: list_transform(range(8), lambda k: (('0x' || h)::BIGINT >> k) & 1))) AS b
  FROM documents),
d AS (
  SELECT doc_id, size, coalesce('s' || source, 'n') AS stratum, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS shuffled,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295::BIGINT) AS text_crc32
  FROM bits),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY shuffled, doc_id, size, text_crc32) - 0.5::DOUBLE)
    / count(*) OVER (PARTITION BY stratum) AS part FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY part, stratum, shuffled, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((place * {SHARDS}) // total)::INTEGER AS shard,
  (place - (((place * {SHARDS}) // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""

_OP9 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS p FROM documents),
p AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS p FROM d),
w AS (SELECT doc_id, i, regexp_replace(p, '^[\x20\x09-\x0D]+', '') AS word, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS "end" FROM p),
v AS (SELECT *, "end" - length(word) AS start, ('0x' || md5(word)[1:8])::BIGINT AS v FROM w),
x AS (SELECT *, (5 * lag(v) OVER (PARTITION BY doc_id ORDER BY i) + 3 * v) % 4294967296 AS x FROM v),
b AS (
  SELECT *, i = 0 OR (x < coalesce(min(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING), 4294967296)
    AND x <= coalesce(min(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {REACH} FOLLOWING), 4294967296)) AS begins FROM x),
c AS (SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM b),
l AS (SELECT doc_id, line, min(start) AS start, max("end") AS "end", count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s FROM c GROUP BY doc_id, line),
u AS (
  SELECT doc_id, line - 1 AS unit, start, max("end") OVER k AS "end", sum(n) OVER k AS n_words, string_agg(s, ' ' ORDER BY line) OVER k AS s,
    count(*) OVER (PARTITION BY doc_id) AS lines FROM l
  WINDOW k AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND {LINES - 1} FOLLOWING)),
h AS (SELECT doc_id, unit::BIGINT AS unit, start, "end", n_words::BIGINT AS n_words, md5(s) AS digest FROM u WHERE unit <= greatest(lines - {LINES}, 0)),
f AS (
  SELECT doc_id, unit, start, "end", n_words, digest,
    first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start FROM h
  WINDOW w AS (PARTITION BY digest ORDER BY doc_id, start))
SELECT * FROM f WHERE doc_id <> first_doc_id OR start <> first_start
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

#: What SQL can't express is tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op6_stratified_sharding": _OP6, "op9_line_dedup": _OP9, "op10_tree_merge_dedup": _OP10}
