"""Queries of problems 3, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import credentials, leaks, packing, quality


#: Bins of a packing in terms of the tokens' own number of bins: best-fit decreasing needs at most 11/9 of the least number.
NEAR = 11 / 9


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.places(table(spark, d, "commits"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "commits"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sizes_of(table(spark, d, "documents")), table(spark, d, "containers"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pack(spark, d).where(F.col("of") > 1).select("capacity", "doc_id").distinct()


def p7_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return packing.utilisation(p7_pack(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing, by capacity: all tokens there, nothing twice, nothing over capacity, no item split needlessly, bins near the least number."""
    packed = cut(p7_pack(spark, d))
    of_bin = packed.groupBy("capacity", "bin").agg(F.sum("size").alias("load")).groupBy("capacity").agg(F.count("*").alias("bins"), F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))
    of_piece = packed.groupBy("capacity", "doc_id", "piece").agg(F.count("*").alias("k"), F.sum("size").alias("size"), F.max(F.col("piece") > F.ceil(F.col("of"))).alias("beyond"))
    sums = of_piece.groupBy("capacity").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"), F.count_if(F.col("k") > 1).alias("repeated"), F.count_if("beyond").alias("beyond"))
    near = F.col("bins") <= NEAR * F.ceil(F.col("tokens") / F.col("capacity")) + 1
    return sums.join(of_bin, "capacity").select("capacity", "pieces", "tokens", "repeated", "beyond", "overfull", near.alias("near"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    return p9_statistics(spark, d).select("doc_id", "n_words", "n_lines", "mean_word_length")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(p9_statistics(spark, d)).distinct()


QUERIES = {
    "p3_found": p3_found, "p3_redacted": p3_redacted, "p7_found": p7_found, "p7_pack": p7_pack, "p7_utilisation": p7_utilisation, "p7_check": p7_check,
    "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_statistics": p9_statistics, "p9_counts": p9_counts,
}
_TOKENS = "len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'))"
_BREAKS, _WHITE = "[\\n\\r\\x{85}\\x{2028}\\x{2029}]", "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_WORDS = "regexp_extract_all(text, '[\\p{L}\\p{M}\\x{ad}]+')"
SQL = {
    "p7_check": f"SELECT capacity, sum(ceil(size / capacity))::BIGINT AS pieces, sum(size)::BIGINT AS tokens, 0 AS repeated, 0 AS beyond, 0 AS overfull, true AS near FROM (SELECT DISTINCT capacity FROM containers), (SELECT doc_id, {_TOKENS} AS size FROM documents) WHERE size > 0 GROUP BY 1",
    "p9_counts": f"""SELECT doc_id, len(w) AS n_words, n_lines, CASE WHEN len(w) = 0 THEN 0.0 ELSE list_sum([length(x) FOR x IN w]) / len(w) END AS mean_word_length FROM
  (SELECT doc_id, {_WORDS} AS w, len(list_filter(regexp_split_to_array(text, '{_BREAKS}'), lambda x: regexp_matches(x, '[^{_WHITE}]'))) AS n_lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""",
    "p7_found": f"SELECT DISTINCT capacity, doc_id FROM containers, (SELECT doc_id, {_TOKENS} AS size FROM documents) WHERE size > capacity",
}
