"""Queries of the operators for training text, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.paths import path_form_sql
from codestrata.llm.encode import encode_corpus
from codestrata.llm.mixing import Mix, mixed, share_report
from codestrata.llm.nearest import TOLERANCE_SECONDS, edit_partners
from codestrata.llm.sentences import sentences
from codestrata.llm.source_text import checked_files, documented_functions, parse_rates, unparsable_files
from codestrata.llm.terms import COMMON_PERCENT, RARE_RECORDS, name_frequencies
from codestrata.plans.core_queries import ranked_decisions_sql
from codestrata.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return edit_partners(table(spark, d, "decisions"), table(spark, d, "applied_edits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unparsable_files(table(spark, d, "source_files"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse_rates(table(spark, d, "source_files"), table(spark, d, "repos"))


def p3_failures(spark: SparkSession, d: str) -> DataFrame:
    return checked_files(table(spark, d, "source_files")).filter("not ok").drop("ok")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(table(spark, d, "source_files")).select("source_id", "name")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(table(spark, d, "source_files"))


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return name_frequencies(table(spark, d, "decisions"), table(spark, d, "symbol_counts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).filter("mark is not null").select("name", "mark")


def p7_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str, how: str) -> Mix:
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"), how)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "nearest").selection


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(_mix(spark, d, "nearest"))


def p9_temperature_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "temperature").selection


def p9_temperature_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(_mix(spark, d, "temperature"))


def p9_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(_mix(spark, d, "exact"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents")).select("doc_id", "start_pos", "end_pos")


def p10_lengths(spark: SparkSession, d: str) -> DataFrame:
    found = sentences(table(spark, d, "documents"))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest")
    )


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p3_failures": p3_failures,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p7_found": p7_found,
    "p7_frequencies": p7_frequencies,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_temperature_mix": p9_temperature_mix,
    "p9_temperature_shares": p9_temperature_shares,
    "p9_exact_shares": p9_exact_shares,
    "p10_found": p10_found,
    "p10_lengths": p10_lengths,
}

_SET = "list_sort(list_distinct(list_filter(symbols, lambda s: s IS NOT NULL)))"
_P7 = f"""
WITH k AS (SELECT 'd' || delivery_id AS record, symbols FROM {ranked_decisions_sql()} WHERE rn = 1),
 s AS (SELECT 's' || session_id AS record, name, count AS n FROM symbol_counts WHERE session_id IS NOT NULL),
 p AS (SELECT record, unnest(symbols) AS name, 1 AS n FROM k UNION ALL SELECT record, name, n FROM s),
 t AS (SELECT (SELECT count(*) FROM k) + (SELECT count(DISTINCT record) FROM s) AS total),
 f AS (SELECT name, sum(coalesce(n, 0))::BIGINT AS occurrences, count(DISTINCT record) AS records
       FROM p WHERE name IS NOT NULL GROUP BY name)
SELECT name, occurrences, records, CASE WHEN records < {RARE_RECORDS} THEN 'rare'
       WHEN records * 100 > total * {COMMON_PERCENT} THEN 'common' END AS mark FROM f, t"""

SQL = {
    "p2_found": f"""
WITH a AS (SELECT delivery_id, file_form AS file, {_SET} AS symbols, edit,
             ts_sec::HUGEINT * 1000000000 + rpad(left(ts_frac, 9), 9, '0')::HUGEINT AS t
           FROM {ranked_decisions_sql()} WHERE rn = 1 AND decision = 'ask' AND file_form IS NOT NULL),
 e AS (SELECT edit_id, {path_form_sql("file")} AS file, {_SET} AS symbols, edit,
         epoch_us(applied_at)::HUGEINT * 1000 AS t FROM applied_edits),
 p AS (SELECT delivery_id, edit_id, row_number() OVER (PARTITION BY edit_id ORDER BY abs(a.t - e.t), a.t, delivery_id) AS rn
       FROM e JOIN a USING (file, symbols)
       WHERE len(symbols) > 0 AND abs(a.t - e.t) <= {TOLERANCE_SECONDS} * 1000000000::HUGEINT
         AND NOT coalesce(a.edit <> e.edit, false))
SELECT delivery_id, edit_id FROM p WHERE rn = 1""",
    "p7_found": f"SELECT name, mark FROM ({_P7}) WHERE mark IS NOT NULL",
    "p7_frequencies": _P7,
}
