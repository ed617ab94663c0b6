"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.instants import instant_sql
from codestrata.functions.paths import path_form_sql
from codestrata.operators.decisions import marked_deliveries
from codestrata.operators.drift import consistent_table, schema_changes
from codestrata.operators.snapdiff import snapshot_changes
from codestrata.session import table

_SEC, _FRAC = instant_sql("ts")


def ranked_decisions_sql() -> str:
    """Sub-select of readable decisions with rn = 1 for the kept copy."""
    return f"""(SELECT *, row_number() OVER (
      PARTITION BY ts_sec, ts_frac, edit, file_form, decision ORDER BY received_at, delivery_id) AS rn
      FROM (SELECT *, {_SEC} AS ts_sec, {_FRAC} AS ts_frac, {path_form_sql("file")} AS file_form FROM decisions)
      WHERE ts_sec IS NOT NULL)"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_deliveries(table(spark, d, "decisions")).filter("is_repeat").select("delivery_id")


def p1_kept_by_decision(spark: SparkSession, d: str) -> DataFrame:
    marked = marked_deliveries(table(spark, d, "decisions"))
    return marked.groupBy("decision").agg(
        F.count("*").alias("deliveries"), F.count_if(~F.col("is_repeat")).alias("records")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "log_lines"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return consistent_table(table(spark, d, "log_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "snapshots"), table(spark, d, "files"))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("snapshot_id", "change").agg(F.count("*").alias("paths"))


QUERIES = {
    "p1_found": p1_found,
    "p1_kept_by_decision": p1_kept_by_decision,
    "p4_found": p4_found,
    "p4_table": p4_table,
    "p6_found": p6_found,
    "p6_totals": p6_totals,
}

_P6 = f"""
WITH s AS (SELECT root, snapshot_id, min(timestamp) AS t FROM snapshots
           WHERE root IS NOT NULL AND snapshot_id IS NOT NULL GROUP BY ALL),
 o AS (SELECT root, snapshot_id, lag(snapshot_id) OVER (PARTITION BY root ORDER BY t, snapshot_id) AS before FROM s),
 f AS (SELECT snapshot_id, path, arg_max(h, file_id) AS h
       FROM (SELECT snapshot_id, file_id, {path_form_sql("path")} AS path, coalesce(lower(content_hash), '') AS h
             FROM files WHERE path IS NOT NULL) GROUP BY ALL),
 n AS (SELECT o.snapshot_id, f.path, f.h FROM o JOIN f USING (snapshot_id) WHERE before IS NOT NULL),
 b AS (SELECT o.snapshot_id, f.path, f.h FROM o JOIN f ON f.snapshot_id = o.before)
SELECT snapshot_id, path,
       CASE WHEN b.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN b USING (snapshot_id, path) WHERE n.h IS DISTINCT FROM b.h"""

SQL = {
    "p1_found": f"SELECT delivery_id FROM {ranked_decisions_sql()} WHERE rn > 1",
    "p1_kept_by_decision": f"""SELECT decision, count(*) AS deliveries, count(*) FILTER (WHERE rn = 1) AS records
      FROM {ranked_decisions_sql()} GROUP BY decision""",
    "p6_found": _P6,
    "p6_totals": f"SELECT snapshot_id, change, count(*) AS paths FROM ({_P6}) GROUP BY ALL",
}
