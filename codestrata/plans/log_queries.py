"""Queries over the decision log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text
from codestrata.operators import log_stats
from codestrata.operators.decisions import kept_decisions
from codestrata.plans.core_queries import ranked_decisions_sql
from codestrata.plans.registry import Registry
from codestrata.session import table

R = Registry()
#: 2026-07-01, and the window of reports in days.
NOW_SEC, DAYS = 1_782_864_000, 30

_K = f"(SELECT * EXCLUDE (file), file_form AS file FROM {ranked_decisions_sql()} WHERE rn = 1)"
_V = "CASE WHEN coalesce(gv, '') = '' THEN 'unknown' WHEN regexp_matches(gv, '^[0-9]') THEN 'v' || gv ELSE gv END"
_KEY = "coalesce(array_to_string(list_sort(list_distinct(symbols)), ','), '')"
_ASKS = f"""(SELECT * FROM {_K} k WHERE decision = 'ask' AND mode = 'hook' QUALIFY row_number() OVER (
  PARTITION BY ts_sec, repo, lang, gv, reason, file, {_KEY} ORDER BY delivery_id) = 1)"""

_COLUMNS = ["repo", "lang", "gv", "reason", "mode", "symbols", "learn_symbols", "checks", "check_reasons"]


def records(spark: SparkSession, d: str, *carry: str) -> DataFrame:
    return kept_decisions(table(spark, d, "decisions"), carry or _COLUMNS)


def _group(name: str, column: str, expr: str) -> None:
    @R.query(
        name,
        f"""SELECT {column} AS key, count(*) FILTER (WHERE decision = 'ask') AS asks, count(*) FILTER (WHERE decision = 'defer') AS defers
        FROM {_K} WHERE ts_sec >= {NOW_SEC - DAYS * 86400} GROUP BY 1""",
    )
    def run(spark, d):
        rows = records(spark, d, expr).filter(F.col("ts_sec") >= NOW_SEC - DAYS * 86400)
        n = lambda x, a: F.count_if(F.col("decision") == x).alias(a)
        return rows.groupBy(F.col(expr).alias("key")).agg(n("ask", "asks"), n("defer", "defers"))


_group("guard_stats_by_repo", "repo", "repo")
_group("guard_stats_by_lang", "lang", "lang")
_group("guard_stats_by_mode", "mode", "mode")


@R.query("guard_stats_sets", f"""SELECT coalesce(repo, '*') AS repo, coalesce(lang, '*') AS lang, count(*) FILTER (WHERE decision = 'ask') AS asks, count(*) AS records
  FROM (SELECT coalesce(repo, '-') AS repo, coalesce(lang, '-') AS lang, decision FROM {_K}) GROUP BY GROUPING SETS ((repo), (lang), ())""")
def guard_stats_sets(spark, d):
    rows = records(spark, d, "repo", "lang").select(F.coalesce("repo", F.lit("-")).alias("repo"), F.coalesce("lang", F.lit("-")).alias("lang"), "decision")
    sets = rows.groupingSets([["repo"], ["lang"], []], "repo", "lang").agg(F.count_if(F.col("decision") == "ask").alias("asks"), F.count("*").alias("records"))
    return sets.select(F.coalesce("repo", F.lit("*")).alias("repo"), F.coalesce("lang", F.lit("*")).alias("lang"), "asks", "records")


@R.query("top_symbols", f"SELECT symbol, count(*) AS asks FROM (SELECT unnest(symbols) AS symbol FROM {_K} WHERE decision = 'ask') WHERE symbol IS NOT NULL GROUP BY symbol ORDER BY asks DESC, symbol LIMIT 25")
def top_symbols(spark, d):
    rows = records(spark, d, "symbols").filter("decision = 'ask'").select(F.explode("symbols").alias("symbol")).filter("symbol is not null")
    return rows.groupBy("symbol").agg(F.count("*").alias("asks")).orderBy(F.col("asks").desc(), "symbol").limit(25)


@R.query("defer_reasons", f"SELECT reason, count(*) AS defers FROM {_K} WHERE decision = 'defer' GROUP BY reason")
def defer_reasons(spark, d):
    return records(spark, d, "reason").filter("decision = 'defer'").groupBy("reason").agg(F.count("*").alias("defers"))


@R.query("check_tallies", f"""SELECT "check", count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'violation') AS violation,
  count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) FILTER (WHERE status = 'skipped') AS skipped
  FROM (SELECT e.key AS "check", e.value AS status FROM (SELECT unnest(map_entries(checks)) AS e FROM {_K})) GROUP BY 1""")
def check_tallies(spark, d):
    return log_stats.check_tally(records(spark, d, "checks"))


@R.query("check_reason_counts", f"""SELECT "check", reason, count(*) AS n FROM (SELECT e.key AS "check", e.value AS reason FROM (SELECT unnest(map_entries(check_reasons)) AS e FROM {_K})) GROUP BY ALL""")
def check_reason_counts(spark, d):
    return records(spark, d, "check_reasons").select(F.explode("check_reasons").alias("check", "reason")).groupBy("check", "reason").agg(F.count("*").alias("n"))


@R.query("reason_split", f"""SELECT c AS "check", count(*) AS asks FROM (SELECT trim(unnest(string_split(reason, '+'))) AS c FROM {_K} WHERE decision = 'ask') WHERE c <> '' GROUP BY c""")
def reason_split(spark, d):
    rows = records(spark, d, "reason").filter("decision = 'ask'").select(F.explode(log_stats.split_checks(F.col("reason"))).alias("check"))
    return rows.groupBy("check").agg(F.count("*").alias("asks"))


@R.query("ask_dedupe", f"SELECT delivery_id FROM {_ASKS}")
def ask_dedupe(spark, d):
    return log_stats.unique_asks(records(spark, d, "repo", "lang", "gv", "reason", "mode", "symbols")).select("delivery_id")


@R.query("versions", f"SELECT {_V} AS version, count(*) AS records, count(*) FILTER (WHERE decision = 'ask') AS asks FROM {_K} GROUP BY 1")
def versions(spark, d):
    rows = records(spark, d, "gv")
    return rows.groupBy(log_stats.canonical_version(F.col("gv")).alias("version")).agg(F.count("*").alias("records"), F.count_if(F.col("decision") == "ask").alias("asks"))


@R.query("newest_version", r"""SELECT repo, p[1] || '.' || p[2] || '.' || p[3] AS newest FROM (SELECT repo, max(list_transform(string_split(regexp_extract(gv, '^v?(\d+\.\d+\.\d+)', 1), '.'), lambda x: x::BIGINT)) AS p
  FROM """ + _K + r""" WHERE regexp_matches(gv, '^v?\d+\.\d+\.\d+') GROUP BY repo)""")
def newest_version(spark, d):
    """Largest semantic version a repository's records carry."""
    rows = records(spark, d, "gv", "repo").select("repo", text.version_parts(F.col("gv")).alias("p")).filter("p is not null")
    return rows.groupBy("repo").agg(F.max("p").alias("p")).select("repo", F.concat_ws(".", "p.major", "p.minor", "p.patch").alias("newest"))


@R.query("mixed_versions", f"SELECT count(DISTINCT {_V}) > 1 AS mixed, count(DISTINCT {_V}) AS versions FROM {_ASKS} WHERE {_KEY} <> ''")
def mixed_versions(spark, d):
    asks = log_stats.unique_asks(records(spark, d, "repo", "lang", "gv", "reason", "mode", "symbols")).filter("symbol_key <> ''")
    n = F.countDistinct(log_stats.canonical_version(F.col("gv")))
    return asks.agg((n > 1).alias("mixed"), n.alias("versions"))


@R.query("recent_counts", f"SELECT decision, count(*) AS n FROM {_K} WHERE ts_sec >= {NOW_SEC} - 7 * 86400 AND decision IN ('ask', 'outcome') GROUP BY decision")
def recent_counts(spark, d):
    return records(spark, d, "mode").filter(F.col("ts_sec") >= NOW_SEC - 7 * 86400).filter("decision in ('ask', 'outcome')").groupBy("decision").agg(F.count("*").alias("n"))


@R.query("daily_volume", f"SELECT ts_sec // 86400 AS day, decision, count(*) AS n FROM {_K} GROUP BY ALL")
def daily_volume(spark, d):
    return records(spark, d, "mode").groupBy(F.floor(F.col("ts_sec") / 86400).alias("day"), "decision").agg(F.count("*").alias("n"))


_T = "ts_sec * 1000000 + rpad(left(ts_frac, 6), 6, '0')::BIGINT"


@R.query("interval_candidates", f"""SELECT a.delivery_id AS ask_id, min(o.t - a.t) AS first_after_us, count(*) AS candidates FROM (SELECT delivery_id, file, {_KEY} AS k, {_T} AS t FROM {_ASKS} WHERE file IS NOT NULL) a
  JOIN (SELECT file, {_KEY} AS k, {_T} AS t FROM {_K} WHERE decision = 'outcome' AND reason = 'approved' AND file IS NOT NULL) o ON a.file = o.file AND a.k = o.k AND a.k <> ''
  AND o.t >= a.t AND o.t - a.t < 300000000 GROUP BY a.delivery_id""")
def interval_candidates(spark, d):
    """Outcomes of an ask's file and symbols within five minutes after it, met in buckets of an hour."""
    r = records(spark, d, "repo", "lang", "gv", "reason", "mode", "symbols")
    t = (F.col("ts_sec") * 1_000_000 + F.rpad(F.substring("ts_frac", 1, 6), 6, "0").cast("bigint")).alias("t")
    a = log_stats.unique_asks(r).filter("file is not null and symbol_key <> ''").select("delivery_id", "file", "symbol_key", t)
    o = r.filter("decision = 'outcome' and reason = 'approved' and file is not null").select("file", log_stats.symbol_key(F.col("symbols")).alias("symbol_key"), t.alias("ot"))
    hour = 3_600_000_000
    a = a.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor(F.col("t") / hour), F.floor((F.col("t") + 300_000_000) / hour)))))
    o = o.withColumn("bucket", F.floor(F.col("ot") / hour))
    near = a.join(o, ["file", "symbol_key", "bucket"]).filter("ot >= t and ot - t < 300000000")
    return near.groupBy(F.col("delivery_id").alias("ask_id")).agg(F.min(F.col("ot") - F.col("t")).alias("first_after_us"), F.count("*").alias("candidates"))


_RATED = f"""a AS (SELECT file, delivery_id AS id, edit, {_KEY} AS key, {_T} AS t, row_number() OVER (PARTITION BY file ORDER BY {_T}, delivery_id) AS k FROM {_ASKS} WHERE file IS NOT NULL AND {_KEY} <> ''),
 o AS (SELECT file, delivery_id AS id, edit, {_KEY} AS key, {_T} AS t FROM {_K} WHERE decision = 'outcome' AND reason = 'approved' AND file IS NOT NULL AND {_KEY} <> ''),
 c AS (SELECT a.id AS ask, o.id, o.t, 1 AS track FROM a JOIN o ON a.file = o.file AND a.edit = o.edit AND a.edit <> '' AND o.t >= a.t AND o.t - a.t < 86400000000
       UNION ALL SELECT a.id, o.id, o.t, 2 FROM a JOIN o ON a.file = o.file AND a.key = o.key AND o.t >= a.t AND o.t - a.t < 300000000),
 q AS (SELECT ask, list((track, t, id)) AS cs FROM c GROUP BY ask),
 s AS (SELECT a.file, a.id, a.t, cs, row_number() OVER (PARTITION BY a.file ORDER BY a.k) AS k FROM a JOIN q ON q.ask = a.id),
 g(file, k, used, ask, hit) AS (SELECT DISTINCT file, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::STRUCT(a INTEGER, b BIGINT, c BIGINT) FROM s
   UNION ALL SELECT file, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.c) END, ask, hit FROM (
     SELECT s.file, s.k, g.used, s.id AS ask, list_min(list_transform(list_filter(s.cs, lambda x: NOT list_contains(g.used, x[3])), lambda x: {{'a': x[1], 'b': x[2], 'c': x[3]}})) AS hit FROM g JOIN s ON s.file = g.file AND s.k = g.k + 1)),
 approvals AS (SELECT g.ask AS ask_id, hit.c AS outcome_id, CASE hit.a WHEN 1 THEN 'fingerprint' ELSE 'symbols' END AS track, hit.b - s.t AS latency_us FROM g JOIN s ON s.id = g.ask WHERE hit IS NOT NULL)"""


@R.query("greedy_approvals", f"WITH RECURSIVE {_RATED} SELECT * FROM approvals")
def greedy_approvals(spark, d):
    return log_stats.approvals(records(spark, d, "repo", "lang", "gv", "reason", "mode", "symbols"))


_SINCE = NOW_SEC - DAYS * 86400
_RECENT = _RATED.replace(_K, f"(SELECT * FROM {_K} WHERE ts_sec >= {_SINCE})")
_REPORT_ASKS = _ASKS.replace(_K, f"(SELECT * FROM {_K} WHERE ts_sec >= {_SINCE})")


@R.query("approval_report", f"""WITH RECURSIVE {_RECENT},
 p AS (SELECT x.*, {_V} AS version, {_KEY} AS key_, ask_id FROM {_REPORT_ASKS} x LEFT JOIN approvals ON ask_id = delivery_id),
 e AS (SELECT 'window' AS bucket, NULL::VARCHAR AS key, key_, version, ask_id FROM p UNION ALL SELECT 'reason', reason, key_, version, ask_id FROM p UNION ALL SELECT 'lang', lang, key_, version, ask_id FROM p
  UNION ALL SELECT 'version', version, key_, version, ask_id FROM p UNION ALL SELECT * FROM (SELECT 'check', trim(unnest(string_split(reason, '+'))) AS c, key_, version, ask_id FROM p) WHERE c <> ''),
 n AS (SELECT bucket, key, count(*) FILTER (WHERE key_ <> '') AS asks, count(ask_id) AS approved, count(*) FILTER (WHERE key_ = '') AS unrated, count(DISTINCT version) FILTER (WHERE key_ <> '') AS versions, count(*) AS total FROM e GROUP BY bucket, key)
 SELECT *, CASE WHEN asks = 0 THEN 0 ELSE approved / asks END AS rate, asks / total AS coverage, asks >= 20 AND versions = 1 AND CASE WHEN asks = 0 THEN 0 ELSE approved / asks END > 0.5 AS gate FROM n""")
def approval_report(spark, d):
    """Asks, approvals, rate and coverage of the window, by reason, check, language and version in one pass."""
    r = records(spark, d, "repo", "lang", "gv", "reason", "mode", "symbols")
    return log_stats.approval_buckets(r, NOW_SEC - DAYS * 86400)


@R.query("approval_latency", f"""WITH RECURSIVE {_RATED} SELECT track, count(*) AS n, min(latency_us) AS min_us, quantile_cont(latency_us, 0.5) AS median_us, floor(avg(latency_us))::BIGINT AS mean_us, max(latency_us) AS max_us FROM approvals GROUP BY track""")
def approval_latency(spark, d):
    return log_stats.latency(log_stats.approvals(records(spark, d, "repo", "lang", "gv", "reason", "mode", "symbols")), ["track"])


@R.query("duplicate_fires", f"""WITH RECURSIVE e AS (SELECT delivery_id, {_T} AS t, row_number() OVER w AS k, dense_rank() OVER (ORDER BY file, reason, {_KEY}) AS g FROM {_K} WHERE decision = 'ask' AND file IS NOT NULL WINDOW w AS (PARTITION BY file, reason, {_KEY} ORDER BY {_T}, delivery_id)),
  f(g, k, id, kept_t, kept_id) AS (SELECT g, k, delivery_id, t, delivery_id FROM e WHERE k = 1
   UNION ALL SELECT e.g, e.k, e.delivery_id, CASE WHEN e.t - f.kept_t <= 5000000 THEN f.kept_t ELSE e.t END, CASE WHEN e.t - f.kept_t <= 5000000 THEN f.kept_id ELSE e.delivery_id END FROM f JOIN e ON e.g = f.g AND e.k = f.k + 1)
  SELECT id AS delivery_id, kept_id AS fires_after FROM f WHERE id <> kept_id""")
def duplicate_fires(spark, d):
    return log_stats.duplicate_fires(records(spark, d, "reason", "symbols"))


@R.query("latency_stats", f"""SELECT decision, count(*) AS n, min(v) AS min_us, quantile_cont(v, 0.5) AS median_us, floor(avg(v))::BIGINT AS mean_us, max(v) AS max_us
  FROM (SELECT decision, epoch_us(received_at) - ({_T}) AS v FROM {_K}) GROUP BY decision""")
def latency_stats(spark, d):
    """Delivery latency of the kept copies."""
    t = F.col("ts_sec") * 1_000_000 + F.rpad(F.substring("ts_frac", 1, 6), 6, "0").cast("bigint")
    rows = records(spark, d, "mode").select("decision", (F.unix_micros(F.col("received_at").cast("timestamp")) - t).alias("latency_us"))
    return log_stats.latency(rows, ["decision"])


@R.query("asof_rev", f"""SELECT a.delivery_id, s.snapshot_id FROM (SELECT delivery_id, repo, ts_sec AS t FROM {_K} WHERE decision = 'ask' AND repo IS NOT NULL) a ASOF LEFT JOIN
  (SELECT r.name AS repo, epoch(timestamp)::BIGINT AS t, max(snapshot_id) AS snapshot_id FROM snapshots s JOIN repos r USING (repo_id) GROUP BY ALL) s ON a.repo = s.repo AND a.t >= s.t WHERE s.snapshot_id IS NOT NULL""")
def asof_rev(spark, d):
    """Each ask with the newest snapshot of its repository at or before it."""
    asks = records(spark, d, "repo").filter("decision = 'ask' and repo is not null").select("repo", F.col("ts_sec").alias("t"), "delivery_id")
    names = table(spark, d, "repos").select("repo_id", F.col("name").alias("repo"))
    snaps = table(spark, d, "snapshots").join(names, "repo_id").groupBy("repo", F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("t")).agg(F.max("snapshot_id").alias("snapshot_id"))
    return log_stats.as_of(asks, snaps, ["repo"], "snapshot_id").filter("snapshot_id is not null").select("delivery_id", "snapshot_id")


_FIRST = "(SELECT s.name AS symbol, min(epoch(f.seen_at))::BIGINT AS first_seen FROM symbols s JOIN source_files f USING (source_id) WHERE s.kind IN ('function', 'class') GROUP BY s.name)"


@R.query("audit_verdicts", f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN first_seen IS NULL THEN 'stands' WHEN first_seen <= ts_sec THEN 'fp' ELSE 'premature' END AS verdict
  FROM (SELECT ts_sec, unnest(list_distinct(symbols)) AS symbol FROM {_K} WHERE decision = 'ask') LEFT JOIN {_FIRST} USING (symbol)) GROUP BY verdict""")
def audit_verdicts(spark, d):
    """Flagged symbols that existed already (fp), came later (premature) or never came (stands)."""
    flagged = records(spark, d, "symbols").filter("decision = 'ask'").select("ts_sec", F.explode(F.array_distinct("symbols")).alias("symbol"))
    s = table(spark, d, "symbols").filter("kind in ('function', 'class')").join(table(spark, d, "source_files").select("source_id", "seen_at"), "source_id")
    first = s.groupBy(F.col("name").alias("symbol")).agg(F.min(F.unix_seconds(F.col("seen_at").cast("timestamp"))).alias("first_seen"))
    verdict = F.when(F.col("first_seen").isNull(), "stands").when(F.col("first_seen") <= F.col("ts_sec"), "fp").otherwise("premature")
    return flagged.join(first, "symbol", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@R.query("hallucination_origin", f"""SELECT delivery_id, unnest(CASE WHEN learn_symbols IS NOT NULL THEN learn_symbols WHEN reason = 'violations' THEN symbols ELSE [] END) AS symbol FROM {_K} WHERE decision = 'ask'""")
def hallucination_origin(spark, d):
    """learn_symbols where known (empty means none), else all symbols of pure violations."""
    own = F.when(F.col("learn_symbols").isNotNull(), F.col("learn_symbols")).when(F.col("reason") == "violations", F.col("symbols"))
    return records(spark, d, "symbols", "learn_symbols", "reason").filter("decision = 'ask'").select("delivery_id", F.explode(own).alias("symbol"))


@R.query("learned_allow", f"""SELECT repo, symbol, count(*) AS count, max(t) AS last_seen_us FROM (SELECT repo, {_T} AS t, unnest(symbols) AS symbol FROM {_K} WHERE decision = 'outcome' AND reason = 'approved' AND repo IS NOT NULL)
  WHERE symbol IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND max(t) >= {(NOW_SEC - 14 * 86400) * 1_000_000}""")
def learned_allow(spark, d):
    t = (F.col("ts_sec") * 1_000_000 + F.rpad(F.substring("ts_frac", 1, 6), 6, "0").cast("bigint")).alias("t")
    rows = records(spark, d, "repo", "symbols", "reason").filter("decision = 'outcome' and reason = 'approved' and repo is not null").select("repo", t, F.explode("symbols").alias("symbol")).filter("symbol is not null")
    return log_stats.learned_allow(rows, 14, 2, NOW_SEC * 1_000_000)


@R.query("recent_unrecorded_asks", f"""WITH e AS (SELECT delivery_id, file, edit, decision, {_T} AS t FROM {_K} WHERE file IS NOT NULL AND decision IN ('ask', 'outcome')),
  w AS (SELECT *, max(CASE WHEN decision = 'ask' THEN (t, delivery_id) END) OVER f AS wa, max(CASE WHEN decision = 'outcome' THEN (t, delivery_id) END) OVER f AS wo,
    max(CASE WHEN decision = 'ask' THEN (t, delivery_id) END) OVER g AS ha, max(CASE WHEN decision = 'outcome' THEN (t, delivery_id) END) OVER g AS ho FROM e
    WINDOW f AS (PARTITION BY file ORDER BY t, delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY file, edit ORDER BY t, delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r AS (SELECT delivery_id, edit IS NOT NULL AND ha IS NOT NULL AND t - ha[1] < 86400000000 AS keyed, coalesce(ho > ha, false) AS hrec, ha[2] AS h, wa IS NOT NULL AND t - wa[1] < 300000000 AS near, coalesce(wo > wa, false) AS wrec, wa[2] AS a FROM w WHERE decision = 'outcome')
  SELECT delivery_id, CASE WHEN keyed THEN h ELSE a END AS ask_id, CASE WHEN keyed THEN 'edit' ELSE 'window' END AS track FROM r WHERE CASE WHEN keyed THEN NOT hrec ELSE near AND NOT wrec END""")
def recent_unrecorded_asks(spark, d):
    """The ask each outcome record answers, as the recorder looks it up at that moment."""
    return log_stats.recent_asks(records(spark, d, "mode"))


@R.query("confusion_matrix", f"""SELECT lang, count(*) FILTER (WHERE flagged AND bad) AS tp, count(*) FILTER (WHERE NOT flagged AND bad) AS fn, count(*) FILTER (WHERE flagged AND NOT bad) AS fp,
  count(*) FILTER (WHERE NOT flagged AND NOT bad) AS tn FROM (SELECT coalesce(lang, '-') AS lang, decision = 'ask' AS flagged, list_contains(map_values(checks), 'violation') AS bad FROM {_K} WHERE checks IS NOT NULL AND cardinality(checks) > 0) GROUP BY lang""")
def confusion_matrix(spark, d):
    """Asks against the presence of a violation, by language."""
    rows = records(spark, d, "lang", "checks").filter("size(checks) > 0").select(
        F.coalesce("lang", F.lit("-")).alias("lang"), (F.col("decision") == "ask").alias("flagged"), F.array_contains(F.map_values("checks"), "violation").alias("bad"))
    n = lambda c, a: F.count_if(c).alias(a)
    f, b = F.col("flagged"), F.col("bad")
    return rows.groupBy("lang").agg(n(f & b, "tp"), n(~f & b, "fn"), n(f & ~b, "fp"), n(~f & ~b, "tn"))


@R.query("edit_fingerprints", """SELECT edit_id, CASE WHEN coalesce(tool, '') = '' THEN '' ELSE left(sha256(tool || chr(0) || file || chr(0) || coalesce(edit, '') || chr(0) || coalesce(repo, '') || chr(0)
  || coalesce(array_to_string(list_transform(symbols, lambda s: coalesce(s, '') || chr(0) || reverse(coalesce(s, '')) || chr(0)), ''), '')), 12) END AS fingerprint FROM applied_edits""")
def edit_fingerprints(spark, d):
    """Fingerprints over the texts at hand: file, edit and repository as old, new and content, symbols as a multi-edit."""
    edits = F.transform("symbols", lambda s: F.struct(s.alias("old"), F.reverse(s).alias("new")))
    print_ = text.edit_fingerprint(F.col("tool"), F.col("file"), F.col("edit"), F.col("repo"), edits)
    return table(spark, d, "applied_edits").select("edit_id", print_.alias("fingerprint"))


@R.query("active_contracts", f"""SELECT repo, arg_max(contract, (ts_sec, delivery_id)) AS contract, count(DISTINCT contract) AS seen FROM {_K} WHERE contract IS NOT NULL AND repo IS NOT NULL GROUP BY repo""")
def active_contracts(spark, d):
    """The contract a repository's newest record names: latest wins over append-only rows."""
    rows = records(spark, d, "repo", "contract").filter("contract is not null and repo is not null")
    return rows.groupBy("repo").agg(F.max_by("contract", F.struct("ts_sec", "delivery_id")).alias("contract"), F.countDistinct("contract").alias("seen"))


QUERIES, SQL = R.queries, R.sql
