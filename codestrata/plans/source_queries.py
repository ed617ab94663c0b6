"""Queries of readers, writers and reports over the given tables, with SQL written from the rules themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.instants import instant_fraction, instant_seconds
from codestrata.functions.paths import path_form, path_form_sql
from codestrata.functions.text import byte_levenshtein
from codestrata.operators import reports, structure
from codestrata.operators.store import Store
from codestrata.plans.core_queries import ranked_decisions_sql
from codestrata.plans.registry import Registry
from codestrata.session import shared_dir, table
from codestrata.sources import records as sources

R = Registry()
_K = f"(SELECT * FROM {ranked_decisions_sql()} WHERE rn = 1)"


@R.query("instants", r"""SELECT delivery_id, CASE WHEN regexp_matches(ts, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[-+]([01][0-9]|2[0-3]):[0-5][0-9])$')
  THEN epoch_us(try_cast(ts AS TIMESTAMPTZ)) // 1000000 END AS seconds FROM decisions""")
def instants(spark, d):
    return table(spark, d, "decisions").select("delivery_id", instant_seconds(F.col("ts")).alias("seconds"))


@R.query("instant_fractions", r"SELECT delivery_id, regexp_replace(regexp_extract(ts, '[.]([0-9]+)', 1), '0+$', '') AS fraction FROM decisions WHERE ts IS NOT NULL")
def instant_fractions(spark, d):
    return table(spark, d, "decisions").filter("ts is not null").select("delivery_id", instant_fraction(F.col("ts")).alias("fraction"))


@R.query("decision_log_records", r"""SELECT file_name, line_no, json_extract_string(body, '$.ts') AS ts, json_extract_string(body, '$.mode') AS mode, json_extract_string(body, '$.reason') AS reason FROM log_lines
  WHERE json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(body, '$.ts') = 'VARCHAR'
  AND regexp_matches(json_extract_string(body, '$.ts'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[-+]([01][0-9]|2[0-3]):[0-5][0-9])$')""")
def decision_log_records(spark, d):
    """Raw lines read as decision records; broken lines and lines without a readable ts are no records."""
    lines = table(spark, d, "log_lines")
    return sources.parse_decisions(lines, F.col("body"), keep=("file_name", "line_no")).select("file_name", "line_no", "ts", "mode", "reason")


@R.query("edit_blocks", """SELECT edit_id AS session_id, tool, file, i - 1 AS block, CASE WHEN len(symbols) > 0 THEN symbols[i] ELSE edit END AS old, CASE WHEN len(symbols) > 0 THEN reverse(symbols[i]) ELSE repo END AS new
  FROM (SELECT edit_id::VARCHAR AS edit_id, tool, file, symbols, edit, repo, unnest(range(1, greatest(coalesce(len(symbols), 0), 1) + 1)) AS i FROM applied_edits)""")
def edit_blocks(spark, d):
    """Applied edits as the JSON requests a host would send, read again one row an edit block."""
    edits = F.transform("symbols", lambda s: F.struct(s.alias("old_string"), F.reverse(s).alias("new_string")))
    inner = F.struct(F.col("file").alias("file_path"), F.col("edit").alias("old_string"), F.col("repo").alias("new_string"), edits.alias("edits"))
    sent = table(spark, d, "applied_edits").select(F.to_json(F.struct(F.col("edit_id").cast("string").alias("session_id"), F.col("tool").alias("tool_name"), inner.alias("tool_input"))).alias("body"))
    return sources.edit_payloads(sent, F.col("body")).select("session_id", "tool", "file", F.col("block").cast("bigint").alias("block"), "old", "new")


@R.query("diff_lines", """SELECT source_id, path, i + 4 AS line_no, md5(line) AS digest FROM (SELECT source_id, path, i, string_split(content, chr(10))[i] AS line FROM
  (SELECT source_id, path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM source_files WHERE content IS NOT NULL AND path IS NOT NULL))""")
def diff_lines(spark, d):
    """Every source as a unified diff that adds it at line 5, behind a removed line and a context line that look like headers."""
    rows = table(spark, d, "source_files").filter("content is not null and path is not null")
    lines = F.split("content", "\n", -1)
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n")
    n = F.size(lines)
    text = F.concat(F.lit("diff --git\n--- a/old\n+++ b/"), "path", F.lit("\n@@ -4,2 +4,"), n + 1, F.lit(" @@ f\n --- a/x\n--- y\n"), body, F.lit("\n\\ No newline at end of file"))
    found = sources.diff_added_lines(rows.select("source_id", text.alias("diff")), "source_id", "diff")
    return found.select("source_id", "path", F.col("line_no").cast("bigint").alias("line_no"), F.md5("text").alias("digest"))


@R.query("ignore_entries", r"""SELECT entry, regexp_matches(entry, '[*?[]') AS is_glob, count(*) AS n FROM (SELECT trim(unnest(string_split(content, chr(10)))) AS entry FROM source_files) WHERE entry <> '' AND entry NOT LIKE '#%' GROUP BY ALL""")
def ignore_entries(spark, d):
    """Lines of all sources read as an ignore file: comments and blanks dropped, globs told from names."""
    lines = table(spark, d, "source_files").select(F.explode(F.split("content", "\n", -1)).alias("line"))
    return sources.ignore_lists(lines, F.col("line")).groupBy("entry", "is_glob").agg(F.count("*").alias("n"))


@R.query("learned_allow_file", f"""SELECT repo, symbol, count(*) AS count, max(ts_sec)::VARCHAR AS last_seen FROM (SELECT repo, ts_sec, unnest(symbols) AS symbol FROM {_K} WHERE repo IS NOT NULL) WHERE symbol IS NOT NULL GROUP BY ALL""")
def learned_allow_file(spark, d):
    """Symbol counts of each repository written as learned-allow JSON and read again."""
    from codestrata.operators.decisions import kept_decisions

    rows = kept_decisions(table(spark, d, "decisions"), ["repo", "symbols"]).filter("repo is not null").select("repo", "ts_sec", F.explode("symbols").alias("symbol")).filter("symbol is not null")
    sums = rows.groupBy("repo", "symbol").agg(F.count("*").cast("int").alias("count"), F.max("ts_sec").cast("string").alias("last_seen"))
    files = sums.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("count", "last_seen")))).alias("m"))
    body = F.to_json(F.create_map("repo", "m"))
    return sources.learned_allow_json(files.select(body.alias("body")), F.col("body")).select("repo", "symbol", F.col("count").cast("bigint").alias("count"), "last_seen")


@R.query("module_requires", """WITH m AS (SELECT repo_id, 'x/' || label || '/s' || snapshot_id AS module, 'v1.' || snapshot_id || '.0' AS version, snapshot_id FROM (SELECT DISTINCT repo_id, label, snapshot_id FROM snapshots WHERE repo_id IS NOT NULL))
  SELECT repo_id, module, version, snapshot_id = (SELECT min(snapshot_id) FROM m n WHERE n.repo_id = m.repo_id) AS replaced FROM m""")
def module_requires(spark, d):
    """go.mod texts made of each repository's snapshots: a grouped and a single directive, comments, one replacement."""
    s = table(spark, d, "snapshots").filter("repo_id is not null").select("repo_id", "label", "snapshot_id").distinct()
    name, version = F.concat(F.lit("x/"), "label", F.lit("/s"), "snapshot_id"), F.concat(F.lit("v1."), "snapshot_id", F.lit(".0"))
    lines = s.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("snapshot_id", name.alias("name"), version.alias("version")))).alias("m"))
    line = lambda x: F.concat(x["name"], F.lit(" "), x["version"])
    first = F.col("m")[0]
    rest = F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0)))
    group = F.array_join(F.transform(rest, lambda x: F.concat(F.lit("\t"), line(x), F.lit(" // indirect\n"))), "")
    text = F.concat(F.lit("module x // own\n\ngo 1.22\nrequire "), line(first), F.lit("\nrequire (\n"), group, F.lit(")\nexclude (\n\told/mod v0.0.1\n)\nreplace "), first["name"], F.lit(" => ../local\n"))
    return sources.module_requires(lines.select("repo_id", text.alias("t")), "repo_id", "t")


@R.query("import_modules", f"""WITH f AS (SELECT DISTINCT {path_form_sql('path')} AS path FROM files WHERE path IS NOT NULL), m AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS module FROM f, range(1, 3) t(n) WHERE len(string_split(path, '/')) > n)
  SELECT path AS import_path, arg_max(module, length(module)) AS module FROM f JOIN m ON path = module OR starts_with(path, module || '/') GROUP BY path""")
def import_modules(spark, d):
    """The longest of the modules (directories of one and two levels) that each path lies in."""
    p = table(spark, d, "files").filter("path is not null").select(path_form(F.col("path")).alias("import_path")).distinct()
    parts = F.split("import_path", "/")
    heads = p.select(F.explode(F.array(*[F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "/")) for n in (1, 2)])).alias("module")).filter("module is not null").distinct()
    return sources.longest_module(p, heads.withColumn("version", F.lit("v1"))).select("import_path", "module")


def _symbols(spark, d) -> DataFrame:
    """The older index as rows of files: path is the source, ordinal the place in it."""
    order = Window.partitionBy("source_id").orderBy("line", "kind", "name", "sig_hash")
    s = table(spark, d, "symbols").withColumn("ordinal", F.row_number().over(order))
    return s.select(F.col("source_id").cast("string").alias("path"), "kind", "name", F.col("sig_hash").alias("hash"), "line", "doc", "ordinal")


@R.query("folded_symbols", """SELECT repo_id, kind, name, list_reduce(list(sig_hash ORDER BY source_id, line, sig_hash), lambda a, x: sha256(a || x)) AS hash, arg_min(line, (source_id, line, sig_hash)) AS line
  FROM symbols JOIN source_files USING (source_id) GROUP BY repo_id, kind, name""")
def folded_symbols(spark, d):
    """Symbols of one kind and name in a repository folded into one hash, in order of file and line."""
    order = Window.partitionBy("repo_id", "kind", "name").orderBy("source_id", "line", "sig_hash")
    rows = table(spark, d, "symbols").join(table(spark, d, "source_files").select("source_id", "repo_id"), "source_id").withColumn("ordinal", F.row_number().over(order))
    folded = reports.folded_symbols(rows.select(F.col("repo_id").alias("path"), "kind", "name", F.col("sig_hash").alias("hash"), "line", "doc", "ordinal"))
    return folded.select(F.col("path").alias("repo_id"), "kind", "name", "hash", "line")


@R.query("legacy_shape", """WITH s AS (SELECT source_id::VARCHAR AS path, kind, name, max(sig_hash) AS hash, max(line) AS line FROM symbols GROUP BY ALL)
  SELECT path, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'function'), '') AS functions, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'class'), '') AS classes,
  count(*) FILTER (WHERE hash <> '') AS hashes, count(*) FILTER (WHERE line > 0) AS lines FROM s GROUP BY path""")
def legacy_shape(spark, d):
    """The older structure shape of every file: names by kind, hashes and lines in maps."""
    once = _symbols(spark, d).groupBy("path", "kind", "name").agg(F.max("hash").alias("hash"), F.max("line").alias("line")).withColumn("content_hash", F.lit(""))
    old = reports.legacy_shape(once)
    return old.select("path", F.array_join("functions", ",").alias("functions"), F.array_join("classes", ",").alias("classes"), F.size("symbol_hashes").cast("bigint").alias("hashes"), F.size("symbol_lines").cast("bigint").alias("lines"))


@R.query("structure_roundtrip", "SELECT source_id::VARCHAR AS path, kind, name, max(line) AS line, max(sig_hash) AS hash FROM symbols GROUP BY ALL")
def structure_roundtrip(spark, d):
    """All symbols written as structure files and read again."""
    once = _symbols(spark, d).groupBy("path", "kind", "name").agg(F.max("hash").alias("hash"), F.max("line").alias("line")).withColumn("content_hash", F.lit("h"))
    folder = f"{shared_dir(spark)}/codestrata/{spark.sparkContext.applicationId}/structure-{uuid.uuid4().hex}"
    files = F.struct(F.col("content_hash").alias("hash"), "symbols")
    one = once.groupBy("path", "content_hash").agg(F.array_sort(F.collect_list(F.struct("kind", "name", "line", "hash"))).alias("symbols"))
    one.select(F.lit(7).alias("version"), F.create_map("path", files).alias("files")).write.json(folder)
    return sources.structure_facts(spark, folder, whole_files=False).select("path", "kind", "name", "line", "hash")


def _results(spark, d) -> DataFrame:
    from codestrata.operators.decisions import kept_decisions

    rows = kept_decisions(table(spark, d, "decisions"), ["checks", "check_reasons"])
    return rows.select(F.col("delivery_id").alias("event"), "check_reasons", F.explode("checks").alias("check", "verdict")).select(
        "event", "check", "verdict", F.coalesce(F.try_element_at("check_reasons", F.col("check")), F.lit("")).alias("reason")
    )


_RESULTS = f"""(SELECT delivery_id AS event, e.key AS "check", e.value AS verdict, coalesce(check_reasons[e.key], '') AS reason FROM (SELECT delivery_id, check_reasons, unnest(map_entries(checks)) AS e FROM {_K}))"""


@R.query("degraded_unknowns", f"""SELECT event, count(*) FILTER (WHERE verdict = 'unknown' AND reason NOT IN ('shadowed-qualifier', 'unexported-selector', 'ambiguous-receiver', 'ambiguous-local', 'name-known-elsewhere',
  'no-indexed-members', 'unreliable-call-shape', 'shadowed-callee', 'nested-def-shadow', 'ambiguous-decl-shapes', 'unusable-decl-shape', 'unparseable-added-signature', 'decl-edited-in-hunk')) AS n FROM {_RESULTS} GROUP BY event""")
def degraded_unknowns(spark, d):
    return reports.degraded_unknowns(_results(spark, d))


@R.query("verdict_maps", f"""SELECT event, string_agg("check" || ':' || verdict, ',' ORDER BY "check") AS checks, coalesce(string_agg("check" || ':' || reason, ',' ORDER BY "check") FILTER (WHERE verdict <> 'ok' AND reason <> ''), '') AS reasons FROM {_RESULTS} GROUP BY event""")
def verdict_maps(spark, d):
    """Verdicts of an event as two maps, shown as sorted text."""
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias(m)
    return reports.verdict_maps(_results(spark, d)).select("event", shown("checks"), shown("reasons"))


@R.query("scorecard", f"""WITH c AS (SELECT coalesce(lang, '-') AS lang, decision = 'ask' AS f, list_contains(map_values(checks), 'violation') AS b FROM {_K} WHERE checks IS NOT NULL AND cardinality(checks) > 0),
  n AS (SELECT lang, count(*) FILTER (WHERE f AND b) AS tp, count(*) FILTER (WHERE NOT f AND b) AS fn, count(*) FILTER (WHERE f AND NOT b) AS fp, count(*) FILTER (WHERE NOT f AND NOT b) AS tn FROM c GROUP BY lang)
  SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(fp / nullif(fp + tn, 0), 0) AS fp_rate, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM n""")
def scorecard(spark, d):
    """Confusion counts and ratios by language, asks against violations."""
    from codestrata.operators.decisions import kept_decisions

    rows = kept_decisions(table(spark, d, "decisions"), ["lang", "checks"]).filter("size(checks) > 0")
    cases = rows.select(F.coalesce("lang", F.lit("-")).alias("lang"), (F.col("decision") == "ask").alias("flagged"), F.array_contains(F.map_values("checks"), "violation").alias("label"))
    return reports.scorecard(cases, ["lang"])


@R.query("captured_cases", """SELECT source_id || ':' || line || ':' || name AS id, kind AS position, CASE WHEN line % 2 = 0 THEN 'hallucinated' ELSE 'real' END AS label FROM symbols""")
def captured_cases(spark, d):
    """Symbols as captured cases: known names hold the symbol where it is real; each case is validated."""
    s = table(spark, d, "symbols")
    bad = F.col("line") % 2 == 0
    cases = s.select(
        F.concat_ws(":", "source_id", "line", "name").alias("id"), F.concat("name", F.lit("(x)")).alias("source_line"), F.col("name").alias("referenced_symbol"),
        F.when(bad, "hallucinated").otherwise("real").alias("label"), F.when(bad, F.array(F.lit(""))).otherwise(F.array("name")).alias("known_symbols"), F.concat(F.lit("z; position="), "kind", F.lit(", w")).alias("notes"),
    )
    return reports.captured_cases(cases).select("id", "position", "label")


_FINDINGS = "(SELECT repo_id AS repo, '/' || path AS path, length(content) % 3 = 0 AS genuine FROM source_files WHERE content IS NOT NULL)"
_TRIAGE = f"""SELECT repo, count(*) AS findings, count(*) FILTER (WHERE g) AS generated, count(*) FILTER (WHERE genuine AND NOT g) AS genuine, count(*) FILTER (WHERE NOT genuine AND NOT g) / nullif(count(*) FILTER (WHERE NOT g), 0) AS fp_rate
  FROM (SELECT *, contains(path, '/node_modules/') OR contains(path, '/dist/') OR contains(path, '/build/') OR contains(path, '/vendor/') OR contains(path, '/.venv/') OR contains(path, '/_astro/') OR contains(path, '/coverage/')
    OR contains(path, '/immutable/') OR contains(path, '/.next/') OR contains(path, '/out/') OR contains(path, '/target/') AS g FROM {_FINDINGS}) GROUP BY repo"""


def _findings(spark, d) -> DataFrame:
    return table(spark, d, "source_files").filter("content is not null").select(F.col("repo_id").alias("repo"), F.concat(F.lit("/"), "path").alias("path"), (F.length("content") % 3 == 0).alias("genuine"))


@R.query("triage", _TRIAGE)
def triage(spark, d):
    return reports.triage(_findings(spark, d))


@R.query("triage_verdict", f"SELECT sum(genuine)::BIGINT AS genuine, count(*) FILTER (WHERE genuine > 0) AS repos, sum(genuine) >= 3 AND count(*) FILTER (WHERE genuine > 0) >= 2 AS worth FROM ({_TRIAGE})")
def triage_verdict(spark, d):
    return reports.triage_verdict(reports.triage(_findings(spark, d)))


@R.query("block_lines", """WITH b AS (SELECT repo_id, source_id, string_split(content, chr(10)) AS ls FROM source_files WHERE content IS NOT NULL), o AS (SELECT *, coalesce(sum(len(ls) + 1) OVER (PARTITION BY repo_id ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM b)
  SELECT repo_id, source_id, (off + i)::BIGINT AS line_no, md5(ls[i]) AS digest FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM o)""")
def block_lines(spark, d):
    """All sources of a repository as blocks of one edit, numbered with a gap between blocks."""
    rows = table(spark, d, "source_files").filter("content is not null").select(F.col("repo_id").alias("file"), F.col("source_id").alias("block"), F.col("content").alias("text"))
    return reports.block_lines(rows).select(F.col("file").alias("repo_id"), F.col("block").alias("source_id"), F.col("line_no").cast("bigint").alias("line_no"), F.md5("text").alias("digest"))


@R.query("block_positions", """SELECT source_id, CASE WHEN p > 0 THEN len(string_split(left(content, p - 1), chr(10))) ELSE 0 END AS line FROM (SELECT source_id, content, strpos(content, 'return') AS p FROM source_files WHERE content IS NOT NULL)""")
def block_positions(spark, d):
    rows = table(spark, d, "source_files").filter("content is not null")
    return rows.select("source_id", reports.block_position(F.lit("return"), F.col("content")).cast("bigint").alias("line"))


@R.query("cache_misses", """WITH p AS (SELECT repo_id::VARCHAR AS import_path, source_id::VARCHAR AS file, content FROM source_files WHERE content IS NOT NULL),
  k AS (SELECT import_path, sha256('v1' || chr(10) || import_path || chr(10) || string_agg(file || ':' || sha256(content), chr(10) ORDER BY file)) AS key FROM p GROUP BY import_path) SELECT * FROM k WHERE key NOT LIKE '0%'""")
def cache_misses(spark, d):
    """Repositories as packages, of which the cache holds those whose key begins with 0."""
    p = table(spark, d, "source_files").filter("content is not null").select(F.col("repo_id").cast("string").alias("import_path"), F.col("source_id").cast("string").alias("file"), "content")
    none = spark.createDataFrame([], "key string")
    cached = reports.cache_misses(p, none, "v1").filter("key like '0%'")
    return reports.cache_misses(p, cached, "v1")


@R.query("name_distances", "SELECT DISTINCT name, CASE WHEN levenshtein(name, lower(name)) <= 2 THEN levenshtein(name, lower(name)) ELSE -1 END AS distance FROM symbols WHERE regexp_full_match(name, '[ -~]*')")
def name_distances(spark, d):
    """Bounded distance of each name to itself in lower case."""
    rows = table(spark, d, "symbols").filter(F.col("name").rlike("^[ -~]*$")).select("name").distinct()
    return rows.select("name", byte_levenshtein(F.col("name"), F.lower("name"), 2).cast("bigint").alias("distance"))


@R.query("symbols_by_file", "SELECT source_id::VARCHAR AS path, string_agg(name || '@' || line, ',' ORDER BY line, name, kind) AS symbols FROM symbols GROUP BY source_id")
def symbols_by_file(spark, d):
    shown = F.array_join(F.transform("symbols", lambda s: F.concat(s["name"], F.lit("@"), s["line"])), ",")
    return reports.symbols_by_file(_symbols(spark, d)).select("path", shown.alias("symbols"))


@R.query("changed_paths", f"SELECT DISTINCT path FROM (SELECT {path_form_sql('path')} AS path FROM files UNION ALL SELECT {path_form_sql('path')} FROM source_files) WHERE path IS NOT NULL")
def changed_paths(spark, d):
    p = lambda name: table(spark, d, name).filter("path is not null").select(path_form(F.col("path")).alias("path"))
    return reports.changed_paths(p("files"), p("source_files"))


@R.query("kind_aliases", """SELECT asked, kind, count(*) AS symbols FROM symbols JOIN (VALUES ('func', 'function'), ('function', 'function'), ('class', 'class'), ('cls', 'class'), ('export', 'export'), ('exp', 'export'), ('import', 'import'), ('imp', 'import')) a(asked, kind) USING (kind) GROUP BY ALL""")
def kind_aliases(spark, d):
    """Symbols found under every name a kind may be asked by."""
    asked = spark.createDataFrame([(a,) for a in ("func", "function", "class", "cls", "export", "exp", "import", "imp", "field", "Func")], "asked string")
    kinds = asked.withColumn("kind", structure.normal_kind(F.col("asked"))).filter("kind is not null")
    return table(spark, d, "symbols").join(kinds, "kind").groupBy("asked", "kind").agg(F.count("*").alias("symbols"))


@R.query("repo_of_files", f"""SELECT file_id, arg_max(repo_id, (length(base), -repo_id)) AS repo_id FROM (SELECT f.file_id, r.repo_id, coalesce(r.source_root, r.path) AS base FROM (SELECT file_id, rtrim(s.root, '/') || '/' || {path_form_sql('f.path')} AS p
  FROM files f JOIN (SELECT DISTINCT snapshot_id, root FROM snapshots) s USING (snapshot_id) WHERE f.path IS NOT NULL) f JOIN repos r ON f.p = rtrim(coalesce(r.source_root, r.path), '/') OR starts_with(f.p, rtrim(coalesce(r.source_root, r.path), '/') || '/')) GROUP BY file_id""")
def repo_of_files(spark, d):
    """The repository whose root contains a file; the innermost of several, then the lowest id."""
    s = table(spark, d, "snapshots").select("snapshot_id", "root").distinct()
    full = F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), path_form(F.col("path")))
    f = table(spark, d, "files").filter("path is not null").join(s, "snapshot_id").select("file_id", full.alias("path"))
    r = table(spark, d, "repos").select("repo_id", F.coalesce("source_root", "path").alias("root"))
    return structure.containing(f, r)


@R.query("resolve_dirs", """WITH t AS (SELECT DISTINCT root AS dir FROM snapshots), x AS (SELECT dir, regexp_extract(dir, '^(/[^/]+/[^/]+/[^/]+)', 1) AS top, '/work/git/' || split_part(dir, '/', 4) || '.git' AS common_dir FROM t),
  c AS (SELECT common_dir, count(*) AS n, min(repo_id) AS first FROM repos WHERE coalesce(common_dir, '') <> '' GROUP BY common_dir), p AS (SELECT path, min(repo_id) AS repo_id FROM repos GROUP BY path)
  SELECT dir, CASE WHEN c.n = 1 THEN c.first WHEN c.n > 1 THEN coalesce((SELECT min(repo_id) FROM repos r WHERE r.common_dir = x.common_dir AND rtrim(r.path, '/') = rtrim(x.top, '/')), c.first) ELSE coalesce(p.repo_id, (SELECT min(repo_id) FROM repos r WHERE r.path = x.dir)) END AS repo_id
  FROM x LEFT JOIN c USING (common_dir) LEFT JOIN p ON p.path = x.top""")
def resolve_dirs(spark, d):
    """Repository of each worktree root: by common directory (ties by path, then lowest id), by top level, by its worktrees."""
    top = F.regexp_extract("dir", "^(/[^/]+/[^/]+/[^/]+)", 1)
    common = F.concat(F.lit("/work/git/"), F.get(F.split("dir", "/"), F.lit(3)), F.lit(".git"))
    dirs = table(spark, d, "snapshots").select(F.col("root").alias("dir")).distinct().select("dir", top.alias("top"), common.alias("common_dir"), F.array("dir").alias("worktrees"))
    return structure.resolve_repos(dirs, table(spark, d, "repos"))


_CONTRACTS = "(SELECT DISTINCT repo_id, session_id, label, root, timestamp, snapshot_id FROM snapshots WHERE repo_id IS NOT NULL)"


@R.query("session_contracts", f"SELECT repo_id, session_id, arg_max(label, (timestamp, snapshot_id)) AS name, arg_max(root, (timestamp, snapshot_id)) AS path FROM {_CONTRACTS} GROUP BY repo_id, session_id")
def session_contracts(spark, d):
    """The active contract of each (repository, session): the newest row counts; snapshots stand for activations."""
    rows = table(spark, d, "snapshots").filter("repo_id is not null").select("repo_id", "session_id", "label", "root", "timestamp", "snapshot_id").distinct()
    place = F.struct("timestamp", "snapshot_id")
    return rows.groupBy("repo_id", "session_id").agg(F.max_by("label", place).alias("name"), F.max_by("root", place).alias("path"))


@R.query("store_snapshots", """SELECT snapshot_id, max(timestamp) AS timestamp, arg_max(root_hash, timestamp) AS root_hash FROM snapshots WHERE repo_id IS NOT NULL GROUP BY snapshot_id""")
def store_snapshots(spark, d):
    """Snapshots and later touches appended to a store and read through its view; rows of newer layouts are not read."""
    store = Store(spark, f"{shared_dir(spark)}/codestrata/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}")
    rows = structure.distinct_snapshots(table(spark, d, "snapshots")).filter("repo_id is not null").withColumn("version", F.lit(9))
    early = rows.withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 1 DAY"))
    store.append("snapshots", early.unionByName(rows.withColumn("version", F.lit(10)).withColumn("snapshot_id", -F.col("snapshot_id"))))
    store.append("touches", rows.select("snapshot_id", "repo_id", "session_id", "timestamp"))
    return store.snapshots().select("snapshot_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "root_hash")


@R.query("upserted_files", f"""WITH s AS (SELECT snapshot_id, path, arg_max(lower(content_hash), file_id) AS h FROM (SELECT snapshot_id, file_id, content_hash, {path_form_sql('path')} AS path FROM files WHERE path IS NOT NULL) GROUP BY ALL)
  SELECT snapshot_id, path, CASE WHEN length(path) % 3 = 1 THEN 'new' || h ELSE h END AS content_hash FROM s WHERE length(path) % 3 <> 0""")
def upserted_files(spark, d):
    """Files of snapshots after single-file changes: every third path deleted, another third written anew."""
    f = table(spark, d, "files").filter("path is not null").withColumn("path", path_form(F.col("path"))).groupBy("snapshot_id", "path").agg(F.lower(F.max_by("content_hash", "file_id")).alias("content_hash"))
    third = F.length("path") % 3
    changes = f.filter(third != 2).select("snapshot_id", "path", F.when(third == 1, F.concat(F.lit("new"), "content_hash")).alias("content_hash"))
    return structure.upserted(f, changes, ["snapshot_id", "path"])


@R.query("suppressed_reports", f"""SELECT delivery_id, list_sort(list_distinct(list_filter(symbols, lambda s: NOT list_contains(coalesce(learn_symbols, []), s)))) AS symbols FROM {_K} WHERE decision = 'ask' AND symbols IS NOT NULL""")
def suppressed_reports(spark, d):
    """Reported symbols of each ask without those another list has reported already."""
    from codestrata.operators.decisions import kept_decisions

    rows = kept_decisions(table(spark, d, "decisions"), ["symbols", "learn_symbols"]).filter("decision = 'ask' and symbols is not null")
    return rows.select("delivery_id", reports.without_reported(F.col("symbols"), F.col("learn_symbols")).alias("symbols"))


@R.query("live_diff", """WITH k AS (SELECT source_id, kind, name, max(sig_hash) AS h FROM symbols GROUP BY ALL), a AS (SELECT * FROM k WHERE length(name) % 5 <> 0), b AS (SELECT source_id, kind, name, CASE WHEN length(name) % 7 = 0 THEN 'x' || h ELSE h END AS h FROM k WHERE length(name) % 4 <> 0 AND kind NOT IN ('unexported', 'field'))
  SELECT source_id::VARCHAR AS path, kind, name, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS status FROM a FULL JOIN b USING (source_id, kind, name) WHERE a.h IS NULL OR b.h IS NULL OR (a.h <> b.h AND a.h <> '' AND b.h <> '')""")
def live_diff(spark, d):
    """Symbols of a stored state against a live one; kinds that are not shown count on the stored side only."""
    k = _symbols(spark, d).groupBy("path", "kind", "name").agg(F.max("hash").alias("sig_hash"))
    live = k.filter(F.length("name") % 4 != 0).withColumn("sig_hash", F.when(F.length("name") % 7 == 0, F.concat(F.lit("x"), "sig_hash")).otherwise(F.col("sig_hash")))
    return structure.live_symbol_changes(k.filter(F.length("name") % 5 != 0), live)


@R.query("diff_payloads", """WITH k AS (SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY root ORDER BY t, snapshot_id) AS before FROM (SELECT root, snapshot_id, min(timestamp) AS t FROM snapshots WHERE root IS NOT NULL AND snapshot_id IS NOT NULL GROUP BY ALL)),
  f AS (SELECT snapshot_id, path, arg_max(h, file_id) AS h FROM (SELECT snapshot_id, file_id, """ + path_form_sql("path") + """ AS path, coalesce(lower(content_hash), '') AS h FROM files WHERE path IS NOT NULL) GROUP BY ALL),
  n AS (SELECT k.snapshot_id, path, h FROM k JOIN f USING (snapshot_id) WHERE before IS NOT NULL), b AS (SELECT k.snapshot_id, path, h FROM k JOIN f ON f.snapshot_id = k.before),
  c AS (SELECT snapshot_id, path, CASE WHEN b.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'modified' END AS status FROM n FULL JOIN b USING (snapshot_id, path) WHERE n.h IS DISTINCT FROM b.h)
  SELECT snapshot_id AS after_id, '{"added":[' || coalesce(string_agg('"' || path || '"', ',' ORDER BY path) FILTER (WHERE status = 'added'), '') || '],"removed":[' || coalesce(string_agg('"' || path || '"', ',' ORDER BY path) FILTER (WHERE status = 'removed'), '')
   || '],"modified":[' || coalesce(string_agg('"' || path || '"', ',' ORDER BY path) FILTER (WHERE status = 'modified'), '') || ']}' AS payload FROM c GROUP BY snapshot_id""")
def diff_payloads(spark, d):
    """What changed in each snapshot as one JSON object."""
    from codestrata.operators.snapdiff import snapshot_changes

    changes = snapshot_changes(table(spark, d, "snapshots"), table(spark, d, "files"))
    status = F.when(F.col("change") == "changed", "modified").otherwise(F.col("change"))
    return reports.payload(changes.select(F.col("snapshot_id").alias("after_id"), "path", status.alias("status")))


@R.query("stream_records", f"SELECT decision, count(*) AS records FROM {_K} GROUP BY decision")
def stream_records(spark, d):
    """All deliveries written as JSON lines and read as a stream, one copy of each record kept."""
    from codestrata.streaming.decision_stream import decision_stream, exactly_once

    folder = f"{shared_dir(spark)}/codestrata/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    names = [c for c in table(spark, d, "decisions").columns if c not in ("delivery_id", "batch_no", "received_at", "join_track")]
    table(spark, d, "decisions").select(*names, F.col("join_track").alias("join")).write.json(f"{folder}/in")
    kept = exactly_once(decision_stream(spark, f"{folder}/in")).select("decision")
    writer = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("decision string").parquet(f"{folder}/out").groupBy("decision").agg(F.count("*").alias("records"))


@R.query("line_states")
def line_states(spark, d):
    """Nesting depths and open literals before every line of the sources whose language is known."""
    from codestrata.functions.text import language_tag

    rows = table(spark, d, "source_files").filter("content is not null").select("source_id", language_tag(F.col("path")).alias("lang"), "content")
    return reports.line_states(rows.filter("lang <> ''"))


QUERIES, SQL = R.queries, R.sql
