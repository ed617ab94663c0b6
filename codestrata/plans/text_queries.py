"""Queries of scalar and text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import globs, text
from codestrata.functions.paths import path_form, path_form_sql
from codestrata.operators.claims import claimed_symbols
from codestrata.operators.suggest import suggestions
from codestrata.plans.registry import Registry
from codestrata.session import table

R = Registry()


_BLANK = r"^[\s\x0B\x85\p{Z}]+|[\s\x0B\x85\p{Z}]+$"


@R.query("redact_documents", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)(api_key|api-key|apikey|secret|token|password|passwd|bearer|authorization|auth)([ \t\n\f\r]*[=:][ \t\n\f\r]*)[^ \t\n\f\r]+', '\1\2[REDACTED]', 'g'),
  '[-0-9=A-Z_a-z+]{32,}', '[REDACTED]', 'g')) AS digest FROM documents WHERE text IS NOT NULL""")
def redact_documents(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


@R.query("redact_settings", r"""SELECT source_id, i AS line_no, md5(regexp_replace(regexp_replace(l, '(?i)(api_key|api-key|apikey|secret|token|password|passwd|bearer|authorization|auth)([ \t\n\f\r]*[=:][ \t\n\f\r]*)[^ \t\n\f\r]+', '\1\2[REDACTED]', 'g'),
  '[-0-9=A-Z_a-z+]{32,}', '[REDACTED]', 'g')) AS digest FROM (SELECT source_id, i, ['password=', 'Authorization: ', 'passwd:', '/usr/share/lib/aaaa/bbbb/cccc/dddd/', 'bearer = '][1 + (i % 5)] || string_split(content, chr(10))[i] AS l
  FROM (SELECT source_id, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM source_files WHERE content IS NOT NULL))""")
def redact_settings(spark, d):
    """Every source line behind a key that makes it a secret, or behind a path that does not."""
    heads = F.array(*map(F.lit, ("password=", "Authorization: ", "passwd:", "/usr/share/lib/aaaa/bbbb/cccc/dddd/", "bearer = ")))
    lines = table(spark, d, "source_files").filter("content is not null").select("source_id", F.posexplode(F.split("content", "\n", -1)).alias("k", "line"))
    line = F.concat(F.get(heads, (F.col("k") + 1) % 5), "line")
    return lines.select("source_id", (F.col("k") + 1).cast("bigint").alias("line_no"), F.md5(text.redact(line)).alias("digest"))


@R.query("truncate_texts", f"""SELECT doc_id, CASE WHEN strlen(t) <= 80 THEN t ELSE left(t, list_max(list_filter(range(0, 81), lambda k: strlen(left(t, k)) <= 80))) || '...' END AS short
  FROM (SELECT doc_id, regexp_replace(text, '{_BLANK}', '', 'g') AS t FROM documents WHERE text IS NOT NULL)""")
def truncate_texts(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.truncate_bytes(F.col("text"), 80).alias("short"))


@R.query("code_symbols", "SELECT DISTINCT name FROM symbols WHERE length(name) > 2 AND regexp_matches(name, '\\p{Lu}') AND regexp_matches(name, '\\p{Ll}')")
def code_symbols(spark, d):
    return table(spark, d, "symbols").filter(text.is_code_symbol(F.col("name"))).select("name").distinct()


@R.query("language_tags", """SELECT source_id, CASE WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.py' THEN 'python' WHEN regexp_matches(path, '\\.(jsx?|tsx?|mjs|cjs|gs)$') THEN 'js' ELSE '' END AS tag FROM source_files""")
def language_tags(spark, d):
    return table(spark, d, "source_files").select("source_id", text.language_tag(F.col("path")).alias("tag"))


@R.query("first_doc_lines", f"""SELECT source_id, name, left(list_filter(list_transform(string_split(doc, chr(10)), lambda x: regexp_replace(x, '{_BLANK}', '', 'g')), lambda x: x <> '')[1], 200) AS doc FROM symbols WHERE doc IS NOT NULL""")
def first_doc_lines(spark, d):
    """The first line of a doc that is not blank; null where all are."""
    return table(spark, d, "symbols").filter("doc is not null").select("source_id", "name", text.first_doc_line(F.col("doc")).alias("doc"))


@R.query("first_text_lines", f"""SELECT doc_id, left(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_BLANK}', '', 'g')), lambda x: x <> '')[1], 200) AS doc FROM documents WHERE text IS NOT NULL""")
def first_text_lines(spark, d):
    """As ``first_doc_lines`` over texts of many lines."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.first_doc_line(F.col("text")).alias("doc"))


@R.query("backticked", "SELECT doc_id, regexp_extract(text, '`([^`]*)`', 1) AS symbol FROM documents WHERE contains(text, '`')")
def backticked(spark, d):
    return table(spark, d, "documents").filter(F.contains("text", F.lit("`"))).select("doc_id", text.first_backticked(F.col("text")).alias("symbol"))


_ID = r"[\p{L}_][\p{L}\p{N}_]*"
_CLAIMS = rf"""SELECT DISTINCT id, symbol FROM (
  SELECT id, unnest(regexp_extract_all(line, '`({_ID}(?:\.{_ID})*)`', 1)) AS symbol FROM l
  UNION ALL SELECT id, trim(unnest(string_split(m, ','))) FROM (SELECT id, unnest(regexp_extract_all(line, '\b(?:func|type|var|const)\s+(\p{{Lu}}[\p{{L}}\p{{N}}_]*(?:\s*,\s*\p{{Lu}}[\p{{L}}\p{{N}}_]*)*)', 1)) AS m FROM l)
  UNION ALL SELECT id, unnest(regexp_extract_all(line, '\b(?:class|function|let|const|def)\s+(\p{{L}}[\p{{L}}\p{{N}}_]*)', 1)) FROM l
  UNION ALL SELECT id, unnest(list_transform(regexp_extract_all(line, '\bfunc\s+\(\s*(?:{_ID}\s+)?\*?(?:\p{{L}}[\p{{L}}\p{{N}}_]*)(?:\[[^\]]*\])?\s*\)\s+(?:\p{{Lu}}[\p{{L}}\p{{N}}_]*)'), lambda m:
    regexp_extract(m, '\*?(\p{{L}}[\p{{L}}\p{{N}}_]*)(?:\[[^\]]*\])?\s*\)', 1) || '.' || regexp_extract(m, '([\p{{L}}\p{{N}}_]+)$', 1))) FROM l
  UNION ALL SELECT id, trim(unnest(string_split(m, ','))) FROM (SELECT id, regexp_extract(line, '^\s*(\p{{Lu}}[\p{{L}}\p{{N}}_]*(?:\s*,\s*\p{{Lu}}[\p{{L}}\p{{N}}_]*)*)(?:\s|=|$)', 1) AS m FROM b WHERE inside)
) WHERE length(symbol) > 2 AND regexp_matches(symbol, '\p{{Lu}}') AND regexp_matches(symbol, '\p{{Ll}}')"""
# blocks: from a line that opens one to the line at which the brackets since then are closed; members stand outside braces
_LINES = r"""l AS (SELECT id, i, string_split(t, chr(10))[i] AS line FROM (SELECT id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM s)),
 n AS (SELECT *, regexp_matches(line, '^\s*(?:var|const|type)\s*\(\s*$') AS opens, len(line) - len(replace(line, '(', '')) - len(line) + len(replace(line, ')', '')) AS up,
   len(line) - len(replace(line, '{', '')) - len(line) + len(replace(line, '}', '')) AS braces FROM l),
 f(id, i, line, inside, depth, brace) AS (SELECT id, i, line, false, CASE WHEN opens THEN 1 ELSE 0 END, 0 FROM n WHERE i = 1
   UNION ALL SELECT n.id, n.i, n.line, f.depth > 0 AND f.brace = 0, CASE WHEN f.depth <= 0 THEN CASE WHEN n.opens THEN 1 ELSE 0 END ELSE greatest(0, f.depth + n.up) END,
   CASE WHEN f.depth <= 0 THEN 0 ELSE greatest(0, f.brace + n.braces) END FROM f JOIN n ON n.id = f.id AND n.i = f.i + 1),
 b AS (SELECT id, line, inside FROM f)"""


@R.query("claims", f"WITH RECURSIVE s AS (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL), {_LINES} SELECT id AS doc_id, symbol FROM ({_CLAIMS})")
def claims(spark, d):
    """Code symbols that prose speaks of: in backticks, declared, as methods, and as members of declaration blocks."""
    return claimed_symbols(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "symbol")


@R.query("source_claims", f"WITH RECURSIVE s AS (SELECT source_id AS id, content AS t FROM source_files WHERE content IS NOT NULL), {_LINES} SELECT id AS source_id, symbol FROM ({_CLAIMS})")
def source_claims(spark, d):
    """The same over source texts, which hold declarations, methods and blocks."""
    return claimed_symbols(table(spark, d, "source_files").select("source_id", "content"), "source_id", "content").select("source_id", "symbol")


@R.query("stale_claims", f"""WITH RECURSIVE s AS (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL), {_LINES} SELECT id AS doc_id, symbol FROM ({_CLAIMS})
  WHERE symbol NOT IN (SELECT name FROM symbols WHERE name IS NOT NULL UNION SELECT split_part(name, '.', -1) FROM symbols WHERE name IS NOT NULL)""")
def stale_claims(spark, d):
    """Claimed symbols that no file defines under their full or last name."""
    from codestrata.operators.structure import expanded

    known = expanded(table(spark, d, "symbols")).withColumnRenamed("name", "symbol")
    return claims(spark, d).join(known, "symbol", "left_anti").select("doc_id", "symbol")


_PATTERNS = [("src/**", False), ("cmd/**/*.go", False), ("src/*/*.py", True)]


@R.query("scope_last_match", f"""SELECT file_id, path, CASE WHEN regexp_matches(path, '^src/[^/]+/[^/]*\\.py$') THEN false WHEN regexp_matches(path, '^cmd/([^/]+/)*[^/]*\\.go$') THEN true
  WHEN regexp_matches(path, '^src/.+$') THEN true ELSE false END AS in_scope FROM (SELECT file_id, {path_form_sql('path')} AS path FROM files)""")
def scope_last_match(spark, d):
    rows = table(spark, d, "files").select("file_id", path_form(F.col("path")).alias("path"))
    return rows.withColumn("in_scope", globs.in_scope(F.col("path"), _PATTERNS))


@R.query("out_of_scope", f"""SELECT snapshot_id, count(*) AS files FROM (SELECT snapshot_id, {path_form_sql('path')} AS path FROM files)
  WHERE NOT CASE WHEN regexp_matches(path, '^src/[^/]+/[^/]*\\.py$') THEN false WHEN regexp_matches(path, '^cmd/([^/]+/)*[^/]*\\.go$') THEN true WHEN regexp_matches(path, '^src/.+$') THEN true ELSE false END GROUP BY snapshot_id""")
def out_of_scope(spark, d):
    rows = table(spark, d, "files").select("snapshot_id", path_form(F.col("path")).alias("path"))
    return rows.filter(~globs.in_scope(F.col("path"), _PATTERNS)).groupBy("snapshot_id").agg(F.count("*").alias("files"))


@R.query("lookup_glob", f"SELECT file_id FROM (SELECT file_id, {path_form_sql('path')} AS path FROM files) WHERE regexp_matches(path, '^internal/[^/]*/[^/]*\\.rs$') OR path = 'pkg' OR starts_with(path, 'pkg/')")
def lookup_glob(spark, d):
    p = path_form(F.col("path"))
    return table(spark, d, "files").filter(p.rlike(globs.lookup_regex("internal/*/*.rs")) | p.rlike(globs.lookup_regex("pkg/**"))).select("file_id")


@R.query("test_files", f"""SELECT file_id, path FROM (SELECT file_id, {path_form_sql('path')} AS path FROM files)
  WHERE regexp_matches(path, '_test\\.(go|py)$') OR regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR regexp_matches(path, '\\.(test|spec)\\.[^/]*$') OR regexp_matches(path, '(^|/)tests/')""")
def test_files(spark, d):
    rows = table(spark, d, "files").select("file_id", path_form(F.col("path")).alias("path"))
    return rows.filter(text.is_test_file(F.col("path")))


@R.query("test_sources", """SELECT source_id, path FROM source_files WHERE regexp_matches(path, '_test\\.(go|py)$') OR regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR regexp_matches(path, '\\.(test|spec)\\.[^/]*$') OR regexp_matches(path, '(^|/)tests/')""")
def test_sources(spark, d):
    return table(spark, d, "source_files").select("source_id", "path").filter(text.is_test_file(F.col("path")))


@R.query("suggest_top3", """WITH k AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL), p AS (SELECT DISTINCT left(name, length(name) - 1) AS probe FROM symbols),
  q AS (SELECT probe FROM p WHERE probe IS NOT NULL AND probe NOT IN (SELECT name FROM k)),
  n AS (SELECT probe, name, levenshtein(probe, name) AS distance FROM q JOIN k ON abs(strlen(probe) - strlen(name)) <= 2 WHERE levenshtein(probe, name) <= 2 AND 2 * levenshtein(probe, name) <= strlen(probe))
  SELECT probe, name, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, name) AS rank FROM n) WHERE rank <= 3""")
def suggest_top3(spark, d):
    """Every symbol with its last letter lost, against all symbols."""
    symbols = table(spark, d, "symbols")
    return suggestions(symbols.select(F.left("name", F.length("name") - 1).alias("probe")), symbols)


@R.query("part_suggestions", """WITH k AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT DISTINCT 'x' || p_name AS probe FROM part),
  n AS (SELECT probe, name, levenshtein(probe, name) AS distance FROM q JOIN k ON abs(strlen(probe) - strlen(name)) <= 2 WHERE probe NOT IN (SELECT name FROM k) AND levenshtein(probe, name) <= 2 AND 2 * levenshtein(probe, name) <= strlen(probe))
  SELECT probe, name, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY distance, name) AS rank FROM n) WHERE rank <= 3""")
def part_suggestions(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return suggestions(names.select(F.concat(F.lit("x"), "name").alias("probe")).distinct(), names)


@R.query("numbered_lines", "SELECT source_id, i AS line_no, md5(left(string_split(content, chr(10))[i], 65536)) AS digest FROM (SELECT source_id, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM source_files WHERE content IS NOT NULL)")
def numbered_lines(spark, d):
    rows = table(spark, d, "source_files").filter("content is not null").select("source_id", F.posexplode(F.split("content", "\n", -1)).alias("k", "line"))
    return rows.select("source_id", (F.col("k") + 1).cast("bigint").alias("line_no"), F.md5(F.left("line", F.lit(65536))).alias("digest"))


@R.query("display_paths", r"""SELECT file_id, regexp_replace(left(path, 200), '[\x00-\x1F\x7F-\x{9F}\x{2028}\x{2029}]', '?', 'g') || CASE WHEN length(path) > 200 THEN chr(8230) || '(truncated)' ELSE '' END AS shown FROM files""")
def display_paths(spark, d):
    return table(spark, d, "files").select("file_id", text.safe_for_display(F.col("path")).alias("shown"))


@R.query("display_texts", r"""SELECT doc_id, regexp_replace(left(text, 200), '[\x00-\x1F\x7F-\x{9F}\x{2028}\x{2029}]', '?', 'g') || CASE WHEN length(text) > 200 THEN chr(8230) || '(truncated)' ELSE '' END AS shown FROM documents WHERE text IS NOT NULL""")
def display_texts(spark, d):
    """As ``display_paths`` over texts, which hold line ends, separators and long lines."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", text.safe_for_display(F.col("text")).alias("shown"))


QUERIES, SQL = R.queries, R.sql
