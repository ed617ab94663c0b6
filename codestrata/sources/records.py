"""Readers and writers: source trees, decision logs, structure files, edit payloads, diffs, scope and ignore files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.instants import instant_seconds
from codestrata.operators.structure import visible

#: Largest source file, structure file and diff line in bytes.
MAX_SOURCE, MAX_STRUCTURE, MAX_LINE = 10 << 20, 100 << 20, 64 << 10

DECISION = (
    "v int, gv string, ts string, mode string, repo string, file string, lang string, decision string, reason string, "
    "symbols array<string>, learn_symbols array<string>, contract string, contract_hash string, edit string, `join` string, "
    "checks map<string,string>, check_reasons map<string,string>"
)
SYMBOL = "struct<name:string,kind:string,line:int,hash:string,doc:string>"
STRUCTURE = (
    f"version int, root_hash string, files map<string,struct<hash:string,symbols:array<{SYMBOL}>,refs:array<string>,"
    "functions:array<string>,classes:array<string>,exports:array<string>,imports:array<string>,"
    "symbol_hashes:map<string,string>,symbol_lines:map<string,int>>>"
)
PAYLOAD = (
    "session_id string, tool_name string, tool_input struct<file_path:string,old_string:string,new_string:string,content:string,"
    "edits:array<struct<old_string:string,new_string:string>>>"
)


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, content_hash) of the visible, supported files under a root.

    Size and path are filtered before the content column is read; ignored
    directories are left out by name. Larger files than the limit are no source.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{go,py,js,mjs,cjs,ts,jsx,tsx,sh,bash,rs,rb}").load(root)
    base = F.lit(root.rstrip("/") + "/")
    local = F.regexp_replace("path", "^file:/+", "/")
    inside = F.substring(local, F.length(base) + 1, F.length(local))
    rows = files.filter(F.col("length") <= MAX_SOURCE).withColumn("path", inside).filter(visible(F.col("path")))
    return rows.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


def decision_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; lines that are no record, or whose ts is not RFC 3339, are skipped."""
    lines = spark.read.text(path)
    return parse_decisions(lines, F.col("value"))


def parse_decisions(lines: DataFrame, body: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    rows = lines.select(*keep, F.from_json(body, DECISION).alias("r")).select(*keep, "r.*")
    return rows.filter(instant_seconds(F.col("ts")).isNotNull())


def write_decision_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def structure_facts(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(path, content_hash, kind, name, line, hash) from structure files, newer shape or older parallel arrays.

    A file is one JSON object, or, with ``whole_files=False``, an object a line.

    The older shape has names by kind and maps keyed ``kind:name``.
    """
    docs = spark.read.schema(STRUCTURE).option("multiLine", whole_files).json(path)
    files = docs.select(F.explode("files").alias("path", "f"))
    def listed(plural: str, kind: str) -> Column:
        key = lambda n: F.concat(F.lit(kind + ":"), n)
        return F.transform(
            F.coalesce(F.col(f"f.{plural}"), F.array().cast("array<string>")),
            lambda n: F.struct(
                n.alias("name"), F.lit(kind).alias("kind"), F.coalesce(F.try_element_at("f.symbol_lines", key(n)), F.lit(0)).alias("line"),
                F.coalesce(F.try_element_at("f.symbol_hashes", key(n)), F.lit("")).alias("hash"), F.lit(None).cast("string").alias("doc"),
            ),
        )

    kinds = (("functions", "function"), ("classes", "class"), ("exports", "export"), ("imports", "import"))
    old = F.flatten(F.array(*[listed(plural, kind) for plural, kind in kinds]))
    symbols = F.when(F.size("f.symbols") > 0, F.col("f.symbols")).otherwise(old)
    return files.select("path", F.col("f.hash").alias("content_hash"), F.explode(symbols).alias("s")).select(
        "path", "content_hash", "s.kind", "s.name", F.coalesce("s.line", F.lit(0)).alias("line"), F.coalesce("s.hash", F.lit("")).alias("hash")
    )


def write_structure(symbols: DataFrame, path: str) -> None:
    """One JSON object a file, symbols sorted by kind and name: the same facts give the same bytes."""
    one = symbols.groupBy("path", "content_hash").agg(F.array_sort(F.collect_list(F.struct("kind", "name", "line", "hash"))).alias("symbols"))
    one.orderBy("path").write.mode("overwrite").json(path)


def edit_payloads(lines: DataFrame, body: Column) -> DataFrame:
    """(session_id, tool, file, block, old, new) of edit requests, one row an edit block; unreadable payloads give none."""
    p = lines.select(F.from_json(body, PAYLOAD).alias("p")).select("p.*").filter("tool_input.file_path is not null")
    i = F.col("tool_input")
    single = F.array(F.struct(i["old_string"].alias("old_string"), F.coalesce(i["content"], i["new_string"]).alias("new_string")))
    blocks = F.when(F.size(i["edits"]) > 0, i["edits"]).otherwise(single)
    return p.select("session_id", F.col("tool_name").alias("tool"), i["file_path"].alias("file"), F.posexplode(blocks).alias("block", "e")).select(
        "session_id", "tool", "file", "block", F.col("e.old_string").alias("old"), F.col("e.new_string").alias("new")
    )


def _unquote(path: str) -> str | None:
    """A path of a diff header; C-quoted paths are decoded; /dev/null is none."""
    path = path.rstrip("\r")
    if path.startswith('"') and path.endswith('"') and len(path) > 1:
        raw = path[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace")
        path = raw.decode("utf-8", "replace")
    else:
        path = path.split("\t")[0]
    if path == "/dev/null":
        return None
    return path[2:] if path.startswith("b/") else path


def added_lines(text: str | None) -> Iterator[tuple[str, int, str]]:
    """(path, line number, line) of the lines a unified diff adds; what looks like a header inside a hunk is content."""
    path, line, old_left, new_left = None, 0, 0, 0
    for row in (text or "").split("\n"):
        if old_left > 0 or new_left > 0:
            if row.startswith("+"):
                if path is not None:
                    yield path, line, row[1:]
                line += 1
                new_left -= 1
            elif row.startswith("-"):
                old_left -= 1
            elif not row.startswith("\\"):
                line += 1
                old_left -= 1
                new_left -= 1
        elif row.startswith("+++ "):
            path = _unquote(row[4:])
        elif row.startswith("@@ "):
            numbers = row.split("@@")[1].split()
            sizes = []
            for part in numbers[:2]:
                start, _, count = part[1:].partition(",")
                sizes.append((int(start) if start.isdigit() else 1, int(count) if count.isdigit() else 1))
            if len(sizes) == 2:
                (_, old_left), (line, new_left) = sizes


def diff_added_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, line_no, text, partial) of one diff a row; lines over the limit are left out and mark the diff partial."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t in zip(part[key], part[text], strict=True):
                found = list(added_lines(t))
                partial = any(len(x) > MAX_LINE for _, _, x in found)
                rows += [(k, p, n, x, partial) for p, n, x in found if len(x) <= MAX_LINE]
            yield pd.DataFrame(rows, columns=[key, "path", "line_no", "text", "partial"])

    return diffs.select(key, text).mapInPandas(run, f"{key} {diffs.schema[key].dataType.simpleString()}, path string, line_no int, text string, partial boolean")


def ignore_lists(lines: DataFrame, body: Column) -> DataFrame:
    """(entry, is_glob) of ignore-file lines; comments and blanks are dropped."""
    entry = F.trim(body)
    return lines.select(entry.alias("entry")).filter("entry <> '' and not startswith(entry, '#')").withColumn("is_glob", F.col("entry").rlike(r"[*?\[]"))


def learned_allow_json(lines: DataFrame, body: Column) -> DataFrame:
    """(repo, symbol, count, last_seen) of learned-allow files; a corrupt file is an empty one."""
    schema = "map<string,map<string,struct<count:int,last_seen:string>>>"
    repos = lines.select(F.from_json(body, schema).alias("m")).select(F.explode("m").alias("repo", "s"))
    return repos.select("repo", F.explode("s").alias("symbol", "x")).select("repo", "symbol", "x.count", "x.last_seen")


def module_requires(gomods: DataFrame, key: str, text: str) -> DataFrame:
    """(key, module, version, replaced) of go.mod texts, single and grouped directives."""
    lines = gomods.select(key, F.posexplode(F.split(F.regexp_replace(text, r"//[^\n]*", ""), "\n")).alias("n", "line"))
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    word = F.regexp_extract("line", r"^\s*(require|replace|exclude|retract)\b", 1)
    opens = F.when(F.col("line").rlike(r"^\s*(require|replace|exclude|retract)\s*\("), word).when(F.col("line").rlike(r"^\s*\)"), F.lit(""))
    inside = F.coalesce(F.last(opens, ignorenulls=True).over(order), F.lit(""))
    kind = F.when(inside != "", inside).otherwise(word)
    bare = F.regexp_replace(F.regexp_replace("line", r"^\s*(require|replace)\b", ""), r"^\s+|\s+$", "")
    rows = lines.withColumn("kind", kind).withColumn("bare", bare).filter("bare not in ('', ')') and not startswith(bare, '(')")
    required = rows.filter("kind = 'require'").select(key, F.regexp_extract("bare", r"^(\S+)\s+(\S+)", 1).alias("module"), F.regexp_extract("bare", r"^(\S+)\s+(\S+)", 2).alias("version"))
    replaced = rows.filter("kind = 'replace'").select(key, F.regexp_extract("bare", r"^(\S+)", 1).alias("module"), F.lit(True).alias("replaced")).distinct()
    return required.join(replaced, [key, "module"], "left").fillna(False, ["replaced"])


def longest_module(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(import_path, module, version): the module whose path is the longest prefix of an import.

    Every prefix of an import joins by equality, so there is no range or cross join.
    """
    parts = F.split("import_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = imports.select("import_path").distinct().select("import_path", F.explode(prefixes).alias("module")).join(modules.select("module", "version"), "module")
    best = rows.groupBy("import_path").agg(F.max(F.struct(F.length("module").alias("n"), "module", "version")).alias("b"))
    return best.select("import_path", "b.module", "b.version")
