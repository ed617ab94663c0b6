"""Edit checks as joins over extracted facts.

Every check gives (source_id, name, line) of what it reports; a check that cannot
know abstains by giving nothing. ``facts`` is the result of ``extract_facts``;
``known`` is (repo_id, name) of a repository's symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.filter(F.col("fact").isin(*kinds))


def additive(facts: DataFrame, known: DataFrame, ignore: DataFrame | None = None) -> DataFrame:
    """References that nothing resolves: not the repository, nor the file's definitions, imports or bindings, nor the ignore list."""
    refs = _of(facts, "ref").groupBy("source_id", "repo_id", "name").agg(F.min("line").alias("line"))
    local = _of(facts, "def", "import", "binding").select("source_id", "name").distinct()
    left = refs.join(known.distinct(), ["repo_id", "name"], "left_anti").join(local, ["source_id", "name"], "left_anti")
    if ignore is not None:
        left = left.join(ignore.select("name").distinct(), "name", "left_anti")
    return left.select("source_id", "name", "line")


def file_scope(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Python references to a name the repository has but this file neither defines, imports nor binds; star imports abstain."""
    refs = _of(facts, "ref").filter("lang = 'python'").groupBy("source_id", "repo_id", "name").agg(F.min("line").alias("line"))
    star = _of(facts, "import").filter("name = '*'").select("source_id").distinct()
    local = _of(facts, "def", "import", "binding").select("source_id", "name").distinct()
    held = refs.join(known.distinct(), ["repo_id", "name"], "left_semi").join(star, "source_id", "left_anti")
    return held.join(local, ["source_id", "name"], "left_anti").select("source_id", "name", "line")


def qualified(facts: DataFrame, exports: DataFrame) -> DataFrame:
    """Go selectors ``pkg.Name`` of an imported package whose exports are fully known and lack the name.

    ``exports`` is (module, status, name); only modules with status ``resolved`` decide.
    """
    calls = _of(facts, "qualified").filter("lang = 'go'").select("source_id", F.col("detail").alias("alias"), "name", "line")
    aliases = _of(facts, "import").select("source_id", F.col("name").alias("alias"), F.col("detail").alias("module"))
    resolved = exports.filter("status = 'resolved'").select("module").distinct()
    asked = calls.filter(F.col("name").rlike("^[A-Z]")).join(aliases, ["source_id", "alias"]).join(resolved, "module", "left_semi")
    return asked.join(exports.select("module", "name").distinct(), ["module", "name"], "left_anti").groupBy("source_id", "name").agg(F.min("line").alias("line"))


def member_calls(facts: DataFrame, known: DataFrame, source: str) -> DataFrame:
    """Go ``x.Name`` where x has a known type with known members, none of them (nor of any type) called Name.

    ``source`` is ``receiver`` or ``var_type``: where the type of x comes from.
    """
    kinds = _of(facts, source).select("source_id", F.col("name").alias("x"), F.col("detail").alias("type")).distinct()
    # a variable with two types in a file decides nothing
    one = kinds.groupBy("source_id", "x").agg(F.min("type").alias("type"), F.count("*").alias("n")).filter("n = 1").drop("n")
    calls = _of(facts, "qualified").filter("lang = 'go'").select("source_id", "repo_id", F.col("detail").alias("x"), "name", "line")
    members = known.filter("instr(name, '.') > 0").select("repo_id", F.substring_index("name", ".", 1).alias("type"), F.substring_index("name", ".", -1).alias("name")).distinct()
    bare = known.select("repo_id", "name").distinct()
    asked = calls.join(one, ["source_id", "x"]).join(members.select("repo_id", "type").distinct(), ["repo_id", "type"], "left_semi")
    return (
        asked.join(members.select("repo_id", "name").distinct(), ["repo_id", "name"], "left_anti").join(bare, ["repo_id", "name"], "left_anti")
        .groupBy("source_id", "name").agg(F.min("line").alias("line"))
    )


def call_shapes(facts: DataFrame) -> DataFrame:
    """(source_id, name, line, keyword): Python keyword arguments that the file's only declaration does not take."""
    calls = _of(facts, "call").filter("detail <> '' and not startswith(detail, '*')")
    used = calls.select("source_id", "name", "line", F.explode(F.split("detail", ",")).alias("keyword"))
    only = _of(facts, "signature").groupBy("source_id", "name").agg(F.count("*").alias("n"), F.min("detail").alias("takes")).filter("n = 1 and not startswith(takes, '**')")
    rebound = _of(facts, "binding", "import").select("source_id", "name").distinct()
    asked = used.join(only, ["source_id", "name"]).join(rebound, ["source_id", "name"], "left_anti")
    return asked.filter(~F.array_contains(F.split("takes", ","), F.col("keyword"))).select("source_id", "name", "line", "keyword")


def dropped_imports(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, name, line): imports of the old text that the new one lacks and still uses unqualified."""
    gone = _of(old, "import").select("source_id", "name").distinct().join(_of(new, "import", "def", "binding").select("source_id", "name").distinct(), ["source_id", "name"], "left_anti")
    uses = _of(new, "ref").select("source_id", "name", "line").unionByName(_of(new, "qualified").select("source_id", F.col("detail").alias("name"), "line"))
    return uses.join(gone, ["source_id", "name"], "left_semi").groupBy("source_id", "name").agg(F.min("line").alias("line"))


#: Last parts of Go file names that constrain the build.
GO_PLATFORMS = (
    "aix android darwin dragonfly freebsd hurd illumos ios js linux nacl netbsd openbsd plan9 solaris wasip1 windows zos "
    "386 amd64 amd64p32 arm arm64 arm64be armbe loong64 mips mips64 mips64le mips64p32 mips64p32le mipsle ppc ppc64 ppc64le "
    "riscv riscv64 s390 s390x sparc sparc64 wasm"
).split()


def build_constrained(path: Column, content: Column) -> Column:
    """Whether a Go file is built on some platforms only: by its name, or by a line before its package clause."""
    by_name = F.regexp_extract(path, r"[^/]_([^_/]+)\.go$", 1).isin(GO_PLATFORMS)
    header = F.split(content, r"(?m)^[ \t]*package ", 2)[0]
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(header.rlike(r"(?m)^[ \t]*(?://go:build|// \+build)"), F.lit(False))


def duplicate_definitions(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """(source_id, name): Go functions another file of the directory defines too; ``init``, methods and test files are exempt.

    Two files that are both constrained to some builds are no pair. ``paths`` has the files' path and content.
    """
    files = paths.select("source_id", "path", build_constrained(F.col("path"), F.col("content")).alias("tied"))
    rows = _of(facts, "def").filter("lang = 'go' and detail = '' and name <> 'init'").join(files, "source_id")
    rows = rows.filter(~F.col("path").endswith("_test.go")).select("repo_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), "name", "source_id", "tied").distinct()
    many = rows.groupBy("repo_id", "dir", "name").agg(F.count("*").alias("n"), F.count_if(~F.col("tied")).alias("free")).filter("n > 1 and free > 0").drop("n", "free")
    return rows.join(many, ["repo_id", "dir", "name"], "left_semi").select("source_id", "name")


#: Fixed order in which the checks that fired are named.
CHECK_ORDER = ("violations", "filescope", "qualified", "recv-method", "var-type", "call-shape", "duplicate")


def decisions(files: DataFrame, findings: dict[str, DataFrame]) -> DataFrame:
    """(source_id, decision, reason, symbols, found) of each file: the composed answer of all checks.

    ``findings`` has a check's (source_id, name) rows under its name. A file with any finding is
    asked about: the reason joins the checks in fixed order, the symbols are sorted and named once,
    whichever checks report them; ``found`` counts them. All other files are deferred.
    """
    rows = None
    for n, check in enumerate(c for c in CHECK_ORDER if c in findings):
        part = findings[check].select("source_id", "name", F.lit(n).alias("place"), F.lit(check).alias("check")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    by_symbol = rows.groupBy("source_id", "name").agg(F.collect_set(F.struct("place", "check")).alias("c"))
    sums = by_symbol.groupBy("source_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("c"), F.array_sort(F.collect_list("name")).alias("symbols"), F.count("*").alias("found")
    )
    reason = F.array_join(F.transform("c", lambda x: x["check"]), "+")
    joined = files.select("source_id").join(sums, "source_id", "left")
    return joined.select(
        "source_id", F.when(F.col("found") > 0, "ask").otherwise("defer").alias("decision"), F.coalesce(reason, F.lit("")).alias("reason"),
        F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), F.coalesce("found", F.lit(0)).alias("found"),
    )
