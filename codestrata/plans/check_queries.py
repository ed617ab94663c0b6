"""Queries of extraction and edit checks. Their inputs are texts, so SQL can express the joins only; tests cover the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions.paths import path_form
from codestrata.operators import checks, extract
from codestrata.plans.registry import Registry
from codestrata.session import materialise, table

R = Registry()
#: All exports of Go's package log; a module whose list has gaps must not be called resolved.
LOG_EXPORTS = (
    "Default", "Fatal", "Fatalf", "Fatalln", "Flags", "LUTC", "Ldate", "Llongfile", "Lmicroseconds", "Lmsgprefix", "Logger",
    "Lshortfile", "LstdFlags", "Ltime", "New", "Output", "Panic", "Panicf", "Panicln", "Prefix", "Print", "Printf", "Println",
    "SetFlags", "SetOutput", "SetPrefix", "Writer",
)


def _facts(spark, d):
    return extract.extract_facts(table(spark, d, "source_files"))


def _known(spark, d):
    """(repo_id, name) from the older index; incomplete, as indexes are."""
    files = table(spark, d, "source_files").select("source_id", "repo_id")
    return table(spark, d, "symbols").join(files, "source_id").select("repo_id", "name")


@R.query("mask_literals")
def mask_literals(spark, d):
    return extract.masked_files(table(spark, d, "source_files"))


@R.query("extract_facts")
def extract_facts(spark, d):
    return _facts(spark, d)


@R.query("fact_counts")
def fact_counts(spark, d):
    return _facts(spark, d).groupBy("lang", "fact").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@R.query("additive_check")
def additive_check(spark, d):
    return checks.additive(materialise(_facts(spark, d), "facts"), _known(spark, d))


@R.query("file_scope_check")
def file_scope_check(spark, d):
    return checks.file_scope(materialise(_facts(spark, d), "facts"), _known(spark, d))


@R.query("qualified_check")
def qualified_check(spark, d):
    """Go's package log as the one resolved module; all others are unknown and decide nothing."""
    exports = spark.createDataFrame([("log", "resolved", n) for n in LOG_EXPORTS], "module string, status string, name string")
    return checks.qualified(materialise(_facts(spark, d), "facts"), exports)


@R.query("receiver_method_check")
def receiver_method_check(spark, d):
    return checks.member_calls(materialise(_facts(spark, d), "facts"), _known(spark, d), "receiver")


@R.query("var_type_check")
def var_type_check(spark, d):
    return checks.member_calls(materialise(_facts(spark, d), "facts"), _known(spark, d), "var_type")


@R.query("call_shape_check")
def call_shape_check(spark, d):
    return checks.call_shapes(materialise(_facts(spark, d), "facts"))


@R.query("duplicate_definitions_check")
def duplicate_definitions_check(spark, d):
    return checks.duplicate_definitions(_facts(spark, d), table(spark, d, "source_files"))


@R.query("package_exports")
def package_exports(spark, d):
    """Exports of every directory with Go files; unreadable ones are unknown."""
    rows = table(spark, d, "source_files").filter("path like '%.go' and content is not null").withColumn("path", path_form(F.col("path"))).filter("path not like '%\\_test.go'")
    package = F.concat_ws(":", "repo_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    return extract.package_exports(rows.select(package.alias("package"), "content"))


@R.query("write_decisions")
def write_decisions(spark, d):
    """The composed answer of all checks for every file."""
    facts, known = materialise(_facts(spark, d), "facts"), _known(spark, d)
    exports = spark.createDataFrame([("log", "resolved", n) for n in LOG_EXPORTS], "module string, status string, name string")
    found = {
        "violations": checks.additive(facts, known), "filescope": checks.file_scope(facts, known), "qualified": checks.qualified(facts, exports),
        "recv-method": checks.member_calls(facts, known, "receiver"), "var-type": checks.member_calls(facts, known, "var_type"),
        "call-shape": checks.call_shapes(facts), "duplicate": checks.duplicate_definitions(facts, table(spark, d, "source_files")),
    }
    return checks.decisions(table(spark, d, "source_files"), found)


QUERIES, SQL = R.queries, R.sql
