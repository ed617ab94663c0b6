from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text
from codestrata.operators import checks, extract, log_stats, reports, structure
from codestrata.operators.claims import claimed


def facts(lang, source):
    return {(f, n, d) for f, n, _, d in extract.file_facts(lang, source) if f in ("export", "member", "import", "doc")}


def test_exports_members_docs_and_imports():
    go = "package p\n\n// Reads one.\n// more\nfunc Read() {}\nvar A, b = 1, 2\nconst (\n\tC = iota\n\td, E\n)\ntype T struct {\n\tX, Y int\n\tin struct { Z int }\n}\ntype I interface {\n\tDo(a int) error\n}\nfunc (t T) M() { var Q = 1 }\n"
    got = facts("go", go)
    assert {n for f, n, _ in got if f == "export"} == {"Read", "A", "C", "E", "T", "I"}
    assert {(n, d) for f, n, d in got if f == "member"} == {("T.X", "field"), ("T.Y", "field"), ("T.in", "field"), ("I.Do", "method")}
    assert ("doc", "Read", "Reads one.") in got
    assert extract.go_exports("package p\nfunc f() {\n") is None and extract.go_exports("func F() {}") is None
    js = "export * from './a';\nexport * as ns from 'b';\nexport { x, y as z };\nexport default function f() {}\nexport const k = 1;\ninterface P { a: string; b(): void }\n// export const no = 1\n"
    found = facts("js", js)
    assert {(n, d) for f, n, d in found if f == "export"} == {("*", "wildcard"), ("ns", "wildcard"), ("x", "list"), ("z", "list"), ("f", "declaration"), ("k", "declaration")}
    assert {(n, d) for f, n, d in found if f == "member"} == {("P.a", "field"), ("P.b", "method")}
    py = "__all__ = ['a', \"b\"]\nx = \"__all__ = ['no']\"\ndef a():\n    \"\"\"Says it.\n\n    More.\"\"\"\n"
    assert {n for f, n, _ in facts("python", py) if f == "export"} == {"a", "b"}
    assert ("doc", "a", "Says it.") in facts("python", py)
    assert ("import", "lib.sh", "./lib.sh") in facts("shell", "# source no.sh\nsource ./lib.sh\n")
    assert ("import", "json", "json") in facts("ruby", "require 'json'\n") and ("import", "Map", "a::b::Map") in facts("rust", "use a::b::Map;\n")
    assert list(extract.file_facts("go", "package p\nvar x = " + "(" * 2000)) == []
    raised = [n for f, n, _, _ in extract.file_facts("python", "raise ValueError('x')\n") if f == "ref"]
    made = [n for f, n, _, _ in extract.file_facts("js", "new Uint8Array(4)\n") if f == "ref"]
    assert raised == made == []


def test_long_files_are_read_in_linear_time():
    source = "package p\n" + "".join(f"func f{k}() {{ g{k}() }}\n" for k in range(20_000))
    assert sum(f == "def" for f, *_ in extract.file_facts("go", source)) == 20_000


def test_package_exports(spark):
    df = spark.createDataFrame([("a", "package a\nfunc F() {}\n"), ("a", "package a\nvar V = 1\n"), ("b", "package b\nfunc G() {}\n"), ("b", "package b\nfunc {"), ("c", "package c\n"), ("d", None)], "package string, content string")
    got = sorted((r.package, r.status, r["name"]) for r in extract.package_exports(df).collect())
    assert got == [("a", "resolved", "F"), ("a", "resolved", "V"), ("b", "unknown", None)]


def test_claims_of_blocks_methods_and_lists():
    source = "`Foo.barBaz` and func (r *Reader[T]) Fetch() then\nvar MaxSize, MinSize int\nconst (\n\tDefaultPort = f(\n\tInner\n\t)\n\tOther int\n)\nAfterAll int\ntype (\n\tBox struct {\n\t\tField int\n\t}\n)\nclass MyThing def snake_case `AB` `abc`"
    assert set(claimed(source)) == {"Foo.barBaz", "Reader.Fetch", "MaxSize", "MinSize", "DefaultPort", "Inner", "Other", "Box", "MyThing"}


def test_redaction_display_and_names(spark):
    df = spark.createDataFrame([("password=abc /usr/share/lib/aaaa/bbbb/cccc/dddd Authorization: x " + "k" * 40,)], "t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == "password=[REDACTED] /usr/share/lib/aaaa/bbbb/cccc/dddd Authorization: [REDACTED] [REDACTED]"
    p = spark.createDataFrame([("a b\u0085",), ("x" * 201,), (None,), ("",)], "p string")
    assert [r[0] for r in p.select(text.safe_for_display(F.col("p"))).collect()] == ["a?b?", "x" * 200 + "…(truncated)", None, ""]
    n = spark.createDataFrame([("/a/b/main",), ("/main",), ("/x/x",), (None,)], "p string")
    assert [r[0] for r in n.select(text.derived_name(F.col("p"))).collect()] == ["b-main", "main", "x", None]
    v = spark.createDataFrame([("v1.1000.0",), ("2.0.0",), ("dev",), (None,)], "v string").select(text.version_parts(F.col("v")).alias("p"))
    assert v.agg(F.max("p")).first()[0].major == 2 and v.filter("p is null").count() == 2
    e = spark.createDataFrame([(None, "a"), ("Edit", "a")], "tool string, old string")
    none, no = F.lit(None).cast("array<struct<old:string,new:string>>"), F.lit(None).cast("string")
    assert [r[0] == "" for r in e.select(text.edit_fingerprint(F.col("tool"), F.col("old"), no, no, none)).collect()] == [True, False]


def record(i, t, decision, file="f", edit=None, symbols=("a",), reason="approved"):
    return (i, 1_000_000 + t, "", decision, "hook", file, edit, list(symbols), reason, None, None, None)


LOG = "delivery_id long, ts_sec long, ts_frac string, decision string, mode string, file string, edit string, symbols array<string>, reason string, repo string, lang string, gv string"


def test_recent_asks(spark):
    rows = [
        record(1, 0, "ask"), record(2, 100, "outcome"), record(3, 200, "outcome"),  # answered once
        record(4, 1000, "ask", edit="e"), record(5, 60_000, "outcome", edit="e"), record(6, 60_001, "outcome", edit="e"),  # by edit, within a day
        record(7, 100_000, "ask"), record(8, 100_300, "outcome"),  # five minutes are too long
        record(9, 3_599, "ask", file="g"), record(10, 3_610, "outcome", file="g"), record(11, 0, "outcome", file=None),
    ]
    got = {(r.delivery_id, r.ask_id, r.track) for r in log_stats.recent_asks(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {(2, 1, "window"), (5, 4, "edit"), (10, 9, "window")}


def test_approvals_across_cuts(spark):
    rows = [record(k, 10_000 * k, "ask", edit=f"e{k % 3}" if k % 2 else "", symbols=[f"s{k}"]) for k in range(12)]
    rows += [record(100 + k, 10_000 * k + 200, "outcome", edit=f"e{k % 3}" if k % 2 else None, symbols=[f"s{k}"]) for k in range(12)]
    got = {(r.ask_id, r.outcome_id) for r in log_stats.approvals(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {(k, 100 + k) for k in range(12)}
    assert log_stats.approvals(spark.createDataFrame([], LOG)).count() == 0


def test_repositories(spark):
    repos = spark.createDataFrame([(1, "/w/a", "/g"), (2, "/w/b", "/g"), (3, "/w/c", None), (4, "/w/d", "/h")], "repo_id long, path string, common_dir string")
    rows = [("x", "/w/b/", "/g", ["x"]), ("y", "/w/z", "/g", ["y"]), ("c", "/w/c", "/n", []), ("t", None, None, ["/q", "/w/c", "/w/d"]), ("n", "/n", "/n", ["/n"]), ("h", "/n", "/h", [])]
    dirs = spark.createDataFrame(rows, "dir string, top string, common_dir string, worktrees array<string>")
    assert {r.dir: r.repo_id for r in structure.resolve_repos(dirs, repos).collect()} == {"x": 2, "y": 1, "c": 3, "t": 3, "n": None, "h": 4}
    files = spark.createDataFrame([(1, "/w/a/x.go"), (2, "/w/ab/x.go"), (3, "/w/a")], "file_id long, path string")
    assert {(r.file_id, r.repo_id) for r in structure.containing(files, repos.withColumnRenamed("path", "root")).collect()} == {(1, 1), (3, 1)}
    snaps = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "snapshot_id long, repo_id long")
    structure.one_repository(snaps, 1, 2)
    try:
        structure.one_repository(snaps, 1, 3)
        raise AssertionError("accepted")
    except ValueError:
        pass


def test_live_changes_upserts_and_decisions(spark):
    s = "path string, kind string, name string, sig_hash string"
    old = spark.createDataFrame([("p", "function", "a", "1"), ("p", "field", "T.x", "2"), ("p", "class", "C", "")], s)
    new = spark.createDataFrame([("p", "function", "a", "9"), ("p", "field", "T.x", "2"), ("p", "class", "C", "5"), ("p", "export", "e", "")], s)
    assert {(r["name"], r.status) for r in structure.live_symbol_changes(old, new).collect()} == {("a", "modified"), ("T.x", "removed"), ("e", "added")}
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, h string")
    changes = spark.createDataFrame([("a", None), ("b", "3"), ("c", "4"), ("d", None)], "path string, h string")
    assert {tuple(r) for r in structure.upserted(rows, changes, ["path"]).collect()} == {("b", "3"), ("c", "4")}
    found = lambda *r: spark.createDataFrame(list(r), "source_id long, name string")
    files = spark.createDataFrame([(1,), (2,)], "source_id long")
    got = {r.source_id: (r.decision, r.reason, r.symbols) for r in checks.decisions(files, {"duplicate": found((1, "b"), (1, "a")), "violations": found((1, "a"))}).collect()}
    assert got == {1: ("ask", "violations+duplicate", ["a", "b"]), 2: ("defer", "", [])}
    df = spark.createDataFrame([(["b", "a", "b"], ["a"]), (None, None), (["x"], None)], "s array<string>, r array<string>")
    assert [r[0] for r in df.select(reports.without_reported(F.col("s"), F.col("r"))).collect()] == [["b"], None, ["x"]]
