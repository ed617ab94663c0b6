from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codestrata.functions import globs, text
from codestrata.operators import checks, extract, history, log_stats, structure
from codestrata.operators.store import Store
from codestrata.operators.suggest import suggestions
from codestrata.sources import records as src


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scope_dialect():
    m = lambda g, p: __import__("re").search(globs.scope_regex(g), p) is not None
    assert m("a/**", "a/b/c") and not m("a/**", "a")
    assert m("a/**/b.go", "a/b.go") and m("a/**/b.go", "a/x/y/b.go")
    assert m("*.go", "x.go") and not m("*.go", "a/x.go")
    assert m("lib/", "lib/a/b") and not m("lib", "lib/a") and m("a[0-2]?", "a1z")
    headers, patterns = globs.parse_scope("name: x\n# c\n\nsrc/**\n!src/gen/**\n")
    assert headers == {"name": "x"} and patterns == [("src/**", False), ("src/gen/**", True)] and globs.has_positive(patterns)


def test_lookup_dialect():
    m = lambda g, p: __import__("re").search(globs.lookup_regex(g), p) is not None
    assert m("a/**", "a") and m("a/**", "a/b/c") and not m("**/*.go", "x/y.go") and m("**/*.go", "x/*.go")
    assert m("pkg", "pkg/a/b") and m("a/*.go", "a/b.go") and not m("a/*.go", "a/b/c.go")


def test_last_match_wins(spark):
    df = spark.createDataFrame([("src/a.go",), ("src/gen/b.go",), ("x",), (None,)], "path string")
    got = df.select("path", globs.in_scope(F.col("path"), [("src/**", False), ("src/gen/**", True)]).alias("s"))
    assert {r.path: r.s for r in got.collect()} == {"src/a.go": True, "src/gen/b.go": False, "x": False, None: False}


def test_text_functions(spark):
    df = spark.createDataFrame([("password=hunter2 and " + "x" * 40,), ("é" * 10,), ("short",), (None,)], "t string")
    got = [r[0] for r in df.select(text.redact(F.col("t"))).collect()]
    assert got == ["password=[REDACTED] and [REDACTED]", "é" * 10, "short", None]
    assert [r[0] for r in df.select(text.truncate_bytes(F.col("t"), 9)).collect()] == ["password=...", "éééé...", "short", None]
    d = spark.createDataFrame([("é", "e"), ("abc", "abd"), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in d.select(text.byte_levenshtein(F.col("a"), F.col("b"), 2)).collect()] == [2, 1, -1]


def test_suggestions_against_brute_force(spark):
    import random

    rng = random.Random(1)
    known = sorted({"".join(rng.choices("abcé", k=rng.randrange(1, 8))) for _ in range(150)})
    probes = sorted({"".join(rng.choices("abcé", k=rng.randrange(1, 9))) for _ in range(60)})

    def dist(a: bytes, b: bytes) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    expected = []
    for p in probes:
        if p in known:
            continue
        near = sorted((dist(p.encode(), k.encode()), k) for k in known)
        near = [(d, k) for d, k in near if d <= 2 and 2 * d <= len(p.encode())]
        expected += [(p, k, d, n) for n, (d, k) in enumerate(near[:3], 1)]
    got = suggestions(spark.createDataFrame([(p,) for p in probes], "probe string"), spark.createDataFrame([(k,) for k in known], "name string"))
    assert rows(got.select("probe", "name", "distance", "rank")) == sorted(expected, key=repr)


def test_structure(spark):
    s = spark.createDataFrame([(i, 1 if i < 6 else None, "s", "reindex", f"2026-01-0{1 + i // 2} 00:00:00", "r", "h") for i in range(8)], "snapshot_id long, repo_id long, session_id string, label string, timestamp string, root string, root_hash string")
    assert [r.snapshot_id for r in structure.latest_by(s, ["repo_id"]).collect()] == [5]
    assert sorted(r.snapshot_id for r in structure.prunable(s, 2).collect()) == [0, 1, 2, 3]
    assert structure.prunable(s, 9).count() == 0
    with pytest.raises(ValueError):
        structure.prunable(s, 0)
    f = spark.createDataFrame([(1, "b", "2"), (1, "a", "1")], "snapshot_id long, path string, content_hash string")
    import hashlib

    assert structure.root_hash(f).first().root_hash == hashlib.sha256(b"a:1\nb:2").hexdigest()
    p = spark.createDataFrame([("a/vendor/x.go",), ("vendor.go",), ("a/b.go",)], "path string")
    assert rows(p.filter(structure.visible(F.col("path")))) == [("a/b.go",), ("vendor.go",)]


def test_symbol_diff_rules(spark):
    pairs = spark.createDataFrame([(1, 2)], "before_id long, after_id long")
    files = spark.createDataFrame([(10, 1, "a", "x"), (11, 1, "same", "s"), (20, 2, "a", "y"), (21, 2, "same", "s"), (22, 2, "new", "n")], "file_id long, snapshot_id long, path string, content_hash string")
    sy = [(10, "f", "function", "1", 1), (10, "g", "function", "", 1), (10, "h", "function", "1", 1), (11, "z", "function", "1", 1),
          (20, "f", "function", "2", 1), (20, "g", "function", "9", 1), (20, "f", "class", "1", 1), (21, "y", "function", "1", 1), (22, "n", "function", "1", 1)]
    symbols = spark.createDataFrame(sy, "file_id long, name string, kind string, sig_hash string, symbol_id long")
    fc = history.file_changes(pairs, files)
    assert rows(fc.select("path", "status")) == [("a", "modified"), ("new", "added")]
    got = rows(history.symbol_changes(fc, files, symbols).select("path", "kind", "name", "status"))
    assert got == [("a", "class", "f", "added"), ("a", "function", "f", "modified"), ("a", "function", "h", "removed"), ("new", "function", "n", "added")]


REC = "delivery_id long, ts_sec long, ts_frac string, mode string, decision string, reason string, file string, edit string, symbols array<string>, repo string, lang string, gv string"


def log(spark, data):
    return spark.createDataFrame([(i, t, "", "hook", d, r, "f", e, s, "r", "go", "1") for i, (t, d, r, e, s) in enumerate(data)], REC)


def test_greedy_approvals(spark):
    a, o = ("ask", "violations"), ("outcome", "approved")
    got = rows(log_stats.approvals(log(spark, [
        (0, *a, None, ["foo"]), (120, *o, None, ["foo"]),  # approved
        (1000, *a, None, ["bar"]), (1300, *o, None, ["bar"]),  # exactly at the edge: not
        (2000, *a, "e1", ["x"]), (2000 + 3 * 3600, *o, "e1", ["y"]),  # by fingerprint
        (90_000, *o, None, ["q"]), (90_001, *a, None, ["q"]),  # outcome first: not
        (200_000, *a, None, ["t"]), (200_001, *a, None, ["t"]), (200_002, *o, None, ["t"]),  # two asks, one outcome
        (300_000, *a, None, []),
    ])).select("ask_id", "outcome_id", "track"))
    assert got == [(0, 1, "symbols"), (4, 5, "fingerprint"), (8, 10, "symbols")]


def test_duplicate_fires_compare_with_the_last_kept(spark):
    data = [(t, "ask", "v", None, ["s"]) for t in (0, 4, 8, 9, 30)]
    assert rows(log_stats.duplicate_fires(log(spark, data))) == [(1, 0), (3, 2)]


def test_as_of(spark):
    left = spark.createDataFrame([("r", 5, 1), ("r", 1, 2), ("q", 9, 3)], "repo string, t long, id long")
    right = spark.createDataFrame([("r", 2, 7), ("r", 5, 8), ("r", 6, 9)], "repo string, t long, rev long")
    assert rows(log_stats.as_of(left, right, ["repo"], "rev").select("id", "rev")) == [(1, 8), (2, None), (3, None)]


def test_diff_reader(spark):
    diff = 'diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,3 @@ ctx\n+one\n+++ b/not-a-header\n-gone\n keep\n@@ -9 +20 @@\n-a\n+b\n--- a/y\n+++ "b/\\303\\251.go"\n@@ -0,0 +1 @@\n+z\n--- a/q\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n'
    df = spark.createDataFrame([(1, diff), (2, None)], "id long, d string")
    assert rows(src.diff_added_lines(df, "id", "d")) == [
        (1, "x", 3, "one", False), (1, "x", 4, "++ b/not-a-header", False), (1, "x", 20, "b", False), (1, "é.go", 1, "z", False),
    ] or rows(src.diff_added_lines(df, "id", "d")) == sorted([
        (1, "x", 3, "one", False), (1, "x", 4, "++ b/not-a-header", False), (1, "x", 20, "b", False), (1, "é.go", 1, "z", False)], key=repr)


def test_readers(spark, tmp_path):
    lines = ['{"ts":"2026-01-01T00:00:00Z","decision":"ask","symbols":["a"]}', '{"ts":"2026-01-01"}', "broken", ""]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert [r.decision for r in src.decision_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["ask"]
    new = {"version": 7, "files": {"a.go": {"hash": "h", "symbols": [{"name": "f", "kind": "function", "line": 3}]}}}
    old = {"version": 5, "files": {"b.go": {"hash": "i", "functions": ["g"], "classes": ["C"], "symbol_hashes": {"function:g": "x"}, "symbol_lines": {"function:g": 9}}}}
    for n, doc in (("n.json", new), ("o.json", old)):
        (tmp_path / n).write_text(json.dumps(doc, indent=1))
    facts = src.structure_facts(spark, str(tmp_path / "*.json"))
    assert rows(facts) == [("a.go", "h", "function", "f", 3, ""), ("b.go", "i", "class", "C", 0, ""), ("b.go", "i", "function", "g", 9, "x")]
    src.write_structure(facts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    p = spark.createDataFrame([('{"session_id":"s","tool_name":"Edit","tool_input":{"file_path":"f","old_string":"a","new_string":"b"}}',), ('{"tool_name":"MultiEdit","tool_input":{"file_path":"g","edits":[{"old_string":"1","new_string":"2"},{"old_string":"3","new_string":"4"}]}}',), ("x",)], "v string")
    assert rows(src.edit_payloads(p, F.col("v")).select("file", "block", "new")) == [("f", 0, "b"), ("g", 0, "2"), ("g", 1, "4")]
    mods = spark.createDataFrame([(1, "module m\nrequire a.b/c v1.2.3 // x\nrequire (\n\ta.b/c/d v2.0.0\n)\nreplace a.b/c => ../c\n")], "id long, t string")
    req = src.module_requires(mods, "id", "t")
    assert rows(req.select("module", "version", "replaced")) == [("a.b/c", "v1.2.3", True), ("a.b/c/d", "v2.0.0", False)]
    imp = spark.createDataFrame([("a.b/c/d/e",), ("a.b/cx",), ("a.b/c",)], "import_path string")
    assert rows(src.longest_module(imp, req).select("import_path", "module")) == [("a.b/c", "a.b/c"), ("a.b/c/d/e", "a.b/c/d")]
    ig = spark.createDataFrame([("# c",), (" a* ",), ("",), ("b",)], "v string")
    assert rows(src.ignore_lists(ig, F.col("v"))) == [("a*", True), ("b", False)]
    la = spark.createDataFrame([('{"r":{"f":{"count":2,"last_seen":"x"}}}',), ("{",)], "v string")
    assert rows(src.learned_allow_json(la, F.col("v"))) == [("r", "f", 2, "x")]
    tree = tmp_path / "tree"
    for n in ("a.go", "node_modules/b.js", "d/c.py", "d/e.txt"):
        (tree / n).parent.mkdir(parents=True, exist_ok=True)
        (tree / n).write_text("x")
    assert sorted(r.path for r in src.source_tree(spark, str(tree)).collect()) == ["a.go", "d/c.py"]


def test_masking_and_facts(spark):
    assert extract.mask("go", 'x := "a\\"(" // f(\n`y(\n` z') .split() == ["x", ":=", "z"]
    assert extract.mask("python", "f'{g(1)} h(' # i(")[2:].strip().startswith("{g(1)}".strip("{}")) or "g(1)" in extract.mask("python", "f'{g(1)} h('")
    go = 'package p\nimport (\n\tl "log"\n\t"a/b/v2"\n)\nfunc (r *T) M(x int) { y := T{}; y.Foo(); r.Bar(); l.Print(); mystery(x); len(x) }\nfunc Free() {}\n'
    py = "from a import *\nimport b.c as d\nLIMIT_A = 1\ndef f(x, *, k=1):\n    return g(x) + LIMIT_B\nf(1, k=2, z=3)\nf(**q)\n"
    js = "import { a as b, c } from './x';\nconst { d, e: f2 } = o;\nfunction g(h) { return h + unknownFn(h) + new Map() }\n"
    df = spark.createDataFrame([(1, 1, "a.go", go), (2, 1, "b.py", py), (3, 1, "c.ts", js), (4, 1, "d.py", None), (5, 1, "e.md", "f(")], "source_id long, repo_id long, path string, content string")
    facts = extract.extract_facts(df).cache()
    known = spark.createDataFrame([(1, "g"), (1, "T.Foo"), (1, "T.Baz")], "repo_id long, name string")
    assert rows(checks.additive(facts, known).select("source_id", "name")) == [(1, "mystery"), (2, "LIMIT_B"), (3, "unknownFn")]
    assert rows(checks.file_scope(facts, known)) == []  # the star import abstains
    assert rows(checks.call_shapes(facts)) == [(2, "f", 6, "z")]
    exports = spark.createDataFrame([("log", "resolved", "Fatal"), ("a/b/v2", "partial", "X")], "module string, status string, name string")
    assert rows(checks.qualified(facts, exports).select("name")) == [("Print",)]
    assert rows(checks.member_calls(facts, known, "receiver").select("name")) == [("Bar",)]
    assert rows(checks.member_calls(facts, known, "var_type")) == []
    new = extract.extract_facts(df.withColumn("content", F.regexp_replace("content", 'l "log"', '"x"')))
    assert rows(checks.dropped_imports(facts, new).select("source_id", "name")) == [(1, "l")]
    twin = df.filter("source_id = 1").unionByName(df.filter("source_id = 1").withColumn("source_id", F.lit(9).cast("bigint")).withColumn("path", F.lit("z.go")))
    assert {r.name for r in checks.duplicate_definitions(extract.extract_facts(twin), twin).collect()} == {"Free"}


def test_store(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/store")
    files = spark.createDataFrame([("a.go", "1"), ("b.go", "2")], "path string, content_hash string")
    symbols = spark.createDataFrame([("a.go", "f", "function", None)], "path string, name string, kind string, sig_hash string")
    refs = spark.createDataFrame([("b.go", "f"), ("b.go", "f")], "path string, name string")
    st.put_repo("2026-01-01", repo_id=1, name="x", path="/x", file_cap=10)
    with pytest.raises(ValueError):
        st.put_repo("2026-01-01", repo_id=2, name="x", path="/y")
    first, wrote = st.reindex(1, "s1", "/x", "2026-01-01 00:00:00", files, symbols, refs)
    again, wrote_again = st.reindex(1, "s2", "/x", "2026-01-02 00:00:00", files, symbols, refs)
    assert wrote and not wrote_again and first == again
    assert [(r.session_id, str(r.timestamp)) for r in st.snapshots().collect()] == [("s2", "2026-01-02 00:00:00")]
    with pytest.raises(ValueError):
        st.save(1, "s", "auto", "/x", "2026-01-02", files, symbols, refs)
    other = files.withColumn("content_hash", F.lit("9"))
    st.reindex(1, "s3", "/x", "2026-01-03 00:00:00", other, symbols, refs)
    assert st.read("refs").count() == 2 and st.prune(1) == 1
    assert st.read("snapshots").count() == 1 and st.read("files").count() == 2 and st.read("refs").count() == 1
    st.activate(1, "s", "c", "p", "h", "2026-01-01")
    assert st.contracts().count() == 1
    st.activate(1, "s", "c", None, None, "2026-01-02")
    assert st.contracts().count() == 0
    with pytest.raises(ValueError):
        st.remove_repo(1)
    st.backup(f"file://{tmp_path}/copy")
    with pytest.raises(Exception):
        st.backup(f"file://{tmp_path}/copy")
    st.purge_repo(1)
    assert st.repos().count() == 0 and st.read("files").count() == 0


def test_real_exports_of_log_are_no_findings(spark):
    from codestrata.plans.check_queries import LOG_EXPORTS

    text = 'package m\nimport "log"\nimport "fmt"\nfunc f() {\n\tlog.Println("a")\n\tlog.SetFlags(log.LstdFlags)\n\tlog.Shout("b")\n\tfmt.Nothing()\n}\n'
    src = spark.createDataFrame([(1, 1, "a.go", text)], "source_id long, repo_id long, path string, content string")
    exports = spark.createDataFrame([("log", "resolved", n) for n in LOG_EXPORTS], "module string, status string, name string")
    assert {r.name for r in checks.qualified(extract.extract_facts(src), exports).collect()} == {"Shout"}


def test_all_names_of_a_go_var_line_are_bound():
    names = [f"v{k}" for k in range(12)]
    assert set(names) <= extract.bindings("go", "package m\nvar " + ", ".join(names) + " = 1\n", "var " + ", ".join(names) + " = 1\n")


def test_files_for_different_builds_are_no_duplicates(spark):
    go = "package m\nfunc {}() {{}}\n"
    rows = [(1, 1, "d/lock_linux.go", go.format("Lock")), (2, 1, "d/lock_windows.go", go.format("Lock")), (3, 1, "d/tag.go", "//go:build x\n" + go.format("Lock"))]
    rows += [(4, 1, "d/a_linux.go", go.format("Open")), (5, 1, "d/b.go", go.format("Open"))]
    src = spark.createDataFrame(rows, "source_id long, repo_id long, path string, content string")
    got = {tuple(r) for r in checks.duplicate_definitions(extract.extract_facts(src), src).collect()}
    assert got == {(4, "Open"), (5, "Open")}
