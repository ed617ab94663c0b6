from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from codestrata.operators import extract, reports


def test_folds_and_shapes(spark):
    s = spark.createDataFrame([("p", "function", "f", 1, "a", 3, "d"), ("p", "function", "f", 2, "b", 9, "e"), ("p", "class", "C", 3, "", 0, None)], "path string, kind string, name string, ordinal int, hash string, line int, doc string")
    got = {r.name: r for r in reports.folded_symbols(s).collect()}
    assert got["f"].hash == hashlib.sha256(b"ab").hexdigest() and got["f"].line == 3 and got["f"].doc == "d"
    old = reports.legacy_shape(reports.folded_symbols(s).withColumn("content_hash", F.lit("h"))).first()
    assert old.functions == ["f"] and old.classes == ["C"] and old.exports == []
    assert [x.name for x in reports.symbols_by_file(s).first().symbols] == ["C", "f", "f"]


def test_cache_verdicts_scores(spark):
    p = spark.createDataFrame([("m", "a.go", "x"), ("m", "b.go", "y"), ("n", "c.go", "z")], "import_path string, file string, content string")
    none = spark.createDataFrame([], "key string")
    misses = reports.cache_misses(p, none, "v1")
    assert misses.count() == 2 and reports.cache_misses(p, misses.select("key"), "v1").count() == 0 and reports.cache_misses(p, misses.select("key"), "v2").count() == 2
    r = spark.createDataFrame([(1, "lint", "ok", ""), (1, "scope", "unknown", "timeout"), (1, "x", "unknown", "ambiguous-local")], "event long, check string, verdict string, reason string")
    assert reports.verdict_maps(r).first().reasons == {"scope": "timeout", "x": "ambiguous-local"}
    assert reports.degraded_unknowns(r).first().n == 1
    c = spark.createDataFrame([("go", True, True), ("go", False, True), ("go", False, False)], "lang string, flagged boolean, label boolean")
    s = reports.scorecard(c, ["lang"]).first()
    assert (s.tp, s.fn, s.fp, s.tn, s.recall, s.fp_rate) == (1, 1, 0, 1, 0.5, 0.0)
    df = spark.createDataFrame([(True, False, True)], "a boolean, b boolean, c boolean")
    assert df.select(reports.ask_reason(["a", "b", "c"], ["c", "b", "a"])).first()[0] == "c+a"


def test_captured_and_triage(spark):
    schema = "id string, source_line string, referenced_symbol string, label string, known_symbols array<string>, notes string"
    good = spark.createDataFrame([("1", "foo(x)", "foo", "hallucinated", ["bar"], "position=arg; z")], schema)
    assert reports.captured_cases(good).first().position == "arg"
    with pytest.raises(Exception, match="invalid case"):
        reports.captured_cases(good.withColumn("label", F.lit("real"))).collect()
    f = spark.createDataFrame([("r", "a.go", True), ("r", "a/dist/x.js", True), ("q", "b.go", True), ("q", "c.go", True), ("q", "d.go", False)], "repo string, path string, genuine boolean")
    assert reports.triage_verdict(reports.triage(f)).first().worth
    assert [r.path for r in reports.changed_paths(f.select("path"), f.select("path")).collect()] == ["a.go", "a/dist/x.js", "b.go", "c.go", "d.go"]


def test_lines_and_payloads(spark):
    b = spark.createDataFrame([("f", 0, "a\nb"), ("f", 1, "c")], "file string, block int, text string")
    assert sorted((r.line_no, r.text) for r in reports.block_lines(b).collect()) == [(1, "a"), (2, "b"), (4, "c")]
    t = spark.createDataFrame([("b\nc", "a\nb\nc\n"), ("q", "a")], "o string, t string")
    assert [r[0] for r in t.select(reports.block_position(F.col("o"), F.col("t"))).collect()] == [2, 0]
    ch = spark.createDataFrame([(1, "x", "added")], "after_id long, path string, status string")
    assert reports.payload(ch).first().payload == '{"added":["x"],"removed":[],"modified":[]}'
    src = spark.createDataFrame([(1, "go", "f(\n`a\n(`,\n{\n}}"), (2, "python", "x = '''\n[\n'''\n[")], "source_id long, lang string, content string")
    got = {(r.source_id, r.line_no): (r.brace, r.bracket, r.paren, r.open) for r in reports.line_states(src).collect()}
    assert got[1, 2] == (0, 0, 1, False) and got[1, 3] == (0, 0, 1, True) and got[1, 5] == (1, 0, 1, False) and got[2, 2][3] and got[2, 4] == (0, 0, 0, False)


def test_definitions_of_more_languages():
    names = lambda lang, text: [n for n, _, _ in extract.definitions(lang, extract.mask(lang, text))]
    assert names("shell", "f() {\ncat <<EOT\ng() {\nEOT\n}\nfunction h {\n:\n}\n") == ["f", "h"]
    assert names("rust", '/// fn x\npub fn a() { let s = r#"fn b() {"#; }\nstruct C;') == ["a", "C"]
    assert names("ruby", "class A\n  # def no\n  def self.b?; end\nend\n") == ["A", "b?"]


def test_synthetic_cases_are_reproducible():
    a = reports.synthetic_cases(1, ["loadIndex", "saveAll"], ["zap"], 2)
    assert a == reports.synthetic_cases(1, ["loadIndex", "saveAll"], ["zap"], 2) and any(c[2] for c in a) and any(not c[2] for c in a)


def test_approval_buckets(spark):
    from codestrata.operators.log_stats import approval_buckets

    row = lambda k, ts, decision, reason, gv, symbols: (k, ts, "000000", decision, reason, "hook", "r", "go", gv, "f.go", symbols, None)
    data = [row(0, 10, "ask", "a", "1.0", ["old"])]  # before the window
    data += [row(100 + k, 1000 + k * 1000, "ask", "a+b" if k % 2 else "a", "1.0", [f"s{k}"]) for k in range(24)]
    data += [row(200 + k, 1001 + k * 1000, "outcome", "approved", "1.0", [f"s{k}"]) for k in range(18)]
    data += [row(300 + k, 1000 + k * 1000, "ask", "b", "1.0", []) for k in range(4)]
    schema = "delivery_id long, ts_sec long, ts_frac string, decision string, reason string, mode string, repo string, lang string, gv string, file string, symbols array<string>, edit string"
    got = {(r.bucket, r.key): r for r in approval_buckets(spark.createDataFrame(data, schema), 1000).collect()}
    pick = lambda *k: (got[k].asks, got[k].approved, got[k].unrated, got[k].gate)
    assert pick("window", None) == (24, 18, 4, True) and got["window", None].coverage == 24 / 28
    assert pick("check", "a") == (24, 18, 0, True) and pick("check", "b") == (12, 9, 4, False) and pick("reason", "a+b") == (12, 9, 0, False)
    mixed = data[:-1] + [row(400, 90000, "ask", "a", "2.0", ["z"])]
    got = {(r.bucket, r.key): r for r in approval_buckets(spark.createDataFrame(mixed, schema), 1000).collect()}
    assert (got["window", None].versions, got["window", None].gate, got["version", "v1.0"].gate) == (2, False, True)


def test_change_receipt_keeps_symbols_without_callers_and_adds_churn_and_claims(spark):
    from codestrata.operators.history import change_receipt

    files = spark.createDataFrame([(1, 2, "a.go", "modified"), (1, 2, "b.go", "removed")], "before_id long, after_id long, path string, status string")
    symbols = spark.createDataFrame([(1, 2, "a.go", "function", "f", "removed"), (1, 2, "b.go", "function", "g", "removed"), (1, 2, "a.go", "function", "h", "added")], "before_id long, after_id long, path string, kind string, name string, status string")
    recent = spark.createDataFrame([(0, 1, "a.go", "modified"), (1, 2, "a.go", "modified"), (1, 2, "b.go", "removed")], files.schema)
    repos = spark.createDataFrame([(1, 7), (2, 7)], "after_id long, repo_id long")
    callers = spark.createDataFrame([(1, "c.go", "f"), (1, "b.go", "f"), (2, "x.go", "g")], "snapshot_id long, caller string, name string")
    stale = spark.createDataFrame([(5, "loadAll")], "doc_id long, symbol string")
    got = sorted((r.part, r.path or "", r.name or "", r.callers, r.changes, r.doc_id) for r in change_receipt(files, symbols, recent, repos, callers, stale).collect())
    assert got == [
        ("file", "a.go", "", None, 2, None), ("file", "b.go", "", None, None, None), ("stale", "", "loadAll", None, None, 5),
        ("symbol", "a.go", "f", ["b.go", "c.go"], 2, None), ("symbol", "a.go", "h", None, 2, None), ("symbol", "b.go", "g", [], None, None),
    ]


def test_receipt_by_runs_is_that_of_the_joins_wherever_a_history_is_cut(spark):
    import random

    from pyspark.sql import functions as F

    from codestrata.operators import history

    dice = random.Random(7)
    snaps = [(i, None if i == 3 else 1 if i < 30 else i % 5 + 2, i // 2) for i in range(1, 60)] + [(99, 50, 1)]
    files, symbols, refs = [], [], []
    for i, _, _ in snaps:
        for k in range(0 if i % 11 == 0 else 4):
            if dice.random() < 0.7:
                files.append((i * 100 + k, i, f"f{k}", dice.choice("xyz")))
                symbols += [(i * 100 + k, 0, n, kind, dice.choice(["", "h1", "h2"])) for n in "ab" for kind in ("class", "field") if dice.random() < 0.5]
                refs += [(i * 100 + k, n) for n in "abc" if dice.random() < 0.5]
    s = spark.createDataFrame(snaps, "snapshot_id long, repo_id long, timestamp long")
    f = spark.createDataFrame(files, "file_id long, snapshot_id long, path string, content_hash string")
    sy = spark.createDataFrame(symbols, "file_id long, symbol_id long, name string, kind string, sig_hash string")
    rf = spark.createDataFrame(refs, "file_id long, name string")
    stale = spark.createDataFrame([(5, "loadAll")], "doc_id long, symbol string")

    changed = history.file_changes(history.consecutive_pairs(s, "repo_id").select("before_id", "after_id"), f)
    recent = history.file_changes(history.consecutive_pairs(s, "repo_id", 4).select("before_id", "after_id"), f)
    callers = f.join(rf, "file_id").select("snapshot_id", F.col("path").alias("caller"), "name")
    repos = s.select(F.col("snapshot_id").alias("after_id"), "repo_id")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(history.change_receipt(changed, history.symbol_changes(changed, f, sy), recent, repos, callers, stale))
    listed = f.select("file_id", "snapshot_id", "path", F.col("content_hash").alias("h"))
    listed = listed.join(sy.groupBy("file_id").agg(F.collect_list(F.struct("kind", "name", F.col("sig_hash").alias("h"))).alias("symbols")), "file_id", "left")
    listed = listed.join(rf.groupBy("file_id").agg(F.collect_list("name").alias("refs")), "file_id", "left")
    for length in (1, 2, 7, 256):
        placed = history.runs(s, "repo_id", 4, length)
        assert rows(history.with_claims(history.run_receipt(placed.join(listed, "snapshot_id")), stale)) == want


def test_truth_trail_receipt_moves_each_line_twice(spark, sf):
    from codestrata.plans.structure_queries import QUERIES

    plan = QUERIES["truth_trail_receipt"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 1
    # orders by repository; lines and orders by order; both by run; claims and known names
    assert plan.count("Exchange hashpartitioning") <= 8
