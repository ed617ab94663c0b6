from __future__ import annotations

import json
from datetime import datetime, timedelta

from codestrata.operators.drift import cast, common_type, consistent_table, form, json_type, name_similarity, read_object, schema_changes

SCHEMA = "file_name string, stream string, opened_at timestamp, line_no int, body string, received_at timestamp, field string"
T0 = datetime(2026, 1, 1)


def lines(spark, files):
    rows = []
    for k, (name, stream, bodies) in enumerate(files):
        for n, b in enumerate(bodies):
            rows.append((name, stream, T0 + timedelta(hours=k), n, b if isinstance(b, str) or b is None else json.dumps(b), None, "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, files):
    return sorted(tuple(r) for r in schema_changes(lines(spark, files)).collect())


def record(k, **extra):
    return {"v": 1, "ts": f"2026-01-01T00:00:{k:02d}Z", "lang": ["go", "python", "rust"][k % 3], "symbols": [f"loadIndex{k}", "f"], **extra}


def renamed(r, old, new):
    return {new if k == old else k: v for k, v in r.items()}


def test_added_removed_renamed_retyped(spark):
    a = [record(k, took=k) for k in range(20)]
    b = [renamed(record(k, took=k), "lang", "language") for k in range(20, 40)]
    c = [{k2: v for k2, v in renamed(record(k, took=k + 0.5), "lang", "language").items() if k2 != "symbols"} | {"dry_run": True} for k in range(40, 59)]
    assert found(spark, [("f1", "log-1", a), ("f2", "log-1", b), ("f3", "log-1", c)]) == [
        ("f2", "lang", "language", "renamed"), ("f3", "dry_run", "", "added"), ("f3", "symbols", "", "removed"), ("f3", "took", "", "retyped"),
    ]


def test_broken_null_and_repeated_lines(spark):
    a = [record(1), "not json", "[1]", '{"a": NaN}', "", None, record(1), {"only_null": None, **record(2)}]
    assert found(spark, [("f1", "log-1", a), ("f2", "log-1", [record(3), {"late": None, **record(4)}])]) == []
    assert found(spark, []) == []
    assert found(spark, [("f1", "log-1", [record(1)]), ("f2", "log-2", [{"x": 1}])]) == []  # streams are apart


def test_items_of_the_symbols_array_only_in_structure_streams(spark):
    item = lambda k, **x: {"name": f"fn{k}", "kind": ["function", "class"][k % 2], "line": k * 7, **x}
    a = [{"path": f"p{k}.go", "symbols": [item(k), item(k + 1)], "refs": [{"target": "x", "at": k}]} for k in range(20)]
    b = [{"path": f"p{k}.go", "symbols": [renamed(item(k, doc="text"), "line", "start_line")], "refs": [{"target": "x"}]} for k in range(20)]
    assert found(spark, [("f1", "ir-1", a), ("f2", "ir-1", b)]) == [
        ("f2", "symbols.doc", "", "added"), ("f2", "symbols.line", "symbols.start_line", "renamed"),
    ]
    assert found(spark, [("f1", "log-1", a), ("f2", "log-1", b)]) == []
    c = [{"path": f"p{k}.go", "symbols": [f"function:fn{k}"], "refs": [{"target": "x"}]} for k in range(20)]
    assert found(spark, [("f1", "ir-1", a), ("f2", "ir-1", c)]) == [("f2", "symbols", "", "retyped")]


def test_map_entries_are_data(spark):
    a = [{"checks": {"lint": "ok", "scope": "ok"}, "v": 1}]
    b = [{"checks": {"dangling": "violation"}, "v": 1}]
    assert found(spark, [("f1", "log-1", a), ("f2", "log-1", b)]) == []


def test_empty_arrays_carry_no_type(spark):
    assert found(spark, [("f1", "log-1", [{"s": []}]), ("f2", "log-1", [{"s": ["a"]}]), ("f3", "log-1", [{"s": [1]}])]) == [("f3", "s", "", "retyped")]


def test_consistent_table_uses_first_names(spark):
    a = [record(k) for k in range(20)]
    b = [renamed(record(k), "lang", "language") for k in range(20, 40)]
    got = consistent_table(lines(spark, [("f1", "log-1", a), ("f2", "log-1", b), ("f3", "log-1", b)]))
    names = {r.field for r in got.select("field").distinct().collect()}
    assert names == {"v", "ts", "lang", "symbols"}
    assert got.filter("field = 'lang'").count() == 60


def test_streams_of_one_kind_end_under_one_schema_and_one_type(spark):
    a = [record(k, took=k) for k in range(40)]
    b = [renamed(record(k, took=k + 0.5), "lang", "language") for k in range(40, 80)]
    files = [("f1", "log-1", a), ("f2", "log-2", b), ("f3", "ir-1", [{"language": "x", "n": 1}])]
    got = consistent_table(lines(spark, files)).groupBy("stream", "field", "type").count().collect()
    names = {s: {(r.field, r.type) for r in got if r.stream == s} for s in ("log-1", "log-2", "ir-1")}
    assert names["log-1"] == names["log-2"] == {("v", "integer"), ("ts", "string"), ("lang", "string"), ("symbols", "array<string>"), ("took", "fraction")}
    assert names["ir-1"] == {("language", "string"), ("n", "integer")}


def test_items_are_renamed_and_cast_inside_the_symbols_array(spark):
    item = lambda k, **x: {"name": f"fn{k}", "kind": ["function", "class"][k % 2], "line": k * 7, **x}
    a = [{"path": f"p{k}.go", "symbols": [item(k), item(k + 1)]} for k in range(20)]
    b = [{"path": f"p{k}.go", "symbols": [renamed(item(k), "line", "start_line")]} for k in range(20)]
    c = [{"path": "p.go", "symbols": ["class:fn3"]}, {"path": "q.go", "symbols": [{**item(4), "line": "28"}]}]
    got = consistent_table(lines(spark, [("f1", "ir-1", a), ("f2", "ir-1", b), ("f3", "ir-1", c)])).filter("field = 'symbols'").collect()
    items = [i for r in got for i in json.loads(r.value)]
    assert {r.type for r in got} == {"array<object>"} and len(items) == 62
    assert {tuple(sorted(i)) for i in items} == {("kind", "line", "name"), ("kind", "name")}
    assert all(type(i.get("line", 0)) is int for i in items)


def test_casts():
    def united(*values):
        to = common_type({form(v) for v in values})
        return [to, *(cast(v, to, any(form(v) == "text:time" for v in values)) for v in values)]

    assert united(1, "2") == ["integer", 1, 2]
    assert united(1, "2", 0.5) == ["fraction", 1.0, 2.0, 0.5]
    assert united(2**60, 0.5) == ["string", str(2**60), "0.5"]
    assert united(1767225600500, "2026-01-01T00:00:00Z") == ["string", "2026-01-01T00:00:00.500Z", "2026-01-01T00:00:00Z"]
    assert united({"major": 0, "minor": 15, "patch": 4}, "0.16.0") == ["string", "0.15.4", "0.16.0"]
    assert united(["a"], "a,b", [{"name": "c"}], []) == ["array<string>", ["a"], ["a", "b"], ["c"], []]
    assert united({"lint": "ok"}, [{"check": "scope", "status": "ok"}]) == ["object", {"lint": "ok"}, {"scope": "ok"}]
    assert united(True, "x", [1]) == ["string", "true", "x", "[1]"]


def test_helpers():
    assert [json_type(x) for x in (None, True, 1, 1.5, "", {}, [], [None], [1, 2], ["a"])] == [
        "", "boolean", "integer", "fraction", "string", "object", "array", "array", "array<integer>", "array<string>",
    ]
    assert read_object("3") is None and read_object('{"a":1}') == {"a": 1}
    assert name_similarity("learn_symbols", "learnSymbols") > 0.9
