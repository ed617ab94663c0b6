from __future__ import annotations

import json

from codestrata.streaming.decision_stream import decision_stream, exactly_once, learned_counts, stream_approvals, volumes


def rec(ts, decision, file="f", symbols=("s",), edit=None, reason=None, repo="r"):
    return json.dumps({"ts": ts, "decision": decision, "file": file, "symbols": list(symbols), "edit": edit, "repo": repo, "reason": reason or ("approved" if decision == "outcome" else "violations"), "mode": "hook"})


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def folder(tmp_path, *batches):
    for n, lines in enumerate(batches):
        (tmp_path / f"{n}.json").write_text("\n".join(lines))
    return str(tmp_path)


def test_repeated_deliveries_and_windows(spark, tmp_path):
    a = rec("2026-01-01T00:10:00Z", "ask")
    d = folder(tmp_path, [a, a, "broken", rec("2026-01-01", "ask")], [a, rec("2026-01-01T00:20:00Z", "outcome")])
    got = run(spark, exactly_once(decision_stream(spark, d)).select("ts", "decision"), "once")
    assert sorted(r.decision for r in got) == ["ask", "outcome"]
    got = run(spark, volumes(decision_stream(spark, d)), "vol", "complete")
    assert [(r.asks, r.outcomes, r.defers) for r in got] == [(3, 1, 0)]


def test_stateful_pairing(spark, tmp_path):
    d = folder(tmp_path, [
        rec("2026-01-01T00:00:00Z", "ask"), rec("2026-01-01T00:02:00Z", "outcome"), rec("2026-01-01T00:03:00Z", "outcome"),
        rec("2026-01-01T01:00:00Z", "ask", edit="e", symbols=["a"]), rec("2026-01-01T04:00:00Z", "outcome", edit="e", symbols=["b"]),
    ])
    got = run(spark, stream_approvals(decision_stream(spark, d)), "pairs")
    assert sorted(r.track for r in got) == ["fingerprint", "symbols"]
    got = run(spark, learned_counts(decision_stream(spark, d)), "learned")
    assert {(r.symbol, r["count"]) for r in got} == {("s", 2), ("b", 1)}
