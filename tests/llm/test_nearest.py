from __future__ import annotations

import random
from datetime import datetime, timedelta

from codestrata.llm.nearest import edit_partners

D = "delivery_id long, received_at timestamp, ts string, file string, decision string, symbols array<string>, edit string, edit_id string"
E = "edit_id long, applied_at timestamp, file string, symbols array<string>, edit string, delivery_id string"
T0 = datetime(2026, 6, 1, 12)


def ts(seconds):
    return (T0 + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def partners(spark, asks, edits):
    a = spark.createDataFrame([(i, T0, t if isinstance(t, str) or t is None else ts(t), f, d, s, e, "clash") for i, t, f, d, s, e in asks], D)
    b = spark.createDataFrame([(i, None if t is None else T0 + timedelta(seconds=t), f, s, e, "clash") for i, t, f, s, e in edits], E)
    return sorted((r.delivery_id, r.edit_id) for r in edit_partners(a, b).collect())


def test_ties_tolerance_sets_and_edits(spark):
    asks = [
        (1, 0, "./f", "ask", ["b", "a", "a"], None), (2, 20, "f", "ask", ["a", "b"], "e2"), (3, 20, "f", "ask", ["a", "b"], "e1"),
        (4, 1000, "f", "ask", ["a"], None), (5, 10, "f", "defer", ["a", "b"], None), (6, 10, None, "ask", ["a", "b"], None),
        (7, 10, "f", "ask", [], None), (8, 10, "f", "ask", None, None), (9, None, "f", "ask", ["a", "b"], None), (10, "bad", "f", "ask", ["a", "b"], None),
    ]
    edits = [
        (100, 10, "f", ["a", "b"], None),  # 0 and 20 are as near: the earlier
        (101, 15, "f", ["a", "b"], None),  # two at 20: the smaller id
        (102, 15, "f", ["b", "a"], "e1"),  # e2 is no candidate
        (103, 15, "f", ["a", "b"], "other"),  # only the ask without edit
        (104, 1300, "f", ["a"], None),  # exactly 300 s
        (105, 1301, "f", ["a"], None), (106, 10, None, ["a", "b"], None), (107, 10, "f", [], None), (108, 10, "f", None, None), (109, None, "f", ["a", "b"], None),
    ]
    assert partners(spark, asks, edits) == [(1, 100), (1, 103), (2, 101), (3, 102), (4, 104)]
    assert partners(spark, [], edits) == [] and partners(spark, asks, []) == []


def test_brute_force_with_a_hot_entity(spark):
    rng = random.Random(3)
    asks = [(i, rng.randrange(20_000), "hot" if i % 3 else f"f{i % 7}", "ask", ["s"], rng.choice([None, "x", "y"])) for i in range(1500)]
    edits = [(i, rng.randrange(20_000), "hot" if i % 3 else f"f{i % 7}", ["s"], rng.choice([None, "x", "z"])) for i in range(600)]
    kept = {}
    for a in asks:  # one copy of equal (ts, edit, file)
        kept.setdefault((a[1], a[5], a[2]), a)
    expected = []
    for e in edits:
        near = [
            (abs(a[1] - e[1]), a[1], a[0]) for a in kept.values()
            if a[2] == e[2] and abs(a[1] - e[1]) <= 300 and not (a[5] and e[4] and a[5] != e[4])
        ]
        if near:
            expected.append((min(near)[2], e[0]))
    assert partners(spark, asks, edits) == sorted(expected)
