from __future__ import annotations

import random
from datetime import datetime, timedelta

from codestrata.operators.snapdiff import snapshot_changes

S = "snapshot_id long, repo_id long, timestamp timestamp, root string, next_id string"
FL = "file_id long, snapshot_id long, path string, content_hash string, root string"
T0 = datetime(2026, 1, 1)


def changes(spark, snaps, files):
    s = spark.createDataFrame([(i, None, t, r, "clash") for i, t, r in snaps], S)
    f = spark.createDataFrame([(*x, "clash") for x in files], FL)
    return sorted(tuple(r) for r in snapshot_changes(s, f).collect())


def test_order_duplicates_and_case(spark):
    snaps = [(5, T0, "r"), (3, T0 + timedelta(1), "r"), (3, T0 + timedelta(1), "r"), (9, T0 + timedelta(1), "r"), (1, T0, None)]
    files = [
        (1, 5, "a.go", "AB"), (2, 5, "./b.go", "cc"), (3, 5, None, "x"),
        (4, 3, "a.go", "ab"), (5, 3, "c\\d.go", "dd"), (6, 3, "c/d.go", "dd"),
        (7, 9, "a.go", None), (8, 9, "c/d.go", "ee"), (9, 77, "z", "z"),
    ]
    assert changes(spark, snaps, files) == [
        (3, "b.go", "removed"), (3, "c/d.go", "added"), (9, "a.go", "changed"), (9, "c/d.go", "changed"),
    ]


def test_empty_snapshots_and_tables(spark):
    snaps = [(1, T0, "r"), (2, T0 + timedelta(1), "r"), (3, T0 + timedelta(2), "r")]
    assert changes(spark, snaps, [(1, 1, "a", "h"), (2, 3, "a", "h")]) == [(2, "a", "removed"), (3, "a", "added")]
    assert changes(spark, snaps, []) == []
    assert changes(spark, [], [(1, 1, "a", "h")]) == []


def test_brute_force(spark):
    rng = random.Random(7)
    snaps, files, tree, k = [], [], {}, 0
    expected = []
    for root in ("r1", "r2"):
        before = None
        for n in range(12):
            sid = 100 * (root == "r2") + n
            snaps.append((sid, T0 + timedelta(hours=n), root))
            tree = {f"d/{p}.go": str(rng.randrange(3)) for p in range(40) if rng.random() < 0.7}
            for p, h in tree.items():
                k += 1
                files.append((k, sid, p, h))
            if before is not None:
                for p in before.keys() | tree.keys():
                    if p not in tree:
                        expected.append((sid, p, "removed"))
                    elif p not in before:
                        expected.append((sid, p, "added"))
                    elif before[p] != tree[p]:
                        expected.append((sid, p, "changed"))
            before = tree
    rng.shuffle(files)
    assert changes(spark, snaps, files) == sorted(expected)
