from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa

from codestrata.operators.decisions import kept_decisions, marked_deliveries
from codestrata.operators.delivery import BucketStorage, ScalableBloom, mark_repeats

SCHEMA = "delivery_id long, received_at timestamp, ts string, edit string, file string, decision string, extra string, is_repeat string"
T0 = datetime(2026, 6, 1)


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", "clash") for r in data], SCHEMA)


def repeats(df):
    return sorted(r.delivery_id for r in marked_deliveries(df).filter("is_repeat").collect())


def test_bloom_has_no_false_negatives():
    bloom = ScalableBloom(bits=1 << 8)
    values = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    for part in np.array_split(values, 17):
        bloom.add(part)
    assert bloom.may_contain(values).all()
    others = np.random.default_rng(2).integers(-(2**62), 2**62, 5000)
    assert bloom.may_contain(others).mean() < 0.2


def test_storage_finds_records_in_any_run():
    rng = np.random.default_rng(3)
    storage, expected = BucketStorage(), {}
    for n in range(60):
        hashes = rng.integers(0, 500, 40)
        storage.add(hashes, pa.table({"k": [f"{n}-{i}" for i in range(40)]}))
        for i, h in enumerate(hashes.tolist()):
            expected.setdefault(h, set()).add((f"{n}-{i}",))
    assert len(storage.runs) < 12
    wanted = np.unique(rng.integers(0, 600, 200))
    assert storage.matching(wanted, ["k"]) == set().union(*(expected.get(h, set()) for h in wanted.tolist()))


def test_instants_nulls_paths_and_ties(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    df = rows(spark, [
        (1, at(5), "2026-06-01T00:00:00Z", "e", "a/b.go", "ask"),
        (2, at(5), "2026-06-01T02:00:00+02:00", "e", "./a\\b.go", "ask"),  # the same instant and file, same arrival
        (3, at(1), "2026-06-01T00:00:00.000Z", "e", "a/b.go", "ask"),  # arrived first: kept
        (4, at(9), "2026-06-01T00:00:00Z", None, "a/b.go", "ask"),
        (5, at(9), "2026-06-01T00:00:00Z", None, "a/b.go", "ask"),
        (6, at(9), "2026-06-01T00:00:00.0000001Z", None, "a/b.go", "ask"),  # another instant
        (7, at(9), "2026-06-01 00:00:00", "e", "a/b.go", "ask"),  # unreadable
        (8, at(9), None, "e", "a/b.go", "ask"),
        (9, at(9), "2026-02-30T00:00:00Z", "e", "a/b.go", "ask"),
        (10, at(9), "2026-06-01T00:00:00Z", None, None, None),
        (11, None, "2026-06-01T00:00:00Z", None, None, None),  # a null arrival comes last
    ])
    assert repeats(df) == [1, 2, 5, 11]
    kept = sorted(r.delivery_id for r in kept_decisions(df).collect())
    assert kept == [3, 4, 6, 10]


def test_composed_and_decomposed_names_are_one_file(spark):
    df = rows(spark, [(1, T0, "2026-06-01T00:00:00Z", "e", "índice.go", "ask"), (2, T0, "2026-06-01T00:00:00Z", "e", "índice.go", "ask")])
    assert repeats(df) == [2]


def test_empty_table(spark):
    assert repeats(rows(spark, [])) == []


def test_brute_force_with_a_hot_record(spark):
    rng = random.Random(4)
    data = []
    for i in range(4000):
        hot = rng.random() < 0.34
        second = 7 if hot else rng.randrange(86_400 * 3)
        ts = (T0 + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")
        data.append((i, T0 + timedelta(seconds=rng.randrange(50)), ts, "h" if hot else str(rng.randrange(3)), "f", "ask"))
    best: dict = {}
    for r in data:
        k = r[2:6]
        best[k] = min(best.get(k, (r[1], r[0])), (r[1], r[0]))
    expected = sorted(r[0] for r in data if best[r[2:6]][1] != r[0])
    assert repeats(rows(spark, data).repartition(5)) == expected


def test_collisions_of_hashes_are_verified(spark):
    """All rows in one bucket and one batch: equality is by keys, not by hash."""
    df = spark.createDataFrame([(i, i % 50, str(i % 100)) for i in range(1000)], "id long, t long, k string")
    from pyspark.sql import functions as F

    got = mark_repeats(df, ["k"], F.lit(0), ["t", "id"])
    assert got.filter("not is_repeat").count() == 100
