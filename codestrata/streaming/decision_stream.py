"""The decision log as a stream: exactly-once records, windows, approvals, learned symbols.

Event time is the record's own ts with a watermark of a day, the widest window in
which an outcome can still belong to an ask.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codestrata.functions.instants import instant_fraction, instant_micros, instant_seconds
from codestrata.functions.paths import path_form
from codestrata.operators.log_stats import KEYED_WINDOW, SYMBOL_WINDOW, symbol_key
from codestrata.sources.records import DECISION

WATERMARK = "24 hours"


def decision_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records of JSON lines as they arrive in a folder; unreadable ones are skipped."""
    rows = spark.readStream.schema(DECISION).json(folder)
    seconds, fraction = instant_seconds(F.col("ts")), instant_fraction(F.col("ts"))
    return (
        rows.withColumn("event_time", F.timestamp_micros(instant_micros(seconds, fraction)))
        .filter(F.col("event_time").isNotNull()).withColumn("file", path_form(F.col("file"))).withWatermark("event_time", WATERMARK)
    )


def exactly_once(records: DataFrame) -> DataFrame:
    """The first copy of each record: equal instant, edit, file and decision, null equal to null.

    State leaves with the watermark, so a copy that comes more than a day after the newest
    record is late data and dropped, be it the first or not; the batch operator keeps such a first copy.
    """
    fraction = instant_fraction(F.col("ts"))
    rows = records.withColumns({"record_sec": instant_seconds(F.col("ts")), "record_frac": fraction})
    unique = rows.dropDuplicatesWithinWatermark(["record_sec", "record_frac", "edit", "file", "decision"])
    return unique.drop("record_sec", "record_frac")


def volumes(records: DataFrame, window: str = "1 hour") -> DataFrame:
    """Asks, outcomes and deferrals in tumbling windows."""
    n = lambda x: F.count_if(F.col("decision") == x).alias(f"{x}s")
    return records.groupBy(F.window("event_time", window)).agg(n("ask"), n("outcome"), n("defer")).select("window.start", "window.end", "asks", "outcomes", "defers")


_PAIR = "file string, ask_time timestamp, outcome_time timestamp, track string"
_OPEN = "asks array<struct<t:bigint,edit:string,symbols:string>>"


def _pair(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    asks = [(a["t"], a["edit"], a["symbols"]) for a in state.get[0]] if state.exists else []
    if state.hasTimedOut:
        state.remove()
        return
    part = pd.concat(list(parts)).sort_values(["t", "decision"], kind="stable")
    rows = []
    for t, decision, edit, symbols in zip(part["t"], part["decision"], part["edit"], part["symbol_key"], strict=True):
        if decision == "ask":
            asks.append((int(t), edit, symbols))
            continue
        tracks = (
            ("fingerprint", lambda a, e=edit: bool(e) and a[1] == e, KEYED_WINDOW),
            ("symbols", lambda a, s=symbols: a[2] == s, SYMBOL_WINDOW),
        )
        for track, same, window in tracks:
            hit = next((a for a in asks if same(a) and 0 <= t - a[0] < window * 1_000_000), None)
            if hit:
                asks.remove(hit)
                rows.append((key[0], pd.Timestamp(hit[0], unit="us"), pd.Timestamp(int(t), unit="us"), track))
                break
    newest = int(part["t"].max())
    asks = [a for a in asks if newest - a[0] < KEYED_WINDOW * 1_000_000]
    state.update(([{"t": a[0], "edit": a[1], "symbols": a[2]} for a in asks],))
    state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + KEYED_WINDOW * 1000)
    yield pd.DataFrame(rows, columns=["file", "ask_time", "outcome_time", "track"])


def stream_approvals(records: DataFrame) -> DataFrame:
    """Outcomes paired with the earliest open ask of their file: by fingerprint within a day, else by symbols within five minutes.

    State of a file is its open asks of the last day and leaves with the watermark.
    """
    rows = records.filter("file is not null and (decision = 'ask' or (decision = 'outcome' and reason = 'approved'))").select(
        "file", F.unix_micros("event_time").alias("t"), "event_time", "decision", "edit", symbol_key(F.col("symbols")).alias("symbol_key")
    ).filter("symbol_key <> ''")
    return rows.groupBy("file").applyInPandasWithState(_pair, _PAIR, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


_LEARNED = "repo string, symbol string, count long, last_seen_us long"


def learned_counts(records: DataFrame, ttl_days: int = 14) -> DataFrame:
    """(repo, symbol, count, last_seen_us) each time an approval adds to a symbol's count; a lapsed count starts again."""
    ttl = ttl_days * 86_400_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, 0)
        for t in sorted(int(x) for part in parts for x in part["t"]):
            count = count + 1 if t - last <= ttl else 1
            last = max(last, t)
        state.update((count, last))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + ttl // 1000)
        yield pd.DataFrame([(*key, count, last)], columns=["repo", "symbol", "count", "last_seen_us"])

    rows = records.filter("decision = 'outcome' and reason = 'approved' and repo is not null").select(
        "repo", "event_time", F.unix_micros("event_time").alias("t"), F.explode("symbols").alias("symbol")
    ).filter("symbol is not null")
    return rows.groupBy("repo", "symbol").applyInPandasWithState(step, _LEARNED, "count long, last long", "append", GroupStateTimeout.EventTimeTimeout)
