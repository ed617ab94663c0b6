"""Statistics of the decision log: volumes, approval pairing, latency, audits.

Records are kept decisions (one copy each) with ``ts`` as an instant. ``now`` and
windows are parameters, so every result is reproducible.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcome windows in seconds (fingerprint track, symbol track) and the duplicate-fire window.
KEYED_WINDOW, SYMBOL_WINDOW, DUPLICATE_SECONDS = 86_400, 300, 5
#: Fixed value: rateable asks a gate needs.
GATE_ASKS = 20
#: Statuses a check can have.
STATUSES = ("ok", "violation", "unknown", "skipped")


def record_micros() -> Column:
    """A record's instant in microseconds."""
    return F.col("ts_sec") * 1_000_000 + F.rpad(F.substring("ts_frac", 1, 6), 6, "0").cast("bigint")


def symbol_key(symbols: Column) -> Column:
    """Sorted distinct names joined by ``,``; null and empty give ''."""
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(symbols)), ","), F.lit(""))


def canonical_version(gv: Column) -> Column:
    """Versions with a leading ``v``; unstamped records are ``unknown``."""
    return F.when(gv.isNull() | (gv == ""), "unknown").when(gv.rlike("^[0-9]"), F.concat(F.lit("v"), gv)).otherwise(gv)


def split_checks(reason: Column) -> Column:
    """Checks of a compound reason, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(reason, r"\+"), F.trim), lambda x: x != "")


def unique_asks(records: DataFrame) -> DataFrame:
    """Asks as events: of records equal in second, repo, lang, version, reason, file and symbols the first by id."""
    asks = records.filter("decision = 'ask' and mode = 'hook'").withColumn("symbol_key", symbol_key(F.col("symbols")))
    keys = ["ts_sec", "repo", "lang", "gv", "reason", "file", "symbol_key"]
    first = asks.groupBy(*keys).agg(F.min("delivery_id").alias("delivery_id"))
    return asks.join(first.select("delivery_id"), "delivery_id", "left_semi")


def _match(asks: list[tuple], outcomes: list[tuple]) -> Iterator[tuple]:
    """Earliest unconsumed outcome at or after each ask, asks in order of time; one outcome serves one ask.

    Both are (t, delivery_id, edit, symbol_key) in order of time and id.
    """
    by_edit: dict[str, list] = defaultdict(list)
    by_symbols: dict[str, list] = defaultdict(list)
    for o in outcomes:
        if o[2]:
            by_edit[o[2]].append(o)
        by_symbols[o[3]].append(o)
    consumed: set[int] = set()
    heads: dict[tuple[str, str], int] = defaultdict(int)

    def take(track: str, value: str, queue: list, at: int, window: int) -> tuple | None:
        k = heads[track, value]
        # asks come in order of time: what lies before this one serves no later one either
        while k < len(queue) and (queue[k][0] < at or queue[k][1] in consumed):
            k += 1
        heads[track, value] = k
        return queue[k] if k < len(queue) and queue[k][0] - at < window * 1_000_000 else None

    for at, ask_id, edit, symbols in asks:
        found, track = None, ""
        if edit:
            found, track = take("edit", edit, by_edit[edit], at, KEYED_WINDOW), "fingerprint"
        if found is None:
            found, track = take("symbols", symbols, by_symbols[symbols], at, SYMBOL_WINDOW), "symbols"
        if found is not None:
            consumed.add(found[1])
            yield ask_id, found[1], track, found[0] - at


def _match_pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (file, piece, t, delivery_id, edit, symbol_key, is_ask) come sorted; one piece of a history is held at a time."""
    held: tuple | None = None
    sides: tuple[list, list] = ([], [])
    columns = ["ask_id", "outcome_id", "track", "latency_us"]
    for part in parts:
        rows: list[tuple] = []
        for file, piece, t, delivery, edit, symbols, is_ask in part.itertuples(index=False, name=None):
            if (file, piece) != held:
                rows += _match(*sides)
                held, sides = (file, piece), ([], [])
            sides[not is_ask].append((t, delivery, edit, symbols))
        yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame(list(_match(*sides)), columns=columns)


def approvals(records: DataFrame) -> DataFrame:
    """(ask_id, outcome_id, track, latency_us): greedy one-to-one pairing of asks with approved outcomes.

    First by equal file and edit fingerprint within a day, else by equal file and
    symbols within five minutes, both strict. The fold is ordered and consuming and
    cannot be a plain join. It runs over stretches of a file's history: an ask reaches
    to the last outcome it could take, and where nothing reaches across, the history is
    cut; asks that could take none are left out. So a file with a third of all records
    is folded in as many pieces as it has busy times.
    """
    columns = ["file", record_micros().alias("t"), "delivery_id", F.nullif("edit", F.lit("")).alias("edit"), "symbol_key"]
    asks = unique_asks(records).filter("file is not null and symbol_key <> ''").select(*columns, F.lit(True).alias("is_ask"))
    approved = (
        records.filter("decision = 'outcome' and reason = 'approved' and file is not null")
        .withColumn("symbol_key", symbol_key(F.col("symbols"))).filter("symbol_key <> ''").select(*columns, F.lit(False).alias("is_ask"))
    )

    def reach(by: list[Column], seconds: int) -> Column:
        within = Window.partitionBy("file", *by).orderBy("t").rangeBetween(0, seconds * 1_000_000 - 1)
        return F.max(F.when(~F.col("is_ask"), F.col("t"))).over(within)

    # records without an edit are no group of that key
    keyed = [F.col("edit").isNull().alias("none"), F.coalesce("edit", "symbol_key")]
    events = asks.unionByName(approved)
    events = events.withColumn("by_edit", F.when(F.col("edit").isNotNull(), reach(keyed, KEYED_WINDOW))).withColumn("by_symbols", reach([F.col("symbol_key")], SYMBOL_WINDOW))
    live = events.withColumn("end", F.when(F.col("is_ask"), F.greatest("by_edit", "by_symbols")).otherwise(F.col("t"))).filter("end is not null")
    order = Window.partitionBy("file").orderBy("t", "delivery_id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = live.withColumn("apart", F.coalesce(F.col("t") > before, F.lit(True)))
    pieces = cut.withColumn("piece", F.count_if("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    asked = F.max("is_ask").over(Window.partitionBy("file", "piece"))
    rows = pieces.withColumn("asked", asked).filter("asked").select("file", "piece", "t", "delivery_id", "edit", "symbol_key", "is_ask")

    pieces_sorted = rows.repartition("file", "piece").sortWithinPartitions("file", "piece", "t", "delivery_id")
    return pieces_sorted.mapInPandas(_match_pieces, "ask_id long, outcome_id long, track string, latency_us long")


def approval_buckets(records: DataFrame, since_sec: int, max_rate: float = 0.5) -> DataFrame:
    """(bucket, key, asks, approved, unrated, total, versions, rate, coverage, gate) since an instant.

    ``bucket`` is window (all asks, no key), reason, check, lang or version; an ask counts
    for each check of its compound reason. Asks without symbols are unrated: coverage is
    the share of asks the rate is over. The gate is tripped by a rate above ``max_rate``
    over at least 20 rateable asks of one version; of several it does not speak.
    """
    recent = records.filter(F.col("ts_sec") >= since_sec)
    asks = unique_asks(recent).withColumn("version", canonical_version(F.col("gv")))
    paired = asks.join(approvals(recent).select(F.col("ask_id").alias("delivery_id"), F.lit(1).alias("hit")), "delivery_id", "left")
    entry = lambda b, c: F.struct(F.lit(b).alias("bucket"), c.cast("string").alias("key"))
    whole = F.array(entry("window", F.lit(None)), *[entry(c, F.col(c)) for c in ("reason", "lang", "version")])
    checks = F.transform(F.coalesce(split_checks(F.col("reason")), F.array().cast("array<string>")), lambda c: entry("check", c))
    rows = paired.select(F.explode(F.concat(whole, checks)).alias("e"), "symbol_key", "hit", "version").select("e.*", "symbol_key", "hit", "version")
    rated = F.col("symbol_key") != ""
    sums = rows.groupBy("bucket", "key").agg(
        F.count_if(rated).alias("asks"), F.count("hit").alias("approved"), F.count_if(~rated).alias("unrated"),
        F.count_distinct(F.when(rated, F.col("version"))).alias("versions"),
    )
    total = F.col("asks") + F.col("unrated")
    rate = F.when(F.col("asks") == 0, F.lit(0.0)).otherwise(F.col("approved") / F.col("asks"))
    coverage = F.when(total == 0, F.lit(1.0)).otherwise(F.col("asks") / total)
    gate = (F.col("asks") >= GATE_ASKS) & (F.col("versions") == 1) & (F.col("rate") > max_rate)
    return sums.withColumns({"total": total, "rate": rate, "coverage": coverage}).withColumn("gate", gate)


def duplicate_fires(records: DataFrame) -> DataFrame:
    """(delivery_id, fires_after): asks within five seconds of the last *kept* ask of the same file, reason and symbols.

    At 0, 4 and 8 seconds two asks are kept, so this is a fold and no lag.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, kept = None, (0, 0)
        for part in parts:
            rows = []
            for file, reason, key, chain, t, delivery in part.itertuples(index=False, name=None):
                if (file, reason, key, chain) != held:
                    held, kept = (file, reason, key, chain), (t, delivery)
                elif t - kept[0] <= DUPLICATE_SECONDS * 1_000_000:
                    rows.append((delivery, kept[1]))
                else:
                    kept = (t, delivery)
            yield pd.DataFrame(rows, columns=["delivery_id", "fires_after"])

    t = record_micros().alias("t")
    asks = records.filter("decision = 'ask' and file is not null").select("file", "reason", symbol_key(F.col("symbols")).alias("symbol_key"), t, "delivery_id")
    # a gap of more than the window begins a new chain; only chains of several asks hold a repeated fire
    order = Window.partitionBy("file", "reason", "symbol_key").orderBy("t", "delivery_id")
    apart = F.coalesce(F.col("t") - F.lag("t").over(order) > DUPLICATE_SECONDS * 1_000_000, F.lit(True))
    chains = asks.withColumn("apart", apart).withColumn("chain", F.count_if("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.col("apart") & F.coalesce(F.lead("apart").over(order), F.lit(True))
    keys = ["file", "reason", "symbol_key", "chain"]
    rows = chains.withColumn("alone", alone).filter("not alone").select(*keys, "t", "delivery_id").repartition(*keys)
    return rows.sortWithinPartitions(*keys, "t", "delivery_id").mapInPandas(fold, "delivery_id long, fires_after long")


def recent_asks(records: DataFrame) -> DataFrame:
    """(delivery_id, ask_id, track): the ask that each outcome record answers, looked up at the outcome's own time.

    First the newest earlier ask of the same file and edit within a day, unless an outcome
    of that edit has come since (then none); else the newest earlier ask of the file within
    five minutes, unless any outcome of the file has come since. Both windows are strict.

    A file's history is cut into buckets of an hour, events being put into the next one
    too if it begins within five minutes, so a file with a third of all records is spread
    over time; histories of one edit are short.
    """
    events = records.filter("file is not null and decision in ('ask', 'outcome')").select("file", "edit", "decision", record_micros().alias("t"), "delivery_id")
    place = F.struct("t", "delivery_id")
    newest = lambda x, w: F.max(F.when(F.col("decision") == x, place)).over(w)
    upto = lambda *by: Window.partitionBy(*by).orderBy("t", "delivery_id").rowsBetween(Window.unboundedPreceding, -1)
    keyed = events.filter("edit is not null").withColumn("a", newest("ask", upto("file", "edit"))).withColumn("o", newest("outcome", upto("file", "edit")))
    by_edit = keyed.filter((F.col("decision") == "outcome") & (F.col("t") - F.col("a.t") < KEYED_WINDOW * 1_000_000)).select(
        "delivery_id", F.when(F.coalesce(F.col("o") > F.col("a"), F.lit(False)), F.lit(None)).otherwise(F.col("a.delivery_id")).alias("edit_ask")
    )
    hour, reach = 3_600_000_000, SYMBOL_WINDOW * 1_000_000
    own = F.floor(F.col("t") / hour)
    met = events.withColumn("own", own).withColumn("bucket", F.explode(F.array_distinct(F.array(own, F.floor((F.col("t") + reach) / hour)))))
    near = met.withColumn("a", newest("ask", upto("file", "bucket"))).withColumn("o", newest("outcome", upto("file", "bucket")))
    by_file = near.filter("decision = 'outcome' and bucket = own").select(
        "delivery_id", F.when((F.col("t") - F.col("a.t") < reach) & ~F.coalesce(F.col("o") > F.col("a"), F.lit(False)), F.col("a.delivery_id")).alias("file_ask")
    )
    both = by_file.join(by_edit.withColumn("keyed", F.lit(True)), "delivery_id", "left")
    ask = F.when(F.col("keyed"), F.col("edit_ask")).otherwise(F.col("file_ask"))
    return both.select("delivery_id", ask.alias("ask_id"), F.when(F.col("keyed"), "edit").otherwise("window").alias("track")).filter("ask_id is not null")


def check_tally(records: DataFrame) -> DataFrame:
    """(check, ok, violation, unknown, skipped) over the checks maps; other words are not counted."""
    rows = records.select(F.explode("checks").alias("check", "status"))
    return rows.groupBy("check").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def latency(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, min, median (mean of the middle two), truncated mean and max of latency_us."""
    v = F.col("latency_us")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(v).alias("min_us"), F.percentile(v, F.lit(0.5)).alias("median_us"),
        F.floor(F.avg(v)).cast("bigint").alias("mean_us"), F.max(v).alias("max_us"),
    )


def as_of(left: DataFrame, right: DataFrame, by: list[str], value: str, width: int = 86_400) -> DataFrame:
    """Adds to each left row ``value`` of the newest right row with the same keys at or before ``t``, null if none.

    Rows meet in buckets of ``width``, so a key with a third of all rows is split by time. What
    a bucket starts with is carried over from the last earlier bucket that has a right row: one
    value for each key and bucket. Inside a bucket there is one sort and one running value;
    rights come first on equal times, later values counting.
    """
    bucket = F.floor(F.col("t") / width).alias("bucket")
    cols = [c for c in left.columns if c not in by and c != "t"]
    kind = right.schema[value].dataType
    l_rows = left.select(*by, "t", bucket, F.lit(2).alias("side"), F.struct(*cols).alias("l"), F.lit(None).cast(kind).alias("r"))
    none = F.lit(None).cast(l_rows.schema["l"].dataType).alias("l")
    r_rows = right.select(*by, "t", bucket, F.lit(1).alias("side"), none, F.col(value).alias("r"))
    lasts = right.groupBy(*by, bucket).agg(F.max(F.struct("t", value)).alias("last"))
    asked = left.select(*by, bucket).distinct()
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = asked.join(lasts, [*by, "bucket"], "full").withColumn("v", F.last("last", ignorenulls=True).over(before)).filter("v is not null")
    c_rows = starts.select(*by, F.col("v.t").alias("t"), "bucket", F.lit(0).alias("side"), none, F.col(f"v.{value}").alias("r"))
    order = Window.partitionBy(*by, "bucket").orderBy("t", "side", F.col("r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    held = l_rows.unionByName(r_rows).unionByName(c_rows).withColumn("v", F.last("r", ignorenulls=True).over(order))
    return held.filter("side = 2").select(*by, "t", *[F.col(f"l.{c}").alias(c) for c in cols], F.col("v").alias(value))


def learned_allow(approved: DataFrame, ttl_days: int, threshold: int, now_us: int) -> DataFrame:
    """(repo, symbol, count, last_seen_us) of approved symbols seen often and recently enough."""
    rows = approved.groupBy("repo", "symbol").agg(F.count("*").alias("count"), F.max("t").alias("last_seen_us"))
    return rows.filter((F.col("count") >= threshold) & (F.col("last_seen_us") >= now_us - ttl_days * 86_400_000_000))
