"""Differences between snapshots, and churn over their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_pairs(snapshots: DataFrame, by: str, last: int | None = None) -> DataFrame:
    """(by, before_id, after_id) of neighbours in time; over the last n snapshots of each group if given."""
    order = Window.partitionBy(by).orderBy("timestamp", "snapshot_id")
    rows = snapshots.filter(F.col(by).isNotNull())
    if last is not None:
        newest = Window.partitionBy(by).orderBy(F.col("timestamp").desc(), F.col("snapshot_id").desc())
        rows = rows.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= last)
    return (
        rows.select(by, F.lag("snapshot_id").over(order).alias("before_id"), F.col("snapshot_id").alias("after_id"))
        .filter(F.col("before_id").isNotNull())
    )


def _sides(pairs: DataFrame) -> DataFrame:
    """Every pair twice: (snapshot_id, old) for its earlier and its later snapshot."""
    both = F.array(
        F.struct(F.col("before_id").alias("snapshot_id"), F.lit(True).alias("old")),
        F.struct(F.col("after_id").alias("snapshot_id"), F.lit(False).alias("old")),
    )
    return pairs.withColumn("side", F.explode(both)).select("*", "side.snapshot_id", "side.old").drop("side")


def _of_side(old: bool, value: str) -> Column:
    return F.max(F.when(F.col("old") == old, F.col(value)))


def file_changes(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(pair columns, path, status) of all pairs in one join; files of equal hash are left out.

    Listings are joined to both sides of their pairs at once, so one aggregate by
    (pair, path) replaces a full outer join per pair; it combines before the
    shuffle and has no hot key, as a path is listed once in a snapshot.
    """
    listing = files.groupBy("snapshot_id", "path").agg(F.max_by("content_hash", "file_id").alias("h"))
    key = [*pairs.columns, "path"]
    both = _sides(pairs).join(listing, "snapshot_id").groupBy(*key).agg(
        _of_side(True, "h").alias("a"), _of_side(False, "h").alias("b")
    )
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(*key, status.alias("status"))


def symbol_changes(changes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(pair columns, path, kind, name, status) inside changed files only.

    Identity is kind and name within a path, the last row of several counting;
    modified needs a hash on both sides and differing ones.
    """
    listed = symbols.join(files.select("file_id", "snapshot_id", "path"), "file_id")
    known = listed.groupBy("snapshot_id", "path", "kind", "name").agg(F.max_by("sig_hash", "symbol_id").alias("h"))
    own = [c for c in changes.columns if c != "status"]
    key = [*own, "kind", "name"]
    one = _sides(changes.select(*own)).join(known, ["snapshot_id", "path"]).groupBy(*key).agg(
        _of_side(True, "h").alias("a"), _of_side(False, "h").alias("b")
    )
    status = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
        .when((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b")), "modified")
    )
    return one.select(*key, status.alias("status")).filter(F.col("status").isNotNull())


def change_receipt(
    files: DataFrame, symbols: DataFrame, recent_files: DataFrame, repos: DataFrame, callers: DataFrame, stale: DataFrame
) -> DataFrame:
    """(after_id, part, path, kind, name, status, callers, changes, doc_id): what a change did, with its context.

    ``files`` and ``symbols`` are the changes of pairs, part ``file`` and ``symbol``; every
    symbol stands whether or not it has callers. ``callers`` (snapshot_id, caller, name) gives
    the files that refer to a removed name in the earlier snapshot. ``recent_files`` are
    the file changes of each repository's churn window and ``repos`` (after_id, repo_id):
    ``changes`` counts the path's changes there if at least two. ``stale`` (doc_id, symbol)
    are claims that nothing defines, part ``stale``.
    """
    hot = recent_files.select("after_id", "path").join(repos, "after_id").groupBy("repo_id", "path").agg(F.count("*").alias("changes")).filter("changes >= 2")
    pair = ["before_id", "after_id", "path"]
    none = F.lit(None).cast("string")
    whole = files.select(*pair, F.lit("file").alias("part"), none.alias("kind"), none.alias("name"), "status")
    rows = whole.unionByName(symbols.select(*pair, F.lit("symbol").alias("part"), "kind", "name", "status"))
    gone = symbols.filter("status = 'removed'").select("before_id", "name").distinct()
    asked = callers.withColumnRenamed("snapshot_id", "before_id").join(gone, ["before_id", "name"], "left_semi")
    lists = asked.groupBy("before_id", "name").agg(F.array_sort(F.collect_set("caller")).alias("callers")).withColumn("status", F.lit("removed"))
    found = rows.join(lists, ["before_id", "name", "status"], "left").join(repos, "after_id", "left").join(hot, ["repo_id", "path"], "left")
    called = F.when(F.col("status") == "removed", F.when(F.col("part") == "symbol", F.coalesce("callers", F.array().cast("array<string>"))))
    columns = ["after_id", "part", "path", "kind", "name", "status", "callers", "changes", "doc_id"]
    return with_claims(found.withColumn("callers", called).withColumn("doc_id", F.lit(None).cast("long")).select(*columns), stale)


def with_claims(receipt: DataFrame, stale: DataFrame) -> DataFrame:
    """Part ``stale`` of a receipt."""
    claims = stale.select(F.lit("stale").alias("part"), F.col("symbol").alias("name"), F.col("doc_id").cast("long").alias("doc_id"))
    return receipt.unionByName(claims, allowMissingColumns=True)


#: Roles of a snapshot in a run: of the pair that it ends and the pair that it begins, the run states the changes, or counts them for churn.
_ENDS, _BEGINS, _ENDS_RECENT, _BEGINS_RECENT = 1, 2, 4, 8


def runs(snapshots: DataFrame, by: str, recent: int, length: int = 256) -> DataFrame:
    """(by, run, seq, snapshot_id, next_id, role): the history of each group, cut into runs of ``length`` pairs of neighbours in time.

    A run holds both snapshots of its pairs, so one between two runs stands in both; the
    ``recent`` newest of the group, whose changes are its churn, stand in every run. A run
    needs no row of another one, and a group of any length is spread over many tasks.
    Groups of one snapshot have no pair. Snapshot ids are unique.
    """
    time = Window.partitionBy(by).orderBy("timestamp", "snapshot_id")
    placed = (
        snapshots.filter(F.col(by).isNotNull())
        .select(by, "snapshot_id", F.row_number().over(time).alias("seq"), F.lead("snapshot_id").over(time).alias("next_id"), F.count("*").over(Window.partitionBy(by)).cast("int").alias("n"))
        .filter("n > 1")
    )
    is_recent, ends, begins = F.expr(f"n - seq < {recent}"), F.expr(f"(seq - 2) div {length}"), F.expr(f"(seq - 1) div {length}")
    own = F.array_compact(F.array_distinct(F.array(F.when(F.col("seq") > 1, ends), F.when(F.col("next_id").isNotNull(), begins))))
    every = F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 2) div {length}"))
    role = (
        F.when((F.col("seq") > 1) & (ends == F.col("run")), _ENDS).otherwise(0)
        + F.when(F.col("next_id").isNotNull() & (begins == F.col("run")), _BEGINS).otherwise(0)
        + F.when((F.col("seq") > 1) & F.expr(f"n - seq + 1 < {recent}"), _ENDS_RECENT).otherwise(0)
        + F.when(F.col("next_id").isNotNull() & is_recent, _BEGINS_RECENT).otherwise(0)
    )
    spread = placed.select("*", F.explode(F.when(is_recent, every).otherwise(own)).alias("run"))
    return spread.select(by, "run", "seq", "snapshot_id", "next_id", role.alias("role"))


def run_receipt(listing: DataFrame) -> DataFrame:
    """``change_receipt`` of all pairs from the listings themselves, parts ``file`` and ``symbol``.

    ``listing`` has a row for each file of each snapshot of ``runs``, with ``path``, ``h``
    (content hash), ``symbols`` (distinct kind and name, hash ``h`` or '') and ``refs``
    (distinct names). Neighbours are found by windows, and all of them and the aggregate lie
    inside (repo_id, run): rows placed by these two columns move no more.
    """
    key = ["repo_id", "run"]
    has = lambda bit: F.col("role").bitwiseAND(bit) != 0
    near = lambda w, c: (F.when(F.lag("seq").over(w) == F.col("seq") - 1, F.lag(c).over(w)), F.when(F.lead("seq").over(w) == F.col("seq") + 1, F.lead(c).over(w)))
    by_path = Window.partitionBy(*key, "path").orderBy("seq")
    before, after = near(by_path, "h")
    gone = ~F.coalesce(F.lead("seq").over(by_path) == F.col("seq") + 1, F.lit(False))
    status = F.when(F.col("old_h").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("modified")
    files = (
        listing.select("*", before.alias("old_h"), after.alias("new_h"), gone.alias("gone"))
        .withColumn("came", F.when(has(_ENDS | _ENDS_RECENT) & ~F.col("old_h").eqNullSafe(F.col("h")), status))
        .withColumn("turns", has(_BEGINS | _BEGINS_RECENT) & ~F.col("h").eqNullSafe(F.col("new_h")))
        .withColumn("went", F.when(F.col("turns") & F.col("gone"), "removed"))
    )
    churn = F.sum((has(_ENDS_RECENT) & F.col("came").isNotNull()).cast("int") + (has(_BEGINS_RECENT) & F.col("went").isNotNull()).cast("int"))
    counted = files.withColumn("changes", churn.over(Window.partitionBy(*key, "path"))).filter(has(_ENDS | _BEGINS)).select(
        *key, "seq", "snapshot_id", "next_id", "path", "symbols", "refs", F.when(F.col("changes") >= 2, F.col("changes")).alias("changes"),
        F.when(has(_ENDS), F.col("came")).alias("came"), F.when(has(_BEGINS), F.col("went")).alias("went"), (has(_BEGINS) & F.col("turns")).alias("turns"), has(_BEGINS).alias("begins"),
    )

    none = F.lit(None).cast("string")
    fact = lambda part, kind, name, h: F.struct(F.lit(part).alias("part"), kind.alias("kind"), name.alias("name"), h.alias("h"))
    empty = F.array().cast("array<struct<part:string,kind:string,name:string,h:string>>")
    moved = F.col("came").isNotNull() | F.col("turns")
    facts = F.concat(*[F.coalesce(x, empty) for x in (
        F.when(F.col("came").isNotNull() | F.col("went").isNotNull(), F.array(fact("file", none, none, none))),
        F.when(moved, F.transform("symbols", lambda x: fact("symbol", x["kind"], x["name"], F.coalesce(x["h"], F.lit(""))))),
        F.when(F.col("begins"), F.transform("refs", lambda x: fact("ref", none, x, none))),
    )])
    rows = counted.select(*[c for c in counted.columns if c not in ("symbols", "refs", "begins")], F.explode(facts).alias("x")).select("*", "x.*").drop("x")

    by_fact = Window.partitionBy(*key, "path", "part", "kind", "name").orderBy("seq")
    old_h, new_h = near(by_fact, "h")
    differs = F.when((F.col("h") != "") & (F.col("old") != "") & (F.col("h") != F.col("old")), "modified")
    is_symbol = F.col("part") == "symbol"
    stated = (
        rows.select("*", old_h.alias("old"), new_h.alias("new"))
        .withColumn("came", F.when(is_symbol, F.when(F.col("came").isNotNull(), F.when(F.col("old").isNull(), "added").otherwise(differs))).otherwise(F.col("came")))
        .withColumn("went", F.when(is_symbol, F.when(F.col("turns") & F.col("new").isNull(), "removed")).otherwise(F.col("went")))
        .filter((F.col("part") == "ref") | F.col("came").isNotNull() | F.col("went").isNotNull())
    )
    # a file has no callers, so each is a group by itself
    row = F.struct("part", "path", "kind", "came", "went", "changes")
    asked = stated.groupBy(*key, "seq", "snapshot_id", "next_id", "name", F.when(F.col("part") == "file", F.col("path")).alias("file")).agg(
        F.collect_list(F.when(F.col("part") != "ref", row)).alias("rows"), F.collect_list(F.when(F.col("part") == "ref", F.col("path"))).alias("callers")
    )
    found = asked.select("snapshot_id", "next_id", "name", "callers", F.explode("rows").alias("r")).select("snapshot_id", "next_id", "name", "callers", "r.*")
    called = F.when(F.col("part") == "symbol", F.array_sort("callers"))
    event = lambda after, status, callers: F.struct(F.col(after).alias("after_id"), F.col(status).alias("status"), callers.alias("callers"))
    # only a hash that is null on one side makes a listed file 'removed' where it stands
    events = F.filter(F.array(event("snapshot_id", "came", F.lit(None).cast("array<string>")), event("next_id", "went", called)), lambda e: e["status"].isNotNull())
    return found.select("part", "path", "kind", "name", "changes", F.explode(events).alias("e")).select(
        "e.after_id", "part", "path", "kind", "name", "e.status", "e.callers", "changes", F.lit(None).cast("long").alias("doc_id")
    )
