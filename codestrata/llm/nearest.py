"""Matching records of two tables by nearest time.

Method: both tables are united, sorted per entity and time; a forward pass
carries the last right-side record onto each left row, a backward pass the next
one, and the nearer within the tolerance is chosen.

An entity that holds a third of all rows is split by time: rows meet in buckets
of many tolerances' width, and right-side rows within the tolerance of a bucket's
edge are also put into the neighbour, so no pair is lost and none is seen twice
(a left row is in one bucket). Carrying needs one running value a pass; Spark's
window holds the rows of one entity and bucket, and spills them to disk. The width of
the buckets is a parameter: narrower ones split a hotter entity further, as long as
they are wider than the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.instants import instant_micros
from codestrata.functions.paths import path_form
from codestrata.operators.decisions import kept_decisions

#: Pairing tolerance and bucket width of the production query.
TOLERANCE_SECONDS = 300
BUCKET_SECONDS = 3_600


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: list[str], tolerance_us: int, bucket_us: int, optional: str
) -> DataFrame:
    """(left_id, right_id) of each left row that has a partner.

    Both sides have ``entity`` columns, ``t`` (microseconds), ``sub`` (the
    nanoseconds beyond them), ``id`` and ``optional``: a pair whose two
    ``optional`` values are both present and different is no candidate. The
    partner is the right row nearest in time; ties go to the earlier, then to the
    smaller id. Rows with a null in ``entity``, ``t`` or ``id`` have no partner. A
    right row may serve several left rows.
    """
    needed = [*entity, "t", "id"]
    bucket = lambda t: F.floor(t / F.lit(bucket_us)).cast("bigint")
    cols = [*entity, F.col("t"), F.coalesce("sub", F.lit(0)).alias("sub"), F.col("id"), F.col(optional).alias("opt")]
    lefts = left.dropna(subset=needed).select(*cols, F.lit(True).alias("is_left"), bucket(F.col("t")).alias("bucket"))
    # of right rows that differ in nothing but the id only the smallest can be chosen
    rights = (
        right.dropna(subset=needed).select(*cols).groupBy(*entity, "t", "sub", "opt").agg(F.min("id").alias("id"))
        .select(*entity, "t", "sub", "id", "opt", F.lit(False).alias("is_left"))
    )
    edge = tolerance_us + 1
    near = F.array_distinct(F.array(bucket(F.col("t") - edge), bucket(F.col("t")), bucket(F.col("t") + edge)))
    both = lefts.unionByName(rights.withColumn("bucket", F.explode(near)))

    group = [*entity, "bucket"]
    place = F.struct("t", "sub", "id")
    mine = F.when(~F.col("is_left"), place)
    unbound = F.when(~F.col("is_left") & F.col("opt").isNull(), place)
    # on equal times right rows come first, the smallest id last, so that it is the one carried
    forward = [F.col("t"), F.col("sub"), F.col("is_left"), F.col("id").desc()]
    backward = [F.col("t").desc(), F.col("sub").desc(), F.col("is_left"), F.col("id").desc()]

    def carried(value: Column, by: list[str], order: list[Column]) -> Column:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.last(value, ignorenulls=True).over(w)

    passes = both.withColumns(
        {
            "any_last": carried(mine, group, forward), "any_next": carried(mine, group, backward),
            "free_last": carried(unbound, group, forward), "free_next": carried(unbound, group, backward),
            "same_last": carried(mine, [*group, "opt"], forward), "same_next": carried(mine, [*group, "opt"], backward),
        }
    )
    gap = lambda c: F.abs((c["t"] - F.col("t")) * 1000 + c["sub"] - F.col("sub"))
    seen = F.when(F.col("opt").isNull(), F.array("any_last", "any_next")).otherwise(
        F.array("free_last", "free_next", "same_last", "same_next")
    )
    choices = F.transform(
        seen, lambda c: F.when(c.isNotNull(), F.struct(gap(c).alias("gap"), c["t"], c["sub"].alias("sub"), c["id"].alias("id")))
    )
    best = F.array_min(F.filter(choices, lambda c: c["gap"] <= tolerance_us * 1000))
    return (
        passes.filter("is_left")
        .select(F.col("id").alias("left_id"), best.alias("best"))
        .filter(F.col("best").isNotNull())
        .select("left_id", F.col("best.id").alias("right_id"))
    )


def edit_partners(decisions: DataFrame, edits: DataFrame) -> DataFrame:
    """(delivery_id, edit_id): each applied edit with the nearest kept ask of its file and symbols."""
    symbols = F.array_sort(F.array_distinct(F.filter("symbols", lambda s: s.isNotNull())))
    nanos = F.rpad(F.substring("ts_frac", 1, 9), 9, "0").cast("bigint")
    asks = (
        kept_decisions(decisions.filter(F.col("decision") == "ask"), ["symbols"])
        .filter(F.col("file").isNotNull())
        .select(
            "file", symbols.alias("symbols"), instant_micros(F.col("ts_sec"), F.col("ts_frac")).alias("t"),
            (nanos % 1000).cast("int").alias("sub"), F.col("delivery_id").alias("id"), "edit",
        )
        .filter(F.size("symbols") > 0)
    )
    done = edits.select(
        path_form(F.col("file")).alias("file"), symbols.alias("symbols"), F.unix_micros(F.col("applied_at").cast("timestamp")).alias("t"),
        F.lit(0).alias("sub"), F.col("edit_id").alias("id"), "edit",
    ).filter(F.size("symbols") > 0)
    found = nearest_in_time(done, asks, ["file", "symbols"], TOLERANCE_SECONDS * 1_000_000, BUCKET_SECONDS * 1_000_000, "edit")
    return found.select(F.col("right_id").alias("delivery_id"), F.col("left_id").alias("edit_id"))
