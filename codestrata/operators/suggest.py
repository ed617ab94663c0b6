"""Did-you-mean: the three nearest known names of each probe within two edits.

Candidates meet in an equi-join: a name within distance 2 shares, of three
pieces of either name cut by its own length, at least one in about its place
(an edit spoils one piece). So no length-bucket cross product is made, and the
join has as many rows as names with a common piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import byte_levenshtein

#: Most edits, and how many suggestions.
BOUND, TOP = 2, 3


def _bytes(c: str) -> Column:
    return F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1")


def _pieces_known() -> Column:
    """(length, number, text) of the three pieces of a known name."""
    n, cuts = F.length("b"), [F.lit(0), F.floor(F.length("b") / 3), F.floor(F.length("b") * 2 / 3), F.length("b")]
    del n
    return F.array(
        *[
            F.struct(F.length("b").cast("int").alias("len"), F.lit(k).alias("k"), F.substring(F.col("b"), (cuts[k] + 1).cast("int"), (cuts[k + 1] - cuts[k]).cast("int")).alias("piece"))
            for k in range(3)
        ]
    )


def _pieces_probe() -> Column:
    """Where a known name's pieces of each length within the bound may lie in a probe: shifted by at most the bound."""
    out = []
    for diff in range(-BOUND, BOUND + 1):
        size = F.length("b") + diff
        cuts = [F.lit(0), F.floor(size / 3), F.floor(size * 2 / 3), size]
        for k in range(3):
            for shift in range(-BOUND, BOUND + 1):
                start = cuts[k] + shift
                width = (cuts[k + 1] - cuts[k]).cast("int")
                fits = (size > 0) & (start >= 0) & (start + width <= F.length("b"))
                out.append(F.when(fits, F.struct(size.cast("int").alias("len"), F.lit(k).alias("k"), F.substring(F.col("b"), (start + 1).cast("int"), width).alias("piece"))))
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))


def suggestions(probes: DataFrame, known: DataFrame) -> DataFrame:
    """(probe, name, distance, rank) for probes that are not known themselves.

    Distances are over bytes, at most 2 and at most half the probe's length;
    order by distance, then name. Null names are ignored.
    """
    k = known.select("name").dropna().distinct().withColumn("b", _bytes("name"))
    p = probes.select("probe").dropna().distinct().join(known.select(F.col("name").alias("probe")), "probe", "left_anti").withColumn("b", _bytes("probe"))
    left = p.select("probe", F.explode(_pieces_probe()).alias("x")).select("probe", "x.*")
    right = k.select("name", F.explode(_pieces_known()).alias("x")).select("name", "x.*")
    # the distance is taken where a pair meets, so only near pairs travel on; a pair may meet in three pieces
    distance = byte_levenshtein(F.col("probe"), F.col("name"), BOUND)
    met = left.join(right, ["len", "k", "piece"]).select("probe", "name", distance.alias("distance"))
    near = met.filter((F.col("distance") >= 0) & (2 * F.col("distance") <= F.octet_length("probe"))).distinct()
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("distance", "name"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= TOP)
