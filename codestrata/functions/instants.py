"""RFC 3339 instants without loss of fractions.

A text that is not RFC 3339 (date, ``T``, time with seconds, optional fraction,
``Z`` or an offset) gives null seconds; callers skip such rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format: RFC 3339 section 5.6, capital T and Z.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def instant_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch, null where ``ts`` is not RFC 3339."""
    local = F.unix_seconds(
        F.try_to_timestamp(F.concat(F.substring(ts, 1, 19), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    )
    zone = F.regexp_extract(ts, r"(Z|[+-]\d\d:\d\d)$", 1)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    shift = F.when(zone == "Z", F.lit(0)).when(zone.startswith("-"), -minutes).otherwise(minutes)
    return F.when(ts.rlike(RFC3339), local - shift.cast("bigint") * 60)


def instant_fraction(ts: Column) -> Column:
    """Digits of the fraction without trailing zeros, so that equal instants give equal text."""
    return F.regexp_replace(F.regexp_extract(ts, r"\.(\d+)", 1), "0+$", "")


def instant_micros(seconds: Column, fraction: Column) -> Column:
    return seconds * 1_000_000 + F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("bigint")


def instant_nanos(seconds: Column, fraction: Column) -> Column:
    """Nanoseconds as decimal, which no year overflows; digits beyond nine are cut off."""
    return seconds.cast("decimal(20,0)") * 1_000_000_000 + F.rpad(F.substring(fraction, 1, 9), 9, "0").cast("decimal(10,0)")


def instant_sql(col: str) -> tuple[str, str]:
    """(seconds, fraction) in DuckDB's SQL."""
    sec = (
        f"CASE WHEN regexp_matches({col}, '{RFC3339}') THEN "
        f"epoch(try_strptime(left({col}, 19), '%Y-%m-%dT%H:%M:%S'))::BIGINT - "
        f"CASE WHEN right({col}, 1) = 'Z' THEN 0 ELSE "
        f"(CASE WHEN substr({col}, -6, 1) = '-' THEN -1 ELSE 1 END) * "
        f"(try_cast(substr({col}, -5, 2) AS BIGINT) * 3600 + try_cast(substr({col}, -2, 2) AS BIGINT) * 60) END END"
    )
    return sec, rf"regexp_replace(regexp_extract({col}, '\.(\d+)', 1), '0+$', '')"
