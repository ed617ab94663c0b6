"""The decision log as records: one kept copy per record, typed instants."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.instants import instant_fraction, instant_seconds
from codestrata.functions.paths import path_form
from codestrata.operators.delivery import mark_repeats

#: Width of a time bucket: one day of the record's own time.
BUCKET_SECONDS = 86_400

_KEYS = ["ts_sec", "ts_frac", "edit", "file", "decision"]


def marked_deliveries(decisions: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """Every readable delivery with ``is_repeat``; rows without an RFC 3339 ``ts`` are skipped.

    A record is (ts as an instant, edit, file in path form, decision), null equal
    to null; the copy with the smallest received_at, then delivery_id, is kept.
    """
    carry = [c for c in carry if c not in ("edit", "file", "decision", "delivery_id", "received_at")]
    rows = (
        decisions.select(
            "delivery_id", "received_at", "edit", "decision", *carry, path_form(F.col("file")).alias("file"),
            instant_seconds(F.col("ts")).alias("ts_sec"), instant_fraction(F.col("ts")).alias("ts_frac"),
        ).filter(F.col("ts_sec").isNotNull())
    )
    bucket = F.floor(F.col("ts_sec") / BUCKET_SECONDS)
    return mark_repeats(rows, _KEYS, bucket, ["received_at", "delivery_id"], carry)


def kept_decisions(decisions: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    return marked_deliveries(decisions, carry).filter(~F.col("is_repeat")).drop("is_repeat")
