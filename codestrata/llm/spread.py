"""Spreading rows over all tasks for work bound by CPU."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codestrata.session import cpu_tasks


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows by hash of a unique key, over a number of tasks that grows with the data.

    The number is given explicitly, as adaptive coalescing measures bytes and
    would put CPU-bound work back into a few tasks.
    """
    return df.repartition(cpu_tasks(df), *key)
