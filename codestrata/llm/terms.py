"""Frequency of every distinct name, and which are too rare or too common.

Method: pairs of term and record are range-partitioned and sorted (an external
sort, spilling as Spark's sort does), then each range is scanned once for runs:
equal terms give the occurrences, changes of the record inside a term the number
of distinct records.

Before the sort equal pairs of one Arrow batch become one, so a record that repeats a
term a million times sends a row a batch. Ranges are cut by (term, record): a term
that is a third of all pairs fills many ranges, and as equal pairs meet in one
range, the few partial runs of a term are added exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.decisions import kept_decisions
from codestrata.session import materialise

#: Bounds of the production query: fewer records than this are rare, a larger share is common.
RARE_RECORDS = 3
COMMON_PERCENT = 2


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (term, record, n) in; one (term, occurrences, records) for each run of a term out."""
    held: tuple[str, int, int, object] | None = None  # term, occurrences, records, last record

    def out(terms: list, occurrences: list, records: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())],
            names=["name", "occurrences", "records"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, record = batch.column(0), batch.column(1)
        count = batch.column(2).to_numpy()
        new_term = np.ones(n, dtype=bool)
        new_record = np.ones(n, dtype=bool)
        if n > 1:
            new_term[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new_record[1:] = pc.not_equal(record.slice(1), record.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new_record |= new_term
        if held is not None and held[0] == term[0].as_py() and held[3] == record[0].as_py():
            new_record[0] = False
        starts = np.flatnonzero(new_term)
        terms = term.take(pa.array(starts)).to_pylist()
        occurrences = np.add.reduceat(count, starts).tolist()
        records = np.add.reduceat(new_record.astype(np.int64), starts).tolist()
        if held is not None:
            if held[0] == terms[0]:
                occurrences[0] += held[1]
                records[0] += held[2]
            else:
                yield out([held[0]], [held[1]], [held[2]])
        held = (terms[-1], occurrences[-1], records[-1], record[n - 1].as_py())
        if len(terms) > 1:
            yield out(terms[:-1], occurrences[:-1], records[:-1])
    if held is not None:
        yield out([held[0]], [held[1]], [held[2]])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal pairs of a batch as one."""
    for batch in batches:
        if batch.num_rows:
            summed = pa.Table.from_batches([batch]).group_by(["name", "record"], use_threads=False).aggregate([("n", "sum")])
            yield from summed.rename_columns(["name", "record", "n"]).to_batches()


def term_counts(pairs: DataFrame) -> DataFrame:
    """(name, occurrences, records) from (name, record, n): n occurrences of a name in a record.

    Null names or records are no pairs; an n of null counts as 0.
    """
    clean = pairs.dropna(subset=["name", "record"]).select("name", "record", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    combined = clean.mapInArrow(_combined, "name string, record string, n long")
    ranges = combined.repartitionByRange("name", "record").sortWithinPartitions("name", "record")
    partial = ranges.mapInArrow(_runs, "name string, occurrences long, records long")
    return partial.groupBy("name").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def _records(decisions: DataFrame, tallies: DataFrame) -> tuple[DataFrame, int]:
    """(pairs, number of records): records are kept decisions and distinct sessions of the tallies."""
    kept = kept_decisions(decisions, ["symbols"]).select(F.concat(F.lit("d"), F.col("delivery_id")).alias("record"), "symbols")
    kept = materialise(kept, "kept-symbols")  # read twice, and sampled for the ranges: the exact dedup runs once
    sessions = tallies.filter(F.col("session_id").isNotNull())
    pairs = kept.select(F.explode("symbols").alias("name"), "record", F.lit(1).cast("bigint").alias("n")).unionByName(
        sessions.select("name", F.concat(F.lit("s"), F.col("session_id")).alias("record"), F.col("count").alias("n"))
    )
    # two counts, whatever the size of the data
    total = kept.count() + sessions.select("session_id").distinct().count()
    return pairs, total


def name_frequencies(decisions: DataFrame, tallies: DataFrame) -> DataFrame:
    """(name, occurrences, records, mark): mark is rare, common or null.

    Occurrences count repeats inside a record's array and the tallies' counts;
    a record with several rows or repeats of a name is one record. A name may be
    both rare and common only in tables of few records; rare wins then.
    """
    pairs, total = _records(decisions, tallies)
    mark = F.when(F.col("records") < RARE_RECORDS, "rare").when(F.col("records") * 100 > total * COMMON_PERCENT, "common")
    return term_counts(pairs).select("name", "occurrences", "records", mark.alias("mark"))
