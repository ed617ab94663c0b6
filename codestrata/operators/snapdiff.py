"""What changed between consecutive full snapshots.

Method: file listings are range-partitioned and sorted by (root, path, position
of the snapshot in its root); each range is streamed once by a two-pointer
merge, one pointer on the row of the earlier listing and one on the row of the
later, comparing columns and emitting typed changes. Ranges split inside a root,
so a root with a third of all files is spread over many tasks; a task holds two
rows of state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import path_form

_OUT = "snapshot_id long, path string, change string"


def snapshot_positions(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot: its place in its root and the snapshot that follows.

    Repeated rows count once; order is timestamp, then snapshot_id. Snapshots
    without a root or id belong to no sequence and are left out.
    """
    once = snapshots.filter(F.col("root").isNotNull() & F.col("snapshot_id").isNotNull()).groupBy("root", "snapshot_id").agg(
        F.min("timestamp").alias("timestamp")
    )
    by = Window.partitionBy("root").orderBy("timestamp", "snapshot_id")
    return once.select(
        "root", "snapshot_id", F.row_number().over(by).alias("seq"), F.lead("snapshot_id").over(by).alias("next_id")
    )


def _ne(a: pa.Array, b: pa.Array) -> np.ndarray:
    return pc.not_equal(a, b).to_numpy(zero_copy_only=False)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by root, path, seq, file_id; the last listing of a path in a snapshot counts."""
    names = ["root", "path", "seq", "snapshot_id", "next_id", "content_hash"]
    held: pa.Table | None = None

    def step(table: pa.Table, final: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """Emits all changes known before the last row; that row stays as the earlier pointer."""
        n = table.num_rows
        root, path, digest = (table.column(c).combine_chunks() for c in ("root", "path", "content_hash"))
        seq = table.column("seq").to_numpy()
        same_key = np.zeros(n, dtype=bool)
        if n > 1:
            same_key[1:] = ~(_ne(root.slice(1), root.slice(0, n - 1)) | _ne(path.slice(1), path.slice(0, n - 1)))
        snap = table.column("snapshot_id").to_numpy()
        next_id = table.column("next_id").to_numpy(zero_copy_only=False)
        has_next = pc.is_valid(table.column("next_id")).to_numpy(zero_copy_only=False)
        started = table.column("started").to_numpy(zero_copy_only=False)
        prev = np.concatenate([[0], seq[:-1]])
        follows = same_key & (prev == seq - 1)
        differs = np.zeros(n, dtype=bool)
        if n > 1:
            differs[1:] = _ne(digest.slice(1), digest.slice(0, n - 1))
        changed = np.flatnonzero(follows & differs)
        added = np.flatnonzero(~started & ~follows & (seq > 1))
        # a row's path is gone in the next snapshot unless the next row is that listing
        gone = np.concatenate([~follows[1:], [final]]).astype(bool)
        removed = np.flatnonzero(gone & has_next) if final else np.flatnonzero(gone[:-1] & has_next[:-1])
        ids = np.concatenate([snap[added], snap[changed], next_id[removed]]).astype(np.int64)
        rows = np.concatenate([added, changed, removed])
        kind = ["added"] * len(added) + ["changed"] * len(changed) + ["removed"] * len(removed)
        out = pa.RecordBatch.from_arrays(
            [pa.array(ids), path.take(pa.array(rows)), pa.array(kind, pa.string())], names=["snapshot_id", "path", "change"]
        )
        last = table.slice(n - 1, 1)
        at = last.schema.get_field_index("started")
        return out, last.set_column(at, "started", pa.array([True]))

    def once(table: pa.Table) -> pa.Table:
        """Repeated listings of one path in one snapshot: only the last row stays."""
        n = table.num_rows
        if n < 2:
            return table
        seq = table.column("seq").to_numpy()
        root, path = (table.column(c).combine_chunks() for c in ("root", "path"))
        twin = (seq[1:] == seq[:-1]) & ~_ne(root.slice(1), root.slice(0, n - 1)) & ~_ne(path.slice(1), path.slice(0, n - 1))
        return table.filter(pa.array(np.concatenate([~twin, [True]])))

    pending: pa.Table | None = None  # the newest row, which a later batch may still replace
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select(names)
        table = table.append_column("started", pa.array(np.zeros(table.num_rows, dtype=bool)))
        table = once(table if pending is None else pa.concat_tables([pending, table]).combine_chunks())
        pending = table.slice(table.num_rows - 1, 1)
        body = table.slice(0, table.num_rows - 1)
        if body.num_rows:
            out, held = step(body if held is None else pa.concat_tables([held, body]).combine_chunks(), False)
            yield out
    if pending is not None:
        out, held = step(pending if held is None else pa.concat_tables([held, pending]).combine_chunks(), True)
        yield out


def snapshot_changes(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot_id, path, change) of every snapshot against the one before it in its root.

    Hash case does not count; a null hash equals a null hash. Rows without a path
    are no listing. A snapshot without file rows is an empty tree; a root's first
    snapshot has no changes. Of several listings of a path in one snapshot the
    one with the highest file_id counts. Empty tables give no rows.
    """
    listed = files.filter(F.col("path").isNotNull()).select(
        "snapshot_id", "file_id", path_form(F.col("path")).alias("path"),
        F.coalesce(F.lower("content_hash"), F.lit("")).alias("content_hash"),
    )
    rows = listed.join(snapshot_positions(snapshots), "snapshot_id")
    ranges = rows.repartitionByRange("root", "path").sortWithinPartitions("root", "path", "seq", "file_id")
    return ranges.select("root", "path", "seq", "snapshot_id", "next_id", "content_hash").mapInArrow(_merge, _OUT)
