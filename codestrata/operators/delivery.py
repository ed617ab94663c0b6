"""Messages delivered more than once: keep exactly one copy of each.

Method: a Bloom filter per time bucket screens identifiers that are definitely
new; possible repeats are verified exactly against the matching bucket's
storage only.

Plan (one narrow shuffle):

1. *combine* - inside every Arrow batch of the scan, copies that lose to an
   earlier copy in the same batch are settled at once. A record whose copies are
   a third of all rows therefore sends at most one row per batch to its
   identifier's task; the settled copies travel by their own id.
2. rows are hash-partitioned by identifier, so every time bucket is spread over
   all tasks and no bucket can be hot, and sorted by bucket and arrival.
3. *screen and verify* - each task streams its slice bucket by bucket: the
   bucket's Bloom filter is asked first; what it has never seen is new without
   any look-up, what it may have seen is compared, key by key, with the records
   that this bucket's storage holds. Storage and filter are dropped with the
   bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HASH, _BUCKET, _ROUTE, _LOST = "__hash", "__bucket", "__route", "__lost"


class ScalableBloom:
    """Bloom filter that grows by layers; no false negatives, about 1 % false positives.

    Every layer has twice the bits of the one before and takes ``bits / 12``
    identifiers, so a bucket of any size is served without knowing it before.
    """

    def __init__(self, bits: int = 1 << 14, probes: int = 6):
        self.probes = probes
        self.layers: list[tuple[np.ndarray, int]] = []
        self.room = 0
        self.next_bits = bits

    def _positions(self, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(byte, mask) of every probe."""
        low = hashes.astype(np.uint64)
        high = (low >> np.uint64(32)) | np.uint64(1)
        steps = np.arange(self.probes, dtype=np.uint64)[:, None]
        at = (low[None, :] + steps * high[None, :]) % np.uint64(bits)
        return (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))

    def may_contain(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), dtype=bool)
        for cells, bits in self.layers:
            at, mask = self._positions(hashes, bits)
            found |= ((cells[at] & mask) != 0).all(axis=0)
        return found

    def add(self, hashes: np.ndarray) -> None:
        while len(hashes):
            if self.room <= 0:
                self.layers.append((np.zeros(self.next_bits // 8, dtype=np.uint8), self.next_bits))
                self.room = self.next_bits // 12
                self.next_bits *= 2
            now, hashes = hashes[: self.room], hashes[self.room :]
            cells, bits = self.layers[-1]
            at, mask = self._positions(now, bits)
            np.bitwise_or.at(cells, at.ravel(), mask.ravel())
            self.room -= len(now)


def _same_as_previous(batch: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    """For each row whether all columns equal the row before; null equals null."""
    n = batch.num_rows
    same = np.ones(n, dtype=bool)
    same[:1] = False
    if n > 1:
        for name in columns:
            col = batch.column(name)
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            a, b = col.slice(1), col.slice(0, n - 1)
            equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
            nulls = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
            same[1:] &= equal | nulls
    return same


def _combine(keys: list[str], order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            by = pc.sort_indices(table, sort_keys=[(_HASH, "ascending")] + [(c, "ascending") for c in order])
            table = table.take(by)
            lost = _same_as_previous(table, [_HASH, *keys])
            at = table.schema.get_field_index(_LOST)
            table = table.set_column(at, pa.field(_LOST, pa.bool_()), pa.array(lost))
            # what is settled needs no meeting with its record: spread it by its own id
            route = np.where(lost, np.arange(len(lost)) * 7919, table.column(_HASH).to_numpy())
            at = table.schema.get_field_index(_ROUTE)
            table = table.set_column(at, pa.field(_ROUTE, pa.int64()), pa.array(route))
            yield from table.to_batches()

    return run


def _rows(batch: pa.RecordBatch | pa.Table, at: np.ndarray, keys: list[str]) -> list[tuple]:
    columns = [batch.column(k).take(pa.array(at)).to_pylist() for k in keys]
    return list(zip(*columns, strict=True))


class BucketStorage:
    """The kept records of one time bucket, found by hash.

    Runs sorted by hash, each at least twice as long as the next: records are merged a
    logarithmic number of times, and a look-up is a binary search in each run.
    """

    def __init__(self):
        self.runs: list[tuple[np.ndarray, pa.Table]] = []

    def add(self, hashes: np.ndarray, rows: pa.Table) -> None:
        order = np.argsort(hashes, kind="stable")
        self.runs.append((hashes[order], rows.take(pa.array(order))))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            (a, x), (b, y) = self.runs[-2:]
            both = np.concatenate([a, b])
            order = np.argsort(both, kind="stable")
            self.runs[-2:] = [(both[order], pa.concat_tables([x, y]).take(pa.array(order)).combine_chunks())]

    def matching(self, wanted: np.ndarray, keys: list[str]) -> set[tuple]:
        """Keys of the records with one of the sorted hashes."""
        found: set[tuple] = set()
        for hashes, rows in self.runs:
            low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
            hit = high > low
            if hit.any():
                at = np.concatenate([np.arange(a, b) for a, b in zip(low[hit], high[hit], strict=True)])
                found.update(_rows(rows, at, keys))
        return found


def _screen(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        bloom, storage = ScalableBloom(), BucketStorage()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            repeat = batch.column(_LOST).to_numpy(zero_copy_only=False).copy()
            hashes = batch.column(_HASH).to_numpy()
            buckets = batch.column(_BUCKET).to_numpy()
            edges = np.flatnonzero(np.diff(buckets)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
                if buckets[start] != current:
                    current, bloom, storage = int(buckets[start]), ScalableBloom(), BucketStorage()
                rows = np.flatnonzero(~repeat[start:end]) + start
                if not len(rows):
                    continue
                part = hashes[rows]
                maybe = bloom.may_contain(part)
                first = np.zeros(len(rows), dtype=bool)
                first[np.unique(part, return_index=True)[1]] = True
                maybe |= ~first
                fresh = rows[~maybe]
                if maybe.any():
                    suspects = rows[maybe]
                    wanted = np.unique(hashes[suspects])
                    seen = storage.matching(wanted, keys)
                    here = np.union1d(fresh[np.isin(hashes[fresh], wanted)], suspects)
                    new = []
                    for row, key in zip(here.tolist(), _rows(batch, here, keys), strict=True):
                        if key in seen:
                            repeat[row] = True
                        else:
                            seen.add(key)
                            new.append(row)
                    fresh = np.union1d(fresh, np.array(new, dtype=np.int64))
                if len(fresh):
                    bloom.add(hashes[fresh])
                    storage.add(hashes[fresh], pa.Table.from_batches([batch.select(keys).take(pa.array(fresh))]))
            at = batch.schema.get_field_index(_LOST)
            yield batch.set_column(at, pa.field(_LOST, pa.bool_()), pa.array(repeat))

    return run


def mark_repeats(
    df: DataFrame, keys: list[str], time_bucket: Column, order: list[str], carry: Iterable[str] = ()
) -> DataFrame:
    """``order``, ``keys`` and ``carry`` columns of every row, and ``is_repeat``.

    Of the rows with equal ``keys`` (null equals null) the one that comes first
    by ``order`` (nulls last) is not a repeat; ``order`` must be a total order. Exact rows
    delivered twice under one order value are repeats too. ``time_bucket`` is a
    bigint function of the keys; rows where it is null take bucket -1. An empty
    table gives an empty result. Extra columns are ignored unless carried.
    """
    names = list(dict.fromkeys([*order, *keys, *carry]))
    flags = [F.col(k).isNull() for k in keys]
    rows = df.select(
        *names,
        F.xxhash64(*keys, *flags).alias(_HASH),
        F.coalesce(time_bucket.cast("bigint"), F.lit(-1)).alias(_BUCKET),
        F.lit(0).cast("bigint").alias(_ROUTE),
        F.lit(False).alias(_LOST),
    )
    combined = rows.mapInArrow(_combine(keys, order), rows.schema)
    routed = combined.repartition(_ROUTE).sortWithinPartitions(_BUCKET, *[F.col(c).asc_nulls_last() for c in order])
    screened = routed.mapInArrow(_screen(keys), rows.schema)
    return screened.select(*names, F.col(_LOST).alias("is_repeat"))
