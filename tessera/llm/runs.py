"""Sorted runs of fingerprints, kept as binary blocks, and their merge.

A map task turns its part of the corpus into sorted immutable runs; each run
is cut by fingerprint range into buckets, and a bucket's blocks from all runs
meet in one task, which merges them with numpy. So the shuffle carries a few
large rows and not a row for each fingerprint. Tasks get their blocks in the
order of the buckets and hold one bucket at a time.

The merge is a stable sort of the blocks one after the other: numpy's is
Timsort, which finds the sorted stretches and merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch_of, distinct, partitions

#: Fingerprints that a run holds before it is written.
RUN_ROWS = 1 << 20
RUN_SCHEMA = "bucket int, chunk long, n int, a binary, b binary, c binary, d binary"
_RUN = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_FLAGGED = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_ROWS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.binary()), ("old", pa.bool_())])
#: A batch's runs are numbered from its own number times this.
BATCH = 1 << 40


class RunWriter:
    """Collects fingerprints with the word positions they stand at, and the rows they come from."""

    def __init__(self, buckets: int, width: int, base: int = 0):
        self.buckets, self.width, self.base, self.seq = buckets, width, base, 0
        self._clear()

    def _clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = self.words = 0

    def add(self, keys: np.ndarray, at: np.ndarray, k1: np.ndarray, k2: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """keys[n, width] stand at words at[n]; first: each row's first word, and one more at the end."""
        self.keys.append(keys)
        self.at.append(at + self.words)
        self.rows.append((k1, k2, first[:-1] + self.words))
        self.words += int(first[-1])
        self.held += len(keys)
        if self.held >= RUN_ROWS or self.words >= 1 << 31:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            task, seq = TaskContext.get().partitionId(), self.seq
            chunk = self.base | task << 16 | seq
            self.seq += 1
            k1, k2, first = (np.concatenate(x) for x in zip(*self.rows, strict=True))
            keys, at = np.concatenate(self.keys), np.concatenate(self.at)
            order = np.argsort(keys[:, 0])
            keys, at = keys[order], at[order].astype(np.uint32)
            # what repeats inside the run is known here; one of its copies tells the other runs, so a
            # fingerprint that is everywhere comes to its bucket once from each run
            again = np.zeros(len(keys), bool)
            again[1:] = (keys[1:] == keys[:-1]).all(1)
            local = again.copy()
            local[:-1] |= again[1:]
            known = at[local]
            keys, at = np.ascontiguousarray(keys[~again]), at[~again]
            # the rows of the run are kept with it, so that it is computed once
            yield batch_of(_RUN, [-1], [chunk], [-1], [k1.tobytes()], [k2.tobytes()], [first.tobytes()], [known.tobytes()])
            which = bucket_of(keys[:, 0], self.buckets)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(which)]]) if len(which) else np.zeros(1, int)
            s, e = cut[:-1], cut[1:]
            for lo in range(0, len(s), 256):
                p = [(int(which[i]), keys[i:j].tobytes(), at[i:j].tobytes(), int(j - i)) for i, j in zip(s[lo : lo + 256], e[lo : lo + 256], strict=True)]
                yield batch_of(_RUN, [x[0] for x in p], [chunk] * len(p), [x[3] for x in p], [x[1] for x in p], [x[2] for x in p], [None] * len(p), [None] * len(p))
        self._clear()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket; buckets are ranges, so a sorted run has them in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _merged(blocks: list[tuple[bytes, bytes, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of (keys, places, runs) as one sequence in which equal keys are neighbours."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x, _, _ in blocks]).reshape(-1, width)
    at = np.concatenate([np.frombuffer(y, np.uint32) for _, y, _ in blocks])
    run = np.concatenate([c for _, _, c in blocks])
    order = np.argsort(keys[:, 0], kind="stable")
    keys = keys[order]
    if width > 1 and len(keys) and ((keys[1:, 0] == keys[:-1, 0]) & (keys[1:] != keys[:-1]).any(1)).any():
        again = np.lexsort(keys.T[::-1])  # keys that differ in a later part alone
        order, keys = order[again], keys[again]
    return keys, at[order], run[order]


def _by_bucket(batches: Iterator[pa.RecordBatch], headers: list[pa.RecordBatch] | None = None) -> Iterator[tuple[int, list[tuple[bytes, bytes, np.ndarray]]]]:
    """The blocks of each bucket; rows come in the order of the buckets, after the first blocks of runs, which are put aside."""
    now, held = None, []
    for b in batches:
        if headers is not None and (n := int(np.searchsorted(b.column("bucket").to_numpy(), 0))):
            headers.append(b.slice(0, n).select(_FLAGGED.names))
            b = b.slice(n)
        for bucket, chunk, n, x, y, z in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "n", "a", "b", "c")), strict=True):
            if held and bucket != now:
                yield now, held
                held = []
            now = bucket
            held.append((x, y, np.full(n, chunk, np.int64) if z is None else np.frombuffer(z, np.int64)))
    if held:
        yield now, held


def compacted(runs: DataFrame, width: int, buckets: int) -> DataFrame:
    """The same runs with each bucket's blocks merged into one sorted sequence, now in so many buckets; blocks then name the run of each entry in c."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, n, x, y, z in zip(*(b.column(c).to_pylist() for c in ("chunk", "n", "a", "b", "c")), strict=True):
                keys, at = np.frombuffer(x, np.uint64).reshape(-1, width), np.frombuffer(y, np.uint32)
                run = None if z is None else np.frombuffer(z, np.int64)
                which = bucket_of(keys[:, 0], buckets)
                cut = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), n]
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    yield batch_of(_RUN, [int(which[i])], [chunk], [j - i], [keys[i:j].tobytes()], [at[i:j].tobytes()], [None if run is None else run[i:j].tobytes()], [None])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in _by_bucket(batches):
            keys, at, chunk = _merged(blocks, width)
            for lo in range(0, len(keys), RUN_ROWS):
                k = slice(lo, lo + RUN_ROWS)
                yield batch_of(_RUN, [bucket], [-1], [len(at[k])], [keys[k].tobytes()], [at[k].tobytes()], [chunk[k].tobytes()], [None])

    n = partitions(runs.sparkSession)
    entries = arrow(runs.where("n >= 0"), split, RUN_SCHEMA).repartition(n, "bucket").sortWithinPartitions("bucket")
    return arrow(entries, merge, RUN_SCHEMA).unionByName(runs.where("n < 0"))


def repeats(runs: DataFrame, width: int, since: int = 0) -> DataFrame:
    """(k1, k2, at, old): for each row with a fingerprint that stands anywhere else too, the little-endian int32 word positions of such ones.

    Runs numbered below since are old: what repeats among them alone is no
    matter, so their rows come only with what a new run has too (and with
    what repeats inside an old run that a new one meets).

    A bucket's blocks are held together, as sorted arrays of 8 * width + 4
    bytes an entry. A fingerprint has at most one entry for each run, however
    often it stands in the corpus. The first block of a run holds its rows; it
    goes to any of the tasks, by the number of the run.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers: list[pa.RecordBatch] = []
        for _, blocks in _by_bucket(batches, headers):
            yield from headers
            headers.clear()
            keys, at, run = _merged(blocks, width)
            same = (keys[1:] == keys[:-1]).all(1)
            flag = np.zeros(len(keys), bool)
            flag[1:] |= same
            flag[:-1] |= same
            if since:
                group = np.concatenate([[0], np.cumsum(~same)]) if len(keys) else np.zeros(0, np.int64)
                flag &= np.bincount(group, run >= since)[group] > 0
            hit = np.flatnonzero(flag)
            hit = hit[np.argsort(run[hit], kind="stable")]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(run[hit])) + 1, [len(hit)]]) if len(hit) else np.zeros(1, int)
            out = [(int(run[hit[i]]), at[hit[i:j]].tobytes(), int(j - i)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            if out:
                yield batch_of(_FLAGGED, [x[0] for x in out], [x[2] for x in out], [x[1] for x in out], [None] * len(out), [None] * len(out), [None] * len(out))
        yield from headers

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, hits = None, None, []

        def told() -> Iterator[pa.RecordBatch]:
            x, y, z, known = rows
            parts = [np.frombuffer(h, np.uint32) for h in hits]
            if known and (now >= since or hits):
                parts.append(np.frombuffer(known, np.uint32))
            if not parts:
                return
            k1, k2, first = (np.frombuffer(v, np.int64) for v in (x, y, z))
            at = distinct(np.concatenate(parts)).astype(np.int64)
            row = np.searchsorted(first, at, "right") - 1
            cut = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
            for lo in range(0, len(cut) - 1, 4096):
                s, e = cut[:-1][lo : lo + 4096], cut[1:][lo : lo + 4096]
                r = row[s]
                yield batch_of(_ROWS, k1[r], k2[r], [(at[i:j] - first[q]).astype(np.int32).tobytes() for i, j, q in zip(s, e, r, strict=True)], [now < since] * len(r))

        for b in batches:
            for chunk, n, x, y, z, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n < 0:  # a run's rows come before its hits
                    if rows is not None:
                        yield from told()
                    now, rows, hits = chunk, (x, y, z, known), []
                else:
                    hits.append(x)
        if rows is not None:
            yield from told()

    n = partitions(runs.sparkSession)
    dealt = runs.repartition(n, F.when(F.col("n") < 0, F.col("chunk")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    merged = arrow(dealt, merge, "chunk long, n int, a binary, b binary, c binary, d binary")
    return arrow(merged.repartition(n, "chunk").sortWithinPartitions("chunk", "n"), by_row, "k1 long, k2 long, at binary, old boolean").dropDuplicates(["k1", "k2", "old"])
