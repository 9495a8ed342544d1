"""Exact removal of repeated word windows over a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Rolling, arrow, bucket_count, cut, key_filter, slices, utf8, word_spans
from .runs import BATCH, RUN_SCHEMA, RunWriter, repeats
from .runstore import TEXTS, RunStore

#: Words of the short fingerprints of which each window selects its smallest.
GRAM = 8

_WORD, _GRAM = Rolling(11), Rolling(12)
_TOP = np.uint64(2**64 - 1)
#: Seed of the 128-bit hash of a window's bytes.
_SEED = 0x5EED


def _slide(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over each n consecutive values; len(x) - n + 1 results."""
    width = 1
    while 2 * width <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = utf8(part.column("t"))
    starts, ends, first = word_spans(data, off, ~SPACE)
    return data, starts, ends, first, _WORD.words(data, starts, ends)


def _grams(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short fingerprints at each word, the smallest of each window, and whether a window starts there; rows don't mix."""
    n = len(words)
    gram = min(GRAM, window)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n - gram + 1)
    grams = _GRAM.spans(words, at, at + gram)
    low = _slide(grams, window - gram + 1, np.minimum)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words left in the row
    return grams, low, left[: n - window + 1] >= window


def _anchors(grams: np.ndarray, low: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Words at which a short fingerprint stands that some window selects."""
    span = window - min(GRAM, window) + 1
    padded = np.zeros(len(low) + 2 * (span - 1), np.uint64)
    padded[span - 1 : span - 1 + len(low)] = np.where(whole, low, np.uint64(0))
    return np.flatnonzero(_slide(padded, span, np.maximum)[: len(grams)] == grams)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, keep_text: bool = True, store: RunStore | None = None) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept]) for every row of docs.

    A word goes if a window of so many words covers it whose words also start
    anywhere else, in the same text or another. Every corpus split becomes
    sorted runs of window fingerprints; merging all runs finds those that
    repeat. It is done in two rounds. First each window selects the smallest
    64-bit fingerprint of its 8-word pieces: equal windows select equal ones,
    so a window all of whose selection stands nowhere else repeats nowhere.
    The windows left are verified by 128-bit hashes of all their bytes.

    Null, empty and short texts have nothing to remove; a null has no words.
    Rows with equal id and text get equal results. No rows give no rows. Other
    columns of docs are not read.

    docs are the next batch of the store: their runs are merged with the runs
    of all batches before, windows that stand there are repeats too, and the
    batch joins the store. What was told of earlier batches stays as it was.
    Without a store they are the only batch of a new one, which goes when the
    application ends.
    """
    store = store or RunStore.scratch(docs.sparkSession)
    past = store.state(window, bucket_count(docs))
    buckets, base = past.buckets, past.batches * BATCH
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).withColumns({"k1": F.xxhash64("i"), "k2": F.xxhash64("t")})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = RunWriter(buckets, 1, base)
        for batch in batches:
            for part in slices(batch, "t"):
                _, _, _, first, words = _words(part)
                grams, low, whole = _grams(words, first, window)
                at = _anchors(grams, low, whole, window) if len(grams) else np.zeros(0, np.int64)
                yield from out.add(grams[at].reshape(-1, 1), at, part.column("k1").to_numpy(), part.column("k2").to_numpy(), first)
        yield from out.flush()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest = RunWriter(buckets, 2), xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch, "t"):
                _, starts, ends, first, words = _words(part)
                grams, low, whole = _grams(words, first, window)
                if not len(grams):
                    continue
                found = np.full(len(grams), _TOP)
                for from_, at in zip(first.tolist(), part.column("at").to_pylist(), strict=False):
                    p = np.frombuffer(at, np.int32) + from_
                    found[p] = grams[p]
                at = np.flatnonzero(whole & (_slide(found, window - min(GRAM, window) + 1, np.minimum) == low))
                keys, sizes = [], ends - starts + 1
                cut_at = np.searchsorted(at, first)
                for raw, w, v, lo, hi in zip(_raw(part), first[:-1].tolist(), first[1:].tolist(), cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True):
                    if lo == hi:
                        continue
                    line, place = b" ".join(raw.split()), np.concatenate([[0], np.cumsum(sizes[w:v])])
                    s = at[lo:hi] - w
                    keys += [digest(line[a:b], _SEED) for a, b in zip(place[s].tolist(), (place[s + window] - 1).tolist(), strict=True)]
                keys = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
                yield from out.add(keys, at, part.column("k1").to_numpy(), part.column("k2").to_numpy(), first)
        yield from out.flush()

    def kept_of(raw: bytes, at: bytes | None) -> tuple[int, int, bytes]:
        """A text's words, how many of them go, and the others."""
        words = raw.split()
        if at is None:
            return len(words), 0, b" ".join(words)
        cover, p = np.zeros(len(words) + 1, np.int64), np.frombuffer(at, np.int32)
        np.add.at(cover, p, 1)
        np.add.at(cover, p + window, -1)
        hit = np.cumsum(cover[:-1]) > 0
        return len(words), int(hit.sum()), b" ".join([w for w, h in zip(words, hit.tolist(), strict=True) if not h])

    def results(raw: list[bytes], at: list[bytes | None]) -> list[pa.Array]:
        done = [kept_of(x, p) for x, p in zip(raw, at, strict=True)]
        kept = [x.decode() for _, _, x in done] if keep_text else [None] * len(done)
        return [pa.array([n for n, _, _ in done], pa.int64()), pa.array([g for _, g, _ in done], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for _, _, x in done], pa.string()), pa.array(kept, pa.string())]

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("k1"), part.column("k2"), *results(_raw(part), [None] * part.num_rows)], names=["i", "k1", "k2", *names])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.may_hold(batch.column("k2").to_numpy())))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), *results(_raw(part), part.column("at").to_pylist())], names=["k1", "k2", *names])

    kind, names = docs.schema[id_col].dataType.simpleString(), ["n_words", "n_removed", "kept_sha256", "kept"]
    out = "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, kept string"
    # fewer bytes than this hold no window
    added = store.write(arrow(rows.select("t", "k1", "k2"), index, RUN_SCHEMA), rows.where(F.octet_length("t") >= 2 * window - 1).select("k1", "k2", "t"))
    suspects = cut(repeats(store.runs(past.runs + added.runs), 1, base))
    first = suspects.where("not old").drop("old")
    # only texts that may share something move
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(first.select("k2")))
    open_ = cut(arrow(store.texts(added.texts), sift, TEXTS).join(first, ["k1", "k2"]).dropDuplicates(["k1", "k2"]))
    doubtful = open_.select("t", "k1", "k2", "at")
    if base:
        doubtful = doubtful.unionByName(store.texts(past.texts).join(suspects.where("old"), ["k1", "k2"]).select("t", "k1", "k2", "at"))
    second = cut(repeats(arrow(doubtful, verify, RUN_SCHEMA), 2).drop("old"))
    store.commit(past, added)
    done = arrow(open_.drop("at").join(second, ["k1", "k2"]).select("k1", "k2", "t", "at"), finish, out).withColumnsRenamed({c: f"__{c}" for c in names})
    result = arrow(rows, plain, f"i {kind}, {out}").join(done, ["k1", "k2"], "left")
    result = result.select(F.col("i").alias(id_col), *(F.coalesce(f"__{c}", c).alias(c) for c in names))
    return result if keep_text else result.drop("kept")


def _raw(part: pa.RecordBatch) -> list[bytes]:
    data, off = utf8(part.column("t"))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
