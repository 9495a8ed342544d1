"""What the corpus operators share: checkpoints, Arrow batches, words as byte spans.

Texts reach Python in Arrow batches and are handled as one byte array with
offsets wherever numpy can do the work, so a batch costs a few vector passes
and not a Python call for each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoint import cut  # noqa: F401  the operators take it from here
from ..sources.ship import ship

#: Bytes of text that a task turns into numpy arrays at once.
CHUNK_BYTES = 2 << 20

#: The white space of the word rules: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with the package shipped and batches held to a few MB."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(fn, schema)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many rows and bytes of text, or one row."""
    if batch.num_rows == 0:
        return
    _, off = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each row the index of its first word (one more at the end).

    inside: for each of the 256 bytes, whether it belongs to a word. Words
    never reach over the end of a row.
    """
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = inside[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    edges = off[(off > 0) & (off < len(data))]
    before[edges] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def split_words(column: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words between white space of all texts, one after the other, and the number of each text's first (one more at the end); null counts as empty."""
    column = pc.fill_null(column, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    flat, first = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    first = first - first[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end parts an empty word off
    if not full.all():
        first = np.concatenate([[0], np.cumsum(full)])[first]
        flat = flat.filter(pa.array(full))
    return flat, first


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x ^= x >> np.uint64(33)
    x *= M2
    x ^= x >> np.uint64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of x in order, by a sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Rolling:
    """Sums of values weighted by the powers of an odd base, modulo 2**64.

    The sum over any span, shifted to its start, depends on the span's values
    alone, so the hashes of all spans come from one running sum.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
        self.base = int(rng.integers(0, 2**61, dtype=np.uint64)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n + 1:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n + 1, b, np.uint64)
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                setattr(self, name, p)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hashes of values[start:end] for each span."""
        n = len(values)
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        return mix(h ^ mix((ends - starts).astype(np.uint64)))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans of words."""
        return self.spans(self.table[data], starts, ends)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest vertex of its component, given the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def sample_by_class(rows: DataFrame, label: str, key: str, each: int, parts: int = 1 << 20) -> DataFrame:
    """About `each` rows of each class, or all it has: a fixed choice by hash of the key, so it needs no sort.

    Only the number of rows of each class is counted, and joined to the rows.
    The counts are written first, so Spark knows their size when it chooses
    how to join: the rows move only if the classes are too many to be sent.
    """
    counts = cut(rows.groupBy(label).agg(F.count("*").alias("class_rows")))
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.col("class_rows"))
    return rows.join(counts, label).where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(parts)) < share * parts).drop("class_rows")


#: Bits of a filter for each key, and its most bits in all (64 MB); a fuller filter lets more rows pass, and loses none.
BITS_EACH, MOST_BITS = 16, 1 << 29
_FILTER_PARTS = 64
_BITS = pa.schema([("part", pa.int32()), ("bits", pa.binary())])


class KeyFilter:
    """A bit for each hash of a set of 64-bit keys: says that a key surely isn't in the set, or may be."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        spot = mix(keys.view(np.uint64)) % np.uint64(len(self.bits) * 8)
        return (self.bits[(spot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (spot & np.uint64(7)).astype(np.uint8))) & 1 == 1


def key_filter(keys: DataFrame) -> KeyFilter:
    """The filter of the only column, of longs, of keys. Its size follows the number of keys up to MOST_BITS."""
    spark = keys.sparkSession
    size = 1 << 16
    most = keys.count() * BITS_EACH
    while size < min(most, MOST_BITS):
        size *= 2
    part = size // _FILTER_PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[(mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(size)).astype(np.int64)] = True
        for k, p in enumerate(bits.reshape(_FILTER_PARTS, -1)):
            at = np.flatnonzero(p)
            if len(at):
                packed = np.packbits(p)
                yield batch_of(_BITS, [k], [packed.tobytes()] if len(at) * 4 >= len(packed) else [at.astype(np.uint32).tobytes()])

    def join_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = parts.setdefault(k, np.zeros(part, bool))
                if len(raw) == part // 8:
                    p |= np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
                else:
                    p[np.frombuffer(raw, np.uint32)] = True
        for k, p in parts.items():
            yield batch_of(_BITS, [k], [np.packbits(p).tobytes()])

    n = min(partitions(spark), 32)
    marks = arrow(keys.repartition(n), mark, "part int, bits binary").repartition(n, "part")
    bits = np.zeros((_FILTER_PARTS, part // 8), np.uint8)
    for r in arrow(marks, join_marks, "part int, bits binary").collect():
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    return KeyFilter(bits.ravel())


def bucket_count(df: DataFrame, each: int = 16 << 20) -> int:
    """Buckets for what is made of df, so that one of them holds what about `each` bytes of df make, whatever df's size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 55 else 0  # what Spark can't tell it takes for endless
    return max(4 * partitions(df.sparkSession), -(-known // each))


def carried(docs: DataFrame, carry: list[str]) -> tuple[list[Column], list[str], str]:
    """Columns that go through an operator as they are, under names of its own: the columns, those names, and their types for a schema."""
    names = [f"carry{k}" for k in range(len(carry))]
    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))
    return [F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], names, kinds


def uncarried(df: DataFrame, carry: list[str], **renamed: str) -> DataFrame:
    """df with its carried columns, and others, under their final names."""
    return df.withColumnsRenamed({f"carry{k}": c for k, c in enumerate(carry)} | renamed)
