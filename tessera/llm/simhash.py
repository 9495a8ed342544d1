"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch_of, cut, distinct, local_components, partitions, slices, utf8
from .graph import components

#: Fingerprints of a tile, and tiles that travel together.
TILE, BLOCK = 2048, 16
#: A fingerprint's population counts are taken over four fields of 16 bits.
FIELDS = 4
SIDE = 17


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42, block: int = 1 << 17) -> int:
    """SimHash of a UTF-8 text: ASCII lower case, words between white space, shingles of so many words.

    Fewer words make one shingle; none give 0. Long texts are counted in blocks.
    """
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    s, e = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, block):
        h = np.array([digest(line[a:b], seed) for a, b in zip(s[at : at + block], e[at : at + block], strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_ = np.flatnonzero(2 * counts > n)
    return sum(1 << int(k) for k in set_)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp): the 64 bits as a signed long. Null or wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                data, off = utf8(part.column("t"))
                raw = data.tobytes()
                fp = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(fp.view(np.int64))], names=["i", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return arrow(rows, run, f"i {kind}, fp long").withColumnRenamed("i", id_col)


def field_counts(fp: np.ndarray) -> np.ndarray:
    """The population counts of the four 16-bit fields. Each differs by at most as many as the fingerprints' bits do, all four together."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, FIELDS)).astype(np.int64)


def field_key(fp: np.ndarray) -> np.ndarray:
    """The population counts of the four fields as one number below 17**4."""
    c = field_counts(fp)
    return ((c[:, 0] * SIDE + c[:, 1]) * SIDE + c[:, 2]) * SIDE + c[:, 3]


class Plan:
    """The tiles of fingerprints by their field keys, made from the histogram of keys (at most 17**4 rows).

    Rare keys share a tile, a key with more rows than a tile holds gets
    several. A tile's box, the least and largest count of each field, says
    which others may hold a neighbour of its fingerprints.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, radius: int, tile: int = TILE, block: int = BLOCK):
        self.radius, self.block = radius, block
        self.first, self.many = np.zeros(SIDE**FIELDS, np.int64), np.ones(SIDE**FIELDS, np.int64)
        at, filled = -1, tile
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            if n > tile:
                need = -(-n // tile)
                self.first[k], self.many[k] = at + 1, need
                at, filled = at + need, tile
            else:
                if filled + n > tile:
                    at, filled = at + 1, 0
                self.first[k], filled = at, filled + n
        where = np.stack(np.unravel_index(keys, (SIDE,) * FIELDS), 1).astype(np.int8)
        own, tiles = np.repeat(where, self.many[keys], axis=0), np.concatenate([np.arange(self.first[k], self.first[k] + self.many[k]) for k in keys])
        self.box = self._boxes(tiles, own, own, at + 1)
        self.block_box = self._boxes(np.arange(at + 1) // block, *self.box, -(-(at + 1) // block))

    @staticmethod
    def _boxes(group: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.full((n, FIELDS), SIDE, np.int8), np.full((n, FIELDS), -1, np.int8)
        np.minimum.at(out[0], group, low)
        np.maximum.at(out[1], group, high)
        return out

    def home(self, fp: np.ndarray) -> np.ndarray:
        """The tile of each fingerprint."""
        keys = field_key(fp)
        return self.first[keys] + (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.many[keys]

    def reach(self, low: np.ndarray, high: np.ndarray, boxes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether the counts between low and high, and those in each box, differ by no more than the radius."""
        gap = np.maximum(0, np.maximum(low - boxes[1], boxes[0] - high).astype(np.int64))
        return gap.sum(axis=-1) <= self.radius


def _near(a: np.ndarray, b: np.ndarray, radius: int, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a and b that differ in at most radius bits, by exclusive-or and bit counts."""
    left, right, step = [], [], max(1, cells // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        left.append(i + at)
        right.append(j)
    z = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (z, z)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_DEALT = pa.schema([("block", pa.int64()), ("tiles", pa.binary()), ("fps", pa.binary())])
_TILES = pa.schema([("s", pa.int64()), ("t", pa.int64()), ("tile", pa.int64()), ("fps", pa.binary()), ("roots", pa.binary())])


def links(prints: DataFrame, radius: int = 3, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span the components of the distinct fingerprints prints(fp).

    Every fingerprint lives in a tile; a tile travels as one binary value,
    with the component of each of its fingerprints inside the tile. Blocks of
    tiles meet in pairs, if their boxes are within the radius, and of their
    tiles those whose boxes are, and of those the fingerprints that are. Only
    links between components are told, so a crowd of near copies doesn't give
    all its pairs.
    """
    spark = prints.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIDE**FIELDS, np.int64)
        for b in batches:
            np.add.at(total, field_key(b.column(0).to_numpy().astype(np.int64)), 1)
        k = np.flatnonzero(total)
        yield batch_of(_EDGES, k, total[k])

    hist = arrow(prints.select("fp"), keyed, "a long, b long").groupBy("a").agg(F.sum("b").alias("n")).orderBy("a").toPandas()
    if not len(hist):
        return spark.createDataFrame([], "a long, b long")
    shared = spark.sparkContext.broadcast(Plan(hist["a"].to_numpy(), hist["n"].to_numpy(), radius, tile, block))  # some bytes for each tile

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            fps = b.column(0).to_numpy().astype(np.int64)
            home = plan.home(fps)
            order = np.argsort(home, kind="stable")
            home, fps = home[order], fps[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(home // plan.block)) + 1, [len(home)]]) if len(home) else np.zeros(1, int)
            parts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            if parts:
                yield batch_of(_DEALT, [int(home[s]) // plan.block for s, _ in parts], [home[s:e].tobytes() for s, e in parts], [fps[s:e].tobytes() for s, e in parts])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        now = None

        def packed() -> Iterator[pa.RecordBatch]:
            plan = shared.value
            home, fps = (np.concatenate([np.frombuffer(x[k], np.int64) for x in held]) for k in (0, 1))
            held.clear()
            order = np.argsort(home, kind="stable")
            home, fps = home[order], fps[order].view(np.uint64)
            at = np.concatenate([[0], np.flatnonzero(np.diff(home)) + 1, [len(home)]])
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                house, here = fps[s:e], int(home[s])
                i, j = _near(house, house, plan.radius)
                root = local_components(len(house), i[i < j], j[i < j]).astype(np.uint32)
                meets = np.flatnonzero(plan.reach(plan.box[0][here], plan.box[1][here], plan.block_box))
                for other in meets.tolist():
                    yield batch_of(_TILES, [min(now, other)], [max(now, other)], [here], [house.tobytes()], [root.tobytes()])

        for b in batches:
            for k, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and k != now:
                    yield from packed()
                now = k
                held.append((x, y))
        if held:
            yield from packed()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        now = None

        def met() -> Iterator[pa.RecordBatch]:
            plan, (s, t) = shared.value, now
            counts = [field_counts(fps) for _, fps, _ in held]
            for x, (a, fps, root) in enumerate(held):
                if s == t:
                    own = np.flatnonzero(root != np.arange(len(root)))
                    if len(own):
                        yield batch_of(_EDGES, fps[own].view(np.int64), fps[root[own]].view(np.int64))
                for y in range(x + 1, len(held)):
                    b, others, roots = held[y]
                    if (s != t and a // plan.block == b // plan.block) or not plan.reach(plan.box[0][a], plan.box[1][a], (plan.box[0][b], plan.box[1][b])):
                        continue
                    p = np.flatnonzero(plan.reach(counts[x], counts[x], (plan.box[0][b], plan.box[1][b])))
                    q = np.flatnonzero(plan.reach(counts[y], counts[y], (plan.box[0][a], plan.box[1][a])))
                    i, j = _near(fps[p], others[q], plan.radius)
                    if len(i):
                        pair = distinct(root[p[i]].astype(np.int64) << 32 | roots[q[j]])
                        yield batch_of(_EDGES, fps[pair >> 32].view(np.int64), others[pair & 0xFFFFFFFF].view(np.int64))

        for b in batches:
            for s, t, here, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (s, t) != now:
                    yield from met()
                    held.clear()
                now = (s, t)
                held.append((here, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint32)))
        if held:
            yield from met()

    n = partitions(spark)
    blocks = arrow(prints.select("fp"), deal, "block long, tiles binary, fps binary").repartition(n, "block").sortWithinPartitions("block")
    tiles = arrow(blocks, pack, "s long, t long, tile long, fps binary, roots binary").repartition(n, "s", "t").sortWithinPartitions("s", "t", "tile")
    return arrow(tiles, compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    fingerprint: 16 lower-case hex digits. component_id: the smallest id among
    all documents reachable by links of at most radius differing bits. Null,
    empty and wordless texts have fingerprint zero and link like any other.
    Repeated rows each get a row. Ids may be of any type with an order. A null id never becomes a component_id
    unless no document of the component has another. Other columns of docs are
    not read. No documents give no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(links(distinct, radius))
    placed = cut(distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lows, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
