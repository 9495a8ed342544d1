"""Fuzzy line deduplication by MinHash over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, arrow, batch_of, bucket_count, carried, cut, distinct, key_filter, mix, partitions, slices, uncarried, utf8
from .graph import components
from .runs import bucket_of

#: Characters of a shingle. A shingle of characters below 256 is a 64-bit number.
SHINGLE = 8
#: A signature has one minimum for each bin of the shingles' hashes.
BINS = 64
#: Bands and rows of a band: two lines of Jaccard 0.8 share a band with a chance above 0.98.
BANDS, ROWS = 12, 5
#: Lines of a candidate group that meet in one task; larger groups meet in blocks of so many.
BLOCK = 1024
#: Bytes of text that become numpy arrays at once; small enough for a core's cache.
SLICE = 1 << 18
#: Characters of lines that are verified at once.
HELD_CHARS = 1 << 18
#: Bands that a task holds before it sends them, sorted.
HELD_BANDS = 1 << 19
#: Lines that a task remembers to have signed, and groups that it remembers to have told.
SEEN = 1 << 18

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_EMPTY = np.uint64(2**64 - 1)
_LOW58 = np.uint64((1 << 58) - 1)

_BLOCKS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("lines", pa.binary())])
_GROUPS = pa.schema([("gid", pa.int64()), ("key", pa.int64())])
_TEXTS = pa.schema([("key", pa.int64()), ("text", pa.string())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("a_check", pa.int64()), ("b_check", pa.int64()), ("gid", pa.int64())])


class Lines:
    """The lines of a slice of texts as spans of their UTF-8 bytes, ASCII letters in lower case.

    Lines lose white space at both ends; blank ones are left out.
    """

    def __init__(self, column: pa.Array):
        data, off = utf8(column)
        self.data = _LOWER[data]
        self.raw = self.data.tobytes()
        breaks = np.flatnonzero(data == 10)
        owner = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])
        starts = np.concatenate([off[:-1], breaks + 1])
        order = np.lexsort((starts, owner))
        owner, starts = owner[order], starts[order]
        number = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(off) - 1))[owner]
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        ends = np.where(last, off[1:][owner], np.append(starts[1:] - 1, 0)[: len(owner)])
        starts, ends = self._stripped(starts, ends)
        full = ends > starts
        self.owner, self.number, self.starts, self.ends = owner[full], number[full], starts[full], ends[full]

    def _stripped(self, starts: np.ndarray, ends: np.ndarray, steps: int = 16) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = starts.copy(), ends.copy()
        for edge, by, at in ((starts, 1, 0), (ends, -1, -1)):
            todo = np.flatnonzero(starts < ends)
            for _ in range(steps):
                todo = todo[SPACE[self.data[edge[todo] + at]]]
                edge[todo] += by
                todo = todo[starts[todo] < ends[todo]]
            for k in todo.tolist():  # long runs of white space
                line = self.raw[starts[k] : ends[k]]
                edge[k] += len(line) - len(line.lstrip()) if by > 0 else len(line.rstrip()) - len(line)
        return starts, ends

    def keys(self) -> np.ndarray:
        """Two 64-bit halves of a 128-bit hash of each line's bytes."""
        raw, digest = self.raw, xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)

    def text(self, k: int) -> str:
        return self.raw[self.starts[k] : self.ends[k]].decode()

    def signatures(self, chosen: np.ndarray) -> np.ndarray:
        """One-permutation MinHash: a shingle's hash says its bin and its value; empty bins borrow from the next full one.

        Here a character above 255 counts as a byte made of it, so different
        shingles of such characters may be one; verification tells them apart.
        """
        starts, ends = self.starts[chosen], self.ends[chosen]
        chars = self.data
        if len(chars) and chars.max() >= 128:
            wide = np.flatnonzero(chars >= 0xC0)
            after = np.append(chars, np.zeros(3, np.uint8))
            code = (chars[wide] << 6) | (after[wide + 1] & 63)
            code = np.where(chars[wide] >= 0xE0, code + 37 * after[wide + 2], code)
            code = np.where(chars[wide] >= 0xF0, code + 101 * after[wide + 3], code)
            heads = (chars & 0xC0) != 0x80
            rest = np.flatnonzero(~heads)
            chars = chars.copy()
            chars[wide] = code
            chars, starts, ends = chars[heads], starts - np.searchsorted(rest, starts), ends - np.searchsorted(rest, ends)
        h = pack_shingles(chars)
        size = ends - starts
        short = np.flatnonzero(size < SHINGLE)
        h[starts[short]] &= (np.uint64(1) << (np.uint64(8) * size[short].astype(np.uint64))) - np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        # each character's line, or one more for those at which no chosen line has a shingle
        n = np.maximum(size - SHINGLE + 1, 1)
        order = np.argsort(starts)
        bounds = np.stack([starts[order], (starts + n)[order]], 1).ravel()
        runs = np.diff(np.concatenate([[0], bounds, [len(h)]]))
        which = np.full(len(runs), len(n))
        which[1::2] = order
        place = np.repeat(which << 6, runs)
        place += (h >> np.uint64(58)).view(np.int64)
        h &= _LOW58
        low = np.full((len(n) + 1) * BINS, _EMPTY)
        np.minimum.at(low, place, h)
        low = low[: len(n) * BINS]
        low = low.reshape(-1, BINS)
        for k in range(6):  # distances double, so 63 steps are covered
            other = np.roll(low, -(1 << k), axis=1)
            low = np.where((low == _EMPTY) & (other != _EMPTY), other + np.uint64(1 << (58 + k)), low)
        return low


def pack_shingles(chars: np.ndarray) -> np.ndarray:
    """At each byte the number that it and the seven after it make; zeros follow the last."""
    n = len(chars)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = chars
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(padded[k : k + len(out)].tobytes(), np.uint64)
    return out[:n]


def _bands(low: np.ndarray) -> np.ndarray:
    odd = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    weighted = mix(low[:, : BANDS * ROWS] * odd).reshape(-1, BANDS, ROWS).sum(axis=2)
    return mix(weighted + np.arange(BANDS, dtype=np.uint64))


def shingles(text: str) -> frozenset[str]:
    return frozenset(text[k : k + SHINGLE] for k in range(max(1, len(text) - SHINGLE + 1)))


class Sets:
    """The shingles of lines as numbers, equal only for equal shingles, and the exact Jaccard test of pairs of lines."""

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(size) - size
        n = np.maximum(size - SHINGLE + 1, 1)
        line = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(line)) + np.repeat(starts - (np.cumsum(n) - n), n)
        if len(points) and points.min() > 0 and points.max() < 256:  # a shingle is its own number
            packed = pack_shingles(points.astype(np.uint8))
            short = np.flatnonzero(size < SHINGLE)
            packed[starts[short]] &= (np.uint64(1) << (np.uint64(8) * size[short].astype(np.uint64))) - np.uint64(1)
            kinds = np.unique(packed[at], return_inverse=True)[1]
        else:  # eight numbers of 21 bits are three of 63
            kinds = np.zeros(len(at), np.int64)
            wide = np.append(points.astype(np.int64) + 1, np.zeros(SHINGLE, np.int64))
            left = np.minimum(np.repeat(size, n) - (at - np.repeat(starts, n)), SHINGLE)
            for first in range(0, SHINGLE, 3):
                part = np.zeros(len(at), np.int64)
                for k in range(first, min(first + 3, SHINGLE)):
                    part = (part << 21) | np.where(k < left, wide[at + k], 0)
                order = np.lexsort((part, kinds))
                new = np.ones(len(order), bool)
                new[1:] = (part[order][1:] != part[order][:-1]) | (kinds[order][1:] != kinds[order][:-1])
                kinds[order] = np.cumsum(new) - 1
        own = distinct((line << 32) | kinds)
        self.kinds = own & 0xFFFFFFFF
        self.first = np.searchsorted(own, np.arange(len(texts) + 1) << 32)
        self.size = np.diff(self.first)

    def similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the Jaccard similarity of each pair of lines reaches the given one."""
        out = np.zeros(len(a), bool)
        x, y = self.size[a], self.size[b]
        todo = np.flatnonzero(np.minimum(x, y) >= similarity * np.maximum(x, y))
        cost = np.cumsum(x[todo] + y[todo])
        for lo, hi in _stretches(cost, HELD_CHARS):
            pair = todo[lo:hi]
            lines = np.stack([a[pair], b[pair]], 1).ravel()
            n = self.size[lines]
            at = np.arange(int(n.sum())) + np.repeat(self.first[lines] - (np.cumsum(n) - n), n)
            both = np.sort((np.repeat(np.arange(len(lines)) >> 1, n) << 32) | self.kinds[at])
            common = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(pair))
            out[pair] = common >= similarity * (x[pair] + y[pair] - common)
        return out


def _stretches(total: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sum, given as running totals, is at most so much, or one entry."""
    at, done = 0, 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield at, to
        at, done = to, int(total[to - 1])


def connect(sets: Sets, groups: list[tuple[np.ndarray, np.ndarray | None]], similarity: float) -> np.ndarray:
    """For each line the first line of its component under the pairs of its group that are similar.

    A group is (left, right): pairs are those of a line of the left and one of
    the right, or, without a right, all pairs of the left. Each line that joins
    a component is compared with the lines that no component has yet, so a
    crowd of near copies costs about one comparison for each; the comparisons
    of all groups are made together.
    """
    root = np.arange(int(max((int(x.max(initial=-1)) for g in groups for x in g if x is not None), default=-1)) + 1)
    # for each group: lines left on each side, lines that wait to be compared with their side, the current component's first line
    work = [[left, right, [], -1] for left, right in groups]
    while work:
        a, b, size, asked = [], [], [], []
        going = []
        for w in work:
            left, right, queue, _ = w
            if not len(left) and (right is None or not len(right)):
                continue
            if not queue:
                if not len(left) or (right is not None and not len(right)):
                    continue
                w[3] = int(left[0])
                queue.append((w[3], 0))
                left = w[0] = left[1:]
            line, side = queue.pop()
            others = left if right is None or side else right
            going.append(w)
            asked.append((line, 0 if right is None or side else 1))
            a.append(np.full(len(others), line))
            b.append(others)
            size.append(len(others))
        if not going:
            break
        ok = sets.similar(np.concatenate(a), np.concatenate(b), similarity)
        at = np.cumsum([0, *size])
        for k, (w, (_, side)) in enumerate(zip(going, asked, strict=True)):
            hit, others = ok[at[k] : at[k + 1]], w[side]
            for x in others[hit].tolist():
                root[x] = w[3]
                w[2].append((x, side))
            w[side] = others[~hit]
        work = going
    return root


def near_line_edges(docs: DataFrame, text_col: str = "t", similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(a, b, a_check, b_check): edges between distinct lines whose Jaccard similarity is verified; they span each component.

    A line is the two halves of its 128-bit hash. In a candidate group of more
    than `block` lines each block of lines meets in a task of its own, together
    with the group's leader. Lines that are in one component with the leader
    need no more; only the others meet the other blocks. So a crowd of near
    copies costs a row for each line, and none of its pairs is lost.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = bucket_count(docs)
    rows = docs.select(F.col(text_col).alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, held = [], [], 0
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            k, v = np.concatenate(keys), np.concatenate(lines)
            order = np.argsort(k)
            k, v = k[order], v[order]
            which = bucket_of(k, buckets)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(k)]])
            s, e = edge[:-1], edge[1:]
            short = k.astype(np.uint32)  # the bucket is known by the upper bits
            for lo in range(0, len(s), 256):
                part = list(zip(s[lo : lo + 256].tolist(), e[lo : lo + 256].tolist(), strict=True))
                yield batch_of(_BLOCKS, [int(which[i]) for i, _ in part], [short[i:j].tobytes() for i, j in part], [v[i:j].tobytes() for i, j in part])

        for batch in batches:
            for part in slices(batch, "t", SLICE):
                x = Lines(part.column("t"))
                key, at = np.unique(x.keys()[:, 0], return_index=True)
                fresh = np.fromiter((k not in seen for k in key.tolist()), bool, len(key))
                key, at = key[fresh], at[fresh]
                if not len(key):
                    continue
                if len(seen) > SEEN:
                    seen.clear()  # it only saves work
                seen.update(key.tolist())
                band = _bands(x.signatures(at))
                keys.append(band.ravel())
                lines.append(np.repeat(key.view(np.int64), BANDS))
                held += band.size
                if held > HELD_BANDS:
                    yield from flush()
                    keys, lines, held = [], [], 0
        if keys:
            yield from flush()

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        told: set[int] = set()
        now = None

        def groups() -> Iterator[pa.RecordBatch]:
            k = np.concatenate([np.frombuffer(x, np.uint32) for x, _ in held])
            v = np.concatenate([np.frombuffer(y, np.int64) for _, y in held])
            held.clear()
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
            k, v = k[new], v[new]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(k.astype(np.int64))) + 1, [len(k)]])
            size = np.diff(edge)
            total = np.zeros(len(v) + 1, np.uint64)
            np.cumsum(mix(v.view(np.uint64)), out=total[1:])
            gid = mix(total[edge[1:]] - total[edge[:-1]]).view(np.int64)  # groups of the same lines are one group
            fresh = size > 1
            fresh[fresh] = [g not in told for g in gid[fresh].tolist()]
            if len(told) > SEEN:
                told.clear()
            told.update(gid[fresh].tolist())
            many = np.repeat(fresh, size)
            g, v = np.repeat(gid, size)[many], v[many]
            for lo in range(0, len(v), 1 << 16):
                yield batch_of(_GROUPS, g[lo : lo + (1 << 16)], v[lo : lo + (1 << 16)])

        for b in batches:
            for bucket, k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and bucket != now:
                    yield from groups()
                now = bucket
                held.append((k, v))
        if held:
            yield from groups()

    signed = arrow(rows, sign, "bucket int, keys binary, lines binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    groups = cut(arrow(signed, collide, "gid long, key long").distinct())
    if groups.limit(1).count() == 0:
        return spark.createDataFrame([], "a long, b long, a_check long, b_check long")
    wanted = spark.sparkContext.broadcast(key_filter(groups.select("key")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, seen = wanted.value, set()
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                x = Lines(part.column("t"))
                key, at = np.unique(x.keys()[:, 0], return_index=True)
                hit = may.may_hold(key)
                hit[hit] = np.fromiter((k not in seen for k in key[hit].tolist()), bool, int(hit.sum()))
                key, at = key[hit], at[hit]
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(key.tolist())
                if len(key):
                    yield batch_of(_TEXTS, key.view(np.int64), [x.text(k) for k in at.tolist()])

    texts = arrow(rows, fetch, "key long, text string")
    texts = cut(texts.dropDuplicates(["key"]))  # a few that the filter let pass meet no group
    sizes = cut(groups.groupBy("gid").agg(F.count("*").alias("n"), F.min("key").alias("leader")).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")))
    own = F.pmod(F.xxhash64("key", "gid"), F.col("blocks")).cast("int")
    large = sizes.where("blocks > 1")
    members = groups.join(sizes, "gid").select("gid", "key", own.alias("q"), F.when(F.col("blocks") > 1, F.col("leader")).alias("leader"))
    leaders = large.select("gid", F.col("leader").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), "leader")

    def met(rows: DataFrame, *tile: str) -> DataFrame:
        return rows.join(texts, "key").repartition(n, *tile).sortWithinPartitions(*tile)

    def tiles(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[dict[str, list]]]:
        """Whole tiles, several of them at once, as columns; names are those that tell tiles apart."""
        held: list[dict[str, list]] = []
        chars, now, one = 0, None, None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in names), strict=True))
            columns = {c: b.column(c).to_pylist() for c in b.schema.names}
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s == e:
                    continue
                if keys[s] != now:
                    if chars > HELD_CHARS:
                        yield held
                        held, chars = [], 0
                    now, one = keys[s], {c: [] for c in columns}
                    held.append(one)
                for c, v in columns.items():
                    one[c] += v[s:e]
                chars += sum(map(len, columns["text"][s:e]))
        if held:
            yield held

    def told(key: list[int], text: list[str], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        check = [int.from_bytes(xxhash.xxh3_128_digest(t.encode())[8:], "little", signed=True) for t in text]
        at, to = a.tolist(), b.tolist()
        return batch_of(_FOUND, [key[k] for k in at], [key[k] for k in to], [check[k] for k in at], [check[k] for k in to], [None] * len(at))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in tiles(batches, ("gid", "q")):
            key, text, places = [], [], []
            for t in held:
                once = dict(zip(t["key"], t["text"], strict=True))  # the leader may be here twice
                places.append(np.arange(len(key), len(key) + len(once)))
                key += once.keys()
                text += once.values()
            root = connect(Sets(text), [(p, None) for p in places], similarity)
            on = np.flatnonzero(root != np.arange(len(root)))
            if len(on):
                yield told(key, text, on, root[on])
            for t, p in zip(held, places, strict=True):
                if t["leader"][0] is not None:
                    mine = root[p]
                    lead = mine[[key[k] for k in p.tolist()].index(t["leader"][0])]
                    rest = [key[k] for k in p[mine != lead].tolist()]
                    yield batch_of(_FOUND, rest, *[[None] * len(rest)] * 3, [t["gid"][0]] * len(rest))

    def verify_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in tiles(batches, ("gid", "p", "q")):
            key, text, places = [], [], []
            for t in held:
                left = {k: x for k, x, s in zip(t["key"], t["text"], t["side"], strict=True) if not s}
                right = {k: x for k, x, s in zip(t["key"], t["text"], t["side"], strict=True) if s}
                places.append((np.arange(len(key), len(key) + len(left)), np.arange(len(key) + len(left), len(key) + len(left) + len(right))))
                key += [*left, *right]
                text += [*left.values(), *right.values()]
            root = connect(Sets(text), places, similarity)
            on = np.flatnonzero(root != np.arange(len(root)))
            on = on[[key[a] != key[b] for a, b in zip(on.tolist(), root[on].tolist(), strict=True)]]
            if len(on):
                yield told(key, text, on, root[on])

    out = "a long, b long, a_check long, b_check long, gid long"
    found = cut(arrow(met(members.unionByName(leaders), "gid", "q"), verify, out))
    edges = found.where("b is not null")
    rest = found.where("gid is not null").select("gid", F.col("a").alias("key"))
    if rest.limit(1).count():
        many = rest.groupBy("gid").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts")).join(large.select("gid", "blocks"), "gid")
        left = rest.join(many, "gid").select("gid", "key", F.pmod(F.xxhash64("gid", "key"), F.col("parts")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q"), F.lit(0).alias("side"))
        right = members.where("leader is not null").join(many.select("gid", "parts"), "gid").select("gid", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "q", F.lit(1).alias("side"))
        edges = edges.unionByName(arrow(met(left.unionByName(right), "gid", "p", "q"), verify_rest, out))
    return cut(edges.drop("gid"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, carry: list[str] = []) -> DataFrame:
    """(id_col, n_lines, n_removed, kept_text, *carry) for every row of docs.

    Lines are what newlines part. Two lines are the same if they are equal
    without white space at their ends and with A-Z in lower case, or if their
    sets of 8-character shingles have a Jaccard similarity of at least
    `similarity`; the sameness is transitive. Of all same lines of the corpus
    the first stays, by id and then by place; the others go, each with its
    newline. Blank lines always stay. Near lines are found by one-permutation
    MinHash in 12 bands of 5 and each link is verified on the lines' texts;
    equal lines are known by a 128-bit hash of their bytes.

    A null text has no lines and stays null; an empty one has one blank line.
    Lines of a row whose id is null come after all others. Rows with equal id
    are one document to this operator if their texts are equal too, and keep
    the same lines; rows with equal id and other texts count by id and place.
    Other columns are not read. No rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns, names, kinds = carried(docs, carry)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), *columns).withColumns({"k1": F.xxhash64("i"), "k2": F.xxhash64("t")})

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", SLICE):
                x = Lines(part.column("t"))
                at, keys = pa.array(x.owner), x.keys().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), part.column("i").take(at), part.column("k1").take(at), part.column("k2").take(at), pa.array(x.number.astype(np.int32))], names=["key", "check", "i", "k1", "k2", "line"])

    same = ["key", "check"]
    lines = cut(arrow(rows.select("i", "t", "k1", "k2"), occur, f"key long, check long, i {kind}, k1 long, k2 long, line int"))
    counts = lines.groupBy(*same).agg(F.count("*").alias("n"))
    edges = near_line_edges(rows, "t", similarity)
    checks = edges.select(F.col("a").alias("key"), F.col("a_check").alias("check")).union(edges.select("b", "b_check")).distinct()
    roots = checks.join(components(edges.select("a", "b")).withColumnRenamed("id", "key"), "key")
    known = counts.join(roots, same, "left").where("n > 1 or root is not null")
    # a line without near ones is a group of its own; no root has a check, so the two kinds of groups don't mix
    alone = F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0))
    place = F.struct(F.col("i").isNull().alias("last"), F.col("i"), F.col("line"), F.col("k2"))
    several = cut(lines.join(known, same).select(F.coalesce("root", "key").alias("group"), alone.alias("alone"), F.col("root").isNull().alias("single"), "k1", "k2", "line", place.alias("place")))
    group = ["group", "alone", "single"]
    keep = several.groupBy(*group).agg(F.min("place").alias("first"))
    gone = several.join(keep, group).where(~F.col("place").eqNullSafe(F.col("first")))
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "t"):
                total, removed, kept = [], [], []
                for t, g in zip(part.column("t").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    if t is None:
                        n, g, text = 0, [], None
                    elif not g:
                        n, g, text = t.count("\n") + 1, [], t
                    else:
                        split, out = t.split("\n"), set(g)
                        n, text = len(split), "\n".join([x for k, x in enumerate(split) if k not in out])
                    total.append(n)
                    removed.append(len(g))
                    kept.append(text)
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *(part.column(n) for n in names)], names=["i", "n_lines", "n_removed", "kept_text", *names])

    return uncarried(arrow(rows.join(gone, ["k1", "k2"], "left").select("i", "t", "gone", *names), rebuild, f"i {kind}, n_lines long, n_removed long, kept_text string{kinds}"), carry, i=id_col)
