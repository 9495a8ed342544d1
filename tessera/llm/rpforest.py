"""Embedding near-duplicates by a forest of random-projection trees."""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch_of, cut, local_components, mix, partitions
from .graph import components

TREES = 6
#: Rows that a leaf should hold. Fuller leaves, whose rows no split parts, are compared in blocks.
LEAF = 16
#: Rows that meet in a task: leaves of one subtree of about so many rows travel together, larger ones in blocks.
TILE = 1024
#: Rows of a label that its trees are fitted on, at most about so many.
FIT_ROWS = 4096
#: Where a tree is fitted on a part of its rows, a split needs so many; below, one list of splits serves all branches.
NODE_ROWS = 64
#: Directions of a tree, and how many of them a node tries.
DIRECTIONS, TRIES = 32, 4
#: A split that sends more than this share of the rows to both sides is none.
MOST_SPILL = 0.4
#: Rows of a label that one task deals out.
DEAL_ROWS = 1 << 14

_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
_MODELS = pa.schema([("group", pa.int64()), ("forest", pa.binary())])


def unit_vectors(col: pa.Array) -> tuple[list[np.ndarray | None], list[bytes | None]]:
    """Each vector in double precision at length 1, and its bytes; None if it is null, empty, zero or holds a null or non-finite component."""
    unit, raw = [], []
    flat, off = col.flatten(), np.asarray(col.offsets if col.offset == 0 else pa.array(np.asarray(col.offsets)))
    off = off - off[0] if len(off) else off
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        x = values[a:b]
        top = np.abs(x).max(initial=0.0)
        ok = valid[k] and b > a and np.isfinite(x).all() and top > 0
        y = x / top if ok else x  # keeps the norm of very small or large components finite
        unit.append(y / np.sqrt(y @ y) if ok else None)
        raw.append(x.tobytes() if ok else None)
    return unit, raw


def _matrix(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@functools.lru_cache(16)
def directions(dim: int, trees: int, seed: int = 3) -> np.ndarray:
    """Random unit vectors, trees x DIRECTIONS x dim: the same in every task."""
    d = np.random.default_rng(seed).standard_normal((trees, DIRECTIONS, dim))
    return d / np.linalg.norm(d, axis=2, keepdims=True)


@dataclass
class Tree:
    """Nodes with the direction and the value they split at; child is the first of two, or -1 at a leaf.

    rows is what a node is thought to hold. A leaf of a tree that was fitted
    on a part of its rows may have a tail: further splits, all of them for
    all branches.
    """

    direction: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    child: list[int] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    tail: dict[int, list[tuple[int, float]]] = field(default_factory=dict)


class Forest:
    """Random-projection trees over the vectors of one label, fitted on a sample of them.

    A node tries some directions and splits at the median of the one that
    sends the fewest rows to both sides. Rows within the margin of a split go
    to both sides.
    """

    def __init__(self, sample: np.ndarray, total: int, trees: int, margin: float, leaf: int, tile: int):
        self.margin, self.leaf, self.tile, self.total = margin / math.sqrt(sample.shape[1]), leaf, tile, total
        whole = len(sample) >= total
        self.trees = []
        for t in range(trees):
            proj = sample @ directions(sample.shape[1], trees)[t].T
            tree = Tree()
            todo = [self._node(tree, len(sample) / len(sample) * total) + (np.arange(len(sample)),)]
            while todo:
                at, level, rows = todo.pop()
                if tree.rows[at] <= leaf or level >= DIRECTIONS:
                    continue
                if not whole and len(rows) < NODE_ROWS:
                    best = [x for x in (self._split(proj[rows], k) for k in range(DIRECTIONS)) if x is not None]
                    tree.tail[at] = [(k, v) for _, k, v in sorted(best)[: math.ceil(math.log2(tree.rows[at] / leaf))]]
                    continue
                tries = [(at * TRIES + k) % DIRECTIONS for k in range(TRIES)]
                found = min((x for x in (self._split(proj[rows], k) for k in tries) if x is not None), default=None)
                if found is None:
                    continue
                _, k, value = found
                gap = proj[rows, k] - value
                tree.direction[at], tree.value[at], tree.child[at] = k, value, len(tree.child)
                for side in (gap <= self.margin, gap >= -self.margin):
                    part = rows[side]
                    todo.append(self._node(tree, tree.rows[at] * len(part) / len(rows), level + 1) + (part,))
            self.trees.append(tree)

    @staticmethod
    def _node(tree: Tree, rows: float, level: int = 0) -> tuple[int, int]:
        for x, v in ((tree.direction, 0), (tree.value, 0.0), (tree.child, -1), (tree.rows, rows)):
            x.append(v)
        return len(tree.child) - 1, level

    def _split(self, proj: np.ndarray, k: int) -> tuple[float, int, float] | None:
        value = float(np.median(proj[:, k]))
        spill = float((np.abs(proj[:, k] - value) <= self.margin).mean())
        return (spill, k, value) if spill <= MOST_SPILL else None

    def leaves(self, x: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, tile): the leaves of each row in all trees, and with which leaves each travels."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        base = mix(np.array([group], np.int64).view(np.uint64))
        for t, tree in enumerate(self.trees):
            proj = x @ directions(x.shape[1], len(self.trees))[t].T
            direction, value, child, size = np.array(tree.direction), np.array(tree.value), np.array(tree.child), np.array(tree.rows)
            code = mix(base ^ mix((np.uint64(t + 1) << np.uint64(40)) + np.arange(len(child), dtype=np.uint64)))
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            # a label that fits into a tile travels at once, with all its trees
            tile = np.full(len(x), base[0]) if self.total <= self.tile else np.zeros(len(x), np.uint64)
            while len(row):
                tile = np.where((tile == 0) & (size[node] <= self.tile), code[node], tile)
                done = child[node] < 0
                for at in np.flatnonzero(np.bincount(node[done], minlength=0)).tolist() if tree.tail else []:
                    if at in tree.tail:
                        here = done & (node == at)
                        out.append(self._follow(tree.tail[at], proj, row[here], code[at], tile[here], size[at]))
                        done &= ~here
                        row, node, tile, done = row[~here], node[~here], tile[~here], done[~here]
                out.append((row[done], code[node[done]], np.where(tile[done] == 0, code[node[done]], tile[done])))
                row, node, tile = row[~done], node[~done], tile[~done]
                gap = proj[row, direction[node]] - value[node]
                down, up = gap <= self.margin, gap >= -self.margin
                row, node, tile = np.concatenate([row[down], row[up]]), np.concatenate([child[node[down]], child[node[up]] + 1]), np.concatenate([tile[down], tile[up]])
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def _follow(self, tail: list[tuple[int, float]], proj: np.ndarray, row: np.ndarray, code: np.uint64, tile: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        path = np.full(len(row), code)
        for k, value in tail:
            gap, size = proj[row, k] - value, size / 2
            down, up = gap <= self.margin, gap >= -self.margin
            row, path, tile = np.concatenate([row[down], row[up]]), np.concatenate([mix(path[down] + np.uint64(1)), mix(path[up] + np.uint64(2))]), np.concatenate([tile[down], tile[up]])
            if size <= self.tile:
                tile = np.where(tile == 0, path, tile)
        return row, path, np.where(tile == 0, path, tile)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF, fit_rows: int = FIT_ROWS, tile: int = TILE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of vectors.

    Two rows link if their labels are equal and not null and the cosine of
    their vectors, in double precision, reaches the threshold. Candidates come
    from the leaves of a forest of random-projection trees with overlap at the
    splits; each label (and vector length) has a forest of its own, fitted on
    a bounded sample of its vectors, and every vector is indexed. Each
    candidate is verified, so no link is false. Equal vectors are one node
    that counts its copies. Leaves of one subtree travel together; in a large
    one, whose rows no split parts, blocks of rows meet block by block. A task
    tells only how many links each row has and which row it hangs on, never
    the pairs.

    Rows that link with nothing (a null label; a vector that is null, empty,
    zero or holds null or non-finite components; a null id) are components of
    their own with no links; vectors of different lengths don't link. Copies
    of a whole row, and rows that share an id, count as separate rows. Ids may
    be of any type with an order. Other columns are not read.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    margin = 0.5 * math.sqrt(max(0.0, 2 * (1 - threshold)))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, raw = unit_vectors(b.column("v"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(raw, pa.binary())], names=["id", "label", "vec"])

    usable = cut(arrow(rows, clean, f"id {kind}, label string, vec binary").withColumns({"h1": F.xxhash64("label", "vec"), "h2": F.xxhash64("vec", F.lit(1), "label")}))
    linkable = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
    distinct = usable.where(linkable).groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    distinct = cut(distinct.withColumns({"group": F.xxhash64("label", F.length("vec")), "node": F.monotonically_increasing_id()}))
    sizes = cut(distinct.groupBy("group").agg(F.count("*").alias("rows")))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, held = None, 0, []
        for b in batches:
            for group, rows_, vec in zip(*(b.column(c).to_pylist() for c in ("group", "rows", "vec")), strict=True):
                if held and group != now:
                    yield batch_of(_MODELS, [now], [pickle.dumps(Forest(_matrix(held), total, trees, margin, leaf, tile))])
                    held = []
                now, total = group, rows_
                held.append(vec)
        if held:
            yield batch_of(_MODELS, [now], [pickle.dumps(Forest(_matrix(held), total, trees, margin, leaf, tile))])

    share = F.lit(float(fit_rows)) / F.col("rows") * F.lit(1 << 20)
    sample = distinct.join(sizes, "group").where((F.col("rows") <= fit_rows) | (F.pmod(F.xxhash64("h2"), F.lit(1 << 20)) < share)).select("group", "rows", "vec")
    models = arrow(sample.repartition(n, "group").sortWithinPartitions("group", "vec"), fit, "group long, forest binary")
    # a label's rows are dealt out by as many tasks as they need, each of which gets the label's forest
    spread = F.ceil(F.col("rows") / F.lit(DEAL_ROWS)).cast("int")
    work = distinct.join(sizes, "group").select("group", F.pmod(F.col("node"), spread).cast("int").alias("salt"), "node", "copies", "vec", F.lit(None).cast("binary").alias("forest"))
    given = models.join(sizes, "group").select("group", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("binary").alias("vec"), "forest")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, now = None, None
        for b in batches:
            groups, models_ = b.column("group").to_numpy(), b.column("forest")
            edges = np.flatnonzero(models_.is_valid().to_numpy(zero_copy_only=False))
            for s, e in zip([0, *(edges + 1)], [*edges, b.num_rows], strict=True):
                if e > s:
                    part = b.slice(s, e - s)
                    x = _matrix(part.column("vec").to_pylist())
                    row, code, where = forest.leaves(x, now)
                    order = np.lexsort((code, where, row))
                    row, code, where = row[order], code[order].view(np.int64), where[order].view(np.int64)
                    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (where[1:] != where[:-1])]))
                    inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(code))
                    outer = pa.array(np.searchsorted(row[first], np.arange(len(x) + 1)).astype(np.int32))
                    tiles = pa.ListArray.from_arrays(outer, pa.StructArray.from_arrays([pa.array(where[first]), inner], ["tile", "leaves"]))
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("copies"), part.column("vec"), tiles], names=["node", "copies", "vec", "tiles"])
                if e < b.num_rows:
                    forest, now = pickle.loads(models_[int(e)].as_py()), int(groups[e])

    together = work.unionByName(given).repartition(n, "group", "salt").sortWithinPartitions("group", "salt", F.col("node").asc_nulls_first())
    dealt = cut(arrow(together, deal, "node long, copies long, vec binary, tiles array<struct<tile:bigint,leaves:array<bigint>>>"))
    member = dealt.select("node", F.explode("tiles").alias("t")).select("node", "t.tile", F.col("t.leaves").alias("mine"))
    full = member.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    pairs = member.join(full, "tile").withColumn("own", F.pmod(F.xxhash64("node", "tile"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pairs = pairs.select("node", "tile", "mine", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    every = dealt.select("node", "copies", "vec", F.array_sort(F.flatten(F.col("tiles.leaves"))).alias("leaves"))
    meet = pairs.join(every, "node").repartition(n, "tile", "i", "j").sortWithinPartitions("tile", "i", "j", "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def settle() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            _, i, j = now
            x = _matrix(t.column("vec").to_pylist())
            node, copies, own = (t.column(c).to_numpy() for c in ("node", "copies", "own"))
            lists = t.column("leaves").to_pylist()
            wide = max(map(len, lists))
            codes = np.array([v + [v[0]] * (wide - len(v)) for v in lists], np.int64)
            mine = t.column("mine").combine_chunks()
            rows_of, leaf_of = np.repeat(np.arange(len(x)), np.diff(np.asarray(mine.offsets))), mine.flatten().to_numpy()
            order = np.argsort(leaf_of, kind="stable")
            rows_of, leaf_of = rows_of[order], leaf_of[order]
            edge = np.flatnonzero(np.concatenate([[True], leaf_of[1:] != leaf_of[:-1], [True]]))
            links, p, q = np.zeros(len(x), np.int64), [], []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                here, leaf_ = rows_of[s:e], leaf_of[s]
                a, b = (here, here) if i == j else (here[own[here] == i], here[own[here] == j])
                if len(a) < 1 or len(b) < 1 or (i == j and len(a) < 2):
                    continue
                for at in range(0, len(a), 256):
                    r, c = np.nonzero(x[a[at : at + 256]] @ x[b].T >= threshold)
                    r, c = a[at + r], b[c]
                    if i == j:
                        r, c = r[r < c], c[r < c]
                    if not len(r):
                        continue
                    p.append(r)
                    q.append(c)
                    for part in range(0, len(r), 1 << 15):
                        s1, e1 = r[part : part + (1 << 15)], c[part : part + (1 << 15)]
                        # a pair counts in the first of the leaves that its rows share
                        own_codes = codes[s1]
                        shared = np.zeros(own_codes.shape, bool)
                        for k in range(wide):
                            shared |= own_codes == codes[e1, k : k + 1]
                        first = ~(shared & (own_codes < leaf_)).any(1)
                        np.add.at(links, s1[first], copies[e1[first]])
                        np.add.at(links, e1[first], copies[s1[first]])
            p, q = np.concatenate(p) if p else np.zeros(0, np.int64), np.concatenate(q) if q else np.zeros(0, np.int64)
            order = np.argsort(node)  # a component hangs on its smallest node
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            root = local_components(len(x), back[p], back[q])
            on = np.zeros(len(x), bool)
            on[p] = on[q] = True
            yield batch_of(_LINKS, node[on], links[on], node[order[root[back[on]]]])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("tile", "i", "j")), strict=True))
            s = 0
            for e in range(1, len(keys) + 1):
                if e == len(keys) or keys[e] != keys[s]:
                    if now is not None and keys[s] != now:
                        yield from settle()
                    now = keys[s]
                    held.append(b.slice(s, e - s))
                    s = e
        if held:
            yield from settle()

    found = cut(arrow(meet, compare, "node long, links long, root long"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = cut(distinct.select("h1", "h2", "node", "low", "copies").join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(lows, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = usable.where(linkable).select("id", "h1", "h2").join(nodes, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = usable.where(~linkable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
