"""Benchmark decontamination with an FM-index for each shard of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, carried, distinct, mix, slices, split_words, uncarried, utf8

#: Words of a window.
WINDOW = 10
#: Bytes of text of a shard, each with an index of its own.
SHARD_BYTES = 6 << 20
#: Every so many positions of a shard the index keeps one.
SAMPLE = 16
#: Bytes of benchmark text that one pass sends to the executors; more take more passes.
BLOCK_BYTES = 8 << 20
#: Symbols that words outside the benchmark share.
OTHERS = 1 << 12

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FOLDED = np.frombuffer(_FOLD, np.uint8)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case: runs of ASCII digits and letters and of all that isn't ASCII."""
    return raw.translate(_FOLD).split()


class WaveletTree:
    """Ranks of symbols in a sequence, one bit of the symbols at each level; all queries are vectors.

    A level is a row of bits and, for each 64 of them, the ones before.
    """

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s, n = symbols, len(symbols)
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1 == 1
            packed = np.zeros(n // 64 + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:], dtype=np.int32)
            ones = s[bit]
            self.words.append(packed)
            self.before.append(before)
            self.zeros.append(n - len(ones))
            s = np.concatenate([s[~bit], ones])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """The ones of a level before each place."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level][word].astype(np.int64) + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << inside) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo = np.zeros_like(at)
        for k in range(self.bits):
            up = (symbol >> (self.bits - 1 - k)) & 1 == 1
            a, b = self._ones(k, lo), self._ones(k, at)
            lo, at = np.where(up, self.zeros[k] + a, lo - a), np.where(up, self.zeros[k] + b, at - b)
        return at - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, at)
            bit = self._ones(k, at + 1) - b
            symbol = symbol * 2 + bit
            lo, at = np.where(bit == 1, self.zeros[k] + a, lo - a), np.where(bit == 1, self.zeros[k] + b, at - b)
        return symbol, at - lo


def suffix_order(sequence: np.ndarray, top: int) -> np.ndarray:
    """The suffixes of a sequence of 1..top and ends 0 in order; each end is a symbol of its own, in the order of the ends.

    By doubling: suffixes known by their first symbols are told apart by twice
    as many. Only those that some other still equals are sorted again.
    """
    n = len(sequence)
    apart = np.flatnonzero(sequence == 0)
    first = sequence.astype(np.int64) + len(apart)
    first[apart] = np.arange(len(apart))
    wide, step = top + len(apart) + 2, 1
    key, known = first + 1, wide
    while known < (1 << 62) // wide and step < 4:  # as many symbols at once as a number holds; none reaches over the end
        after = np.zeros(n, np.int64)
        after[: n - step] = first[step:] + 1
        key, known, step = key * wide + after, known * wide, step + 1
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    place = np.repeat(start, np.diff(np.append(start, n)))  # a group's suffixes are known by the first of their places
    rank[order] = place
    size = np.diff(np.append(start, n))
    todo = np.flatnonzero(np.repeat(size > 1, size))  # places whose suffix isn't told apart yet
    while len(todo):
        at = order[todo]
        group, after = rank[at], np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        by = np.argsort(group * (n + 2) + after, kind="stable")
        at, group, after = at[by], group[by], after[by]
        order[todo] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(todo)))
        rank[at] = np.repeat(todo[start], size)
        todo = todo[np.repeat(size > 1, size)]
        step *= 2
    return order


class FMIndex:
    """Backward search over a sequence of words 1..top, in which a 0 ends each text."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.n = len(sequence)
        order = suffix_order(sequence, top)
        last = sequence[order - 1]  # the transform; the symbol before the first is the last end
        self.tree = WaveletTree(last, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=top + 1))])
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (a row, filled up at its right) the range of suffixes that start with it."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        live = np.arange(len(lengths))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lo[live] < hi[live]) & (step < lengths[live])]
            if not len(live):
                break
            s = patterns[live, lengths[live] - 1 - step].astype(np.int64)
            lo[live] = self.before[s] + self.tree.rank(s, lo[live])
            hi[live] = self.before[s] + self.tree.rank(s, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes, walking back to the next position that is kept."""
        out, walked, left = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            there = self.kept[rows + 1] > self.kept[rows]
            out[left[there]] = self.places[self.kept[rows[there]]] + walked
            left, rows = left[~there], rows[~there]
            s, r = self.tree.access(rows)
            rows, walked = self.before[s] + r, walked + 1
        return out


class Phrases:
    """The distinct windows of benchmark items, as numbers of words, and the items that hold each; all of it in flat arrays."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        vocabulary: dict[bytes, int] = {}
        ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(raw)), np.int32) for _, raw in items]
        self.vocabulary = list(vocabulary)
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([*ids, np.zeros(window, np.int32)])
        many = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        item = np.repeat(np.arange(len(items)), many)
        start = np.repeat(np.cumsum(size) - size, many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(size[item], window)
        rows = np.where(np.arange(window) < length[:, None], flat[start[:, None] + np.arange(window)], 0)
        order = np.lexsort((item, *rows.T[::-1]))
        rows, item, length = rows[order], item[order], length[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        self.patterns, self.lengths = rows[new], length[new]
        #: Entries of items from first[k] to first[k + 1] hold window k.
        self.first = np.append(np.flatnonzero(new), len(rows))
        self.items = item

    def known(self) -> pa.Array:
        return pa.array(self.vocabulary, pa.binary())


def numbered(column: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as symbols, a 0 after each text, and where each text begins.

    A word of the benchmark is its number there; all other words share some
    symbols after those, by a hash of theirs.
    """
    data, off = utf8(column)
    folded = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(_FOLDED[data])])
    words, first = split_words(folded.view(pa.large_utf8()), lower=False)
    found = words.cast(pa.large_binary()).dictionary_encode()
    values = found.dictionary.cast(pa.binary())
    number = pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    other = np.flatnonzero(number < 0)
    number[other] = len(known) + (mix(other.astype(np.uint64)) % np.uint64(OTHERS)).astype(np.int64)
    code = found.indices.to_numpy(zero_copy_only=False)
    out = np.zeros(len(code) + len(off) - 1, np.int64)
    out[np.arange(len(code)) + np.repeat(np.arange(len(off) - 1), np.diff(first))] = number[code] + 1
    return out, first + np.arange(len(off))


def search(column: pa.Array, p: Phrases, known: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each text of a shard: its number of words, whether each is hit, and the items found.

    All words of the shard are in its index.
    """
    sequence, first = numbered(column, known)
    hit = np.zeros(len(sequence) + 1, np.int64)
    pairs: list[np.ndarray] = [np.zeros(0, np.int64)]
    if len(p.lengths) and len(sequence) > len(first) - 1:
        index = FMIndex(sequence, len(known) + OTHERS)
        lo, hi = index.count(p.patterns, p.lengths)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        for part in range(0, len(rows), 1 << 18):
            w = which[part : part + (1 << 18)]
            found = index.locate(rows[part : part + (1 << 18)])
            np.add.at(hit, found, 1)
            np.add.at(hit, found + p.lengths[w], -1)
            text = np.searchsorted(first, found, "right") - 1
            seen = distinct(text * len(p.lengths) + w)  # the windows of each text, and then their items
            text, w = seen // len(p.lengths), seen % len(p.lengths)
            n = p.first[w + 1] - p.first[w]
            at = np.arange(int(n.sum())) + np.repeat(p.first[w] - (np.cumsum(n) - n), n)
            pairs.append(distinct(np.repeat(text, n) * len(p.names) + p.items[at]))
    pair = distinct(np.concatenate(pairs))
    names = max(1, len(p.names))
    cover, size = np.cumsum(hit) > 0, np.diff(first) - 1
    cut = np.searchsorted(pair, np.arange(len(first)) * names)
    return size, [cover[a : a + n] for a, n in zip(first[:-1], size, strict=True)], [pair[a:b] % names for a, b in zip(cut[:-1], cut[1:], strict=True)]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about a shard."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column("t").nbytes
        if size >= SHARD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    x = np.concatenate([[0], hit.astype(np.int8), [0]])
    d = np.diff(x)
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))


def remove_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the text from the first to the last word of each span of words."""
    if not spans:
        return raw
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]])


_FOUND = "n_words long, hit_spans array<struct<start:int,end:int>>, item_ids array<string>"


def find_phrases(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] = []) -> DataFrame:
    """(id_col, n_words, hit_spans, item_ids, clean_text, *carry) for every row of docs.

    hit_spans are merged ranges of words inside occurrences of benchmark
    windows, item_ids the items found, sorted as strings, clean_text the text
    without those ranges (null stays null). An item of fewer words than a
    window is one window; one without words, or null, has none. A null item id
    is named "null". Equal ids count once. A null or empty text has no words.
    Repeated rows each get a row; no rows give no rows, no items no hits.
    Other columns are not read.

    The benchmark's windows are sent to the executors in blocks of a bounded
    size (about 50 bytes for each of its words), each block by a pass of its
    own over docs.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    passes = int(size // block_bytes) + 1
    columns, names, kinds = carried(docs, carry)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), *columns)

    def seek(phrases) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = phrases.value
            known = p.known()
            for batch in shards(batches):
                for part in slices(batch, "t", SHARD_BYTES, 1 << 20):
                    texts = part.column("t")
                    n, hits, found = search(texts, p, known)
                    spans = [_spans(h) if len(f) else [] for h, f in zip(hits, found, strict=True)]
                    changed = [k for k, x in enumerate(spans) if x]
                    pick = np.arange(len(texts))
                    pick[changed] = len(texts) + np.arange(len(changed))
                    clean = pa.concat_arrays([texts, pa.array([remove_words(texts[k].as_py().encode(), spans[k]).decode() for k in changed], pa.string())]).take(pa.array(pick))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(n), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted({p.names[k] for k in f}) for f in found], pa.list_(pa.string())), clean], names=[*passed, "n_words", "hit_spans", "item_ids", "clean_text"])

        return run

    def block(k: int):
        mine = items if passes == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(passes)) == k)
        return spark.sparkContext.broadcast(Phrases(sorted((r.name, r.text.encode()) for r in mine.collect()), window))

    if passes == 1:
        passed = ["i", *names]
        return uncarried(arrow(rows, seek(block(0)), f"i {kind}{kinds}, {_FOUND}, clean_text string"), carry, i=id_col)
    keyed = rows.withColumns({"k1": F.xxhash64("i"), "k2": F.xxhash64("t")})
    passed = ["k1", "k2"]
    parts = [arrow(keyed, seek(block(k)), f"k1 long, k2 long, {_FOUND}, clean_text string").where("size(item_ids) > 0").select("k1", "k2", "hit_spans", "item_ids") for k in range(passes)]
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    found = found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("hit_spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("f"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, clean = [], [], []
            for t, s in zip(b.column("t").to_pylist(), b.column("s").to_pylist(), strict=True):
                raw = (t or "").encode()
                n.append(len(words_of(raw)))
                hit = np.zeros(n[-1], bool)
                for x in s or []:
                    hit[x["start"] : x["end"]] = True
                spans.append(_spans(hit))
                clean.append(t if not s else remove_words(raw, spans[-1]).decode())
            yield pa.RecordBatch.from_arrays([b.column("i"), *(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(f or []) for f in b.column("f").to_pylist()], pa.list_(pa.string())), pa.array(clean, pa.string())], names=["i", *names, "n_words", "hit_spans", "item_ids", "clean_text"])

    return uncarried(arrow(keyed.join(found, ["k1", "k2"], "left").select("i", "t", "s", "f", *names), merge, f"i {kind}{kinds}, {_FOUND}, clean_text string"), carry, i=id_col)
