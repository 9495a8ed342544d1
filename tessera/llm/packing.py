"""Best-fit packing of token sequences after a dominance reduction."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, cut, slices, split_words, utf8

#: Tokens of a sequence.
CAPACITY = 4096
#: The id that ends each document.
END = 1
#: Bytes of text that are split into words at once.
TEXT_BYTES = 4 << 20
#: Words whose ids a worker remembers.
CACHE = 1_000_000
#: Parts words that are encoded together; as an added token it has an id that no word gets.
_PART = "<|startoftext|>"
#: What a tokenizer does with a text before its pieces are looked up, if its ids can be had word by word. Fixed values, as the vocabulary file has them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_PIECES = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())])
_tokenizers: dict[int, Encoder] = {}
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_ALNUM = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
_PUNCT = np.array([33 <= c <= 126 and not chr(c).isalnum() and c != 39 for c in range(256)])


def by_words(definition: dict) -> bool:
    """Whether a text's ids are those of its words, one after the other: white space is dropped and no piece reaches over it."""
    split = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    marks = {t["content"] for t in definition.get("added_tokens", []) if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])}
    return definition.get("normalizer") == _NORMALIZER and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True and _PART in marks


class Encoder:
    """A tokenizer, and the ids of words so far."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        definition = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.marks = [t["content"].encode() for t in definition.get("added_tokens", [])]
        self.by_words = by_words(definition)
        self.part = self.tokenizer.token_to_id(_PART)
        self.known: dict[bytes, bytes] = {}

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of whole texts, with the strings of added tokens as such."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        """Encode words that are new."""
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            joined = [_PART.join([w.decode() for w in some[k : k + 200]]) for k in range(0, len(some), 200)]
            ids = np.array([i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in (*e.ids, self.part)], "<u4")
            ends = np.flatnonzero(ids == self.part)
            raw, first = ids.tobytes(), np.concatenate([[0], ends[:-1] + 1])
            self.known.update(zip(some, [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), ends.tolist(), strict=True)], strict=True))


def _encoder(text: str) -> Encoder:
    key = hash(text)
    if key not in _tokenizers:
        _tokenizers[key] = Encoder(text)
    return _tokenizers[key]


def token_ids(data: np.ndarray, off: np.ndarray, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's begin.

    They are what the tokenizer's encode gives for each whole text without
    special tokens added. Where its ids can be had word by word, each distinct
    word is encoded once; texts that hold the string of an added token, and
    all texts under another kind of tokenizer, are encoded whole.
    """
    raw, n = data.tobytes(), len(off) - 1
    if not encoder.by_words:
        ids = encoder.whole([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])
    odd = set()
    for mark in encoder.marks:
        at = raw.find(mark)
        while at >= 0:
            odd.add(row := int(np.searchsorted(off, at, "right")) - 1)
            at = raw.find(mark, max(at + 1, int(off[row + 1]) - len(mark) + 1))
    flat, begin = _by_words(data, off, encoder)
    if not odd:
        return flat, begin
    parts, done = [flat[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], sorted(odd)
    for k, ids in zip(done, encoder.whole([raw[off[k] : off[k + 1]] for k in done]), strict=True):
        parts[k] = ids
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _by_words(data: np.ndarray, off: np.ndarray, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts from those of their distinct words.

    To have fewer words, a mark after an ASCII letter or digit begins a word
    (no piece holds both, but after an apostrophe), and A-Z are lower-cased
    where no combining mark can follow.
    """
    if len(data):
        nxt = np.concatenate([data[1:], [np.uint8(32)]])
        low = np.where(_UPPER[data] & (nxt < 128), data + np.uint8(32), data).astype(np.uint8)
        apart = np.zeros(len(data), bool)
        apart[1:] = _PUNCT[data[1:]] & _ALNUM[data[:-1]]
        apart[off[off < len(data)]] = False  # a text's first byte begins a word as it is
        marks = np.flatnonzero(apart)
        wide = np.insert(low, marks, np.uint8(32))
        off = off + np.searchsorted(marks, off)
        data = wide
    texts = pa.Array.from_buffers(pa.large_utf8(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    words, first = split_words(texts, lower=False)
    found = words.cast(pa.large_binary()).dictionary_encode()
    which, words = found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()
    if not len(which):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    new = [w for w in words if w not in encoder.known]
    if len(encoder.known) + len(new) > CACHE:
        encoder.known.clear()
        new = words
    encoder.learn(new)
    ids = [encoder.known[w] for w in words]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
    n = size[which]
    total = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], n)], total[first]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """Every text's ids and the end id, cut at each capacity: a row for each piece, numbered within its task and length."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # one file, whatever the corpus is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(vocabulary.value), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = np.array([END], "<u4")
        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES):
                flat, begin = token_ids(*utf8(part.column("t")), encoder)
                rows, out = [], []
                for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    for k, at in enumerate(range(0, b - a + 1, capacity)):
                        x = flat[a + at : min(a + at + capacity, b)]
                        x = x if a + at + capacity <= b else np.append(x, end)
                        n = len(x)
                        rows.append(i)
                        out.append((k, at, n, zlib.crc32(x.tobytes()), task, seen.get(n, 0)))
                        seen[n] = seen.get(n, 0) + 1
                names = ["i", *(f.name for f in _PIECES)]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("i").take(pa.array(rows, pa.int64())), *columns], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow(docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")), run, f"i {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long")


def reduce_dominated(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Permanently fix sets of lengths that dominate all others; count, by length, is lowered in place.

    Returns (bins, [(length, copies), ...]). For a length w with room r left,
    a fixed set is no worse than any other that holds w:
    an item of exactly r fills the bin, and whatever else w could stand with
    fits where that item stood; if nothing fits, w stands alone; if no two
    items fit, the largest that fits can replace any other.
    """
    fixed: list[tuple[int, list[tuple[int, int]]]] = []
    for w in range(capacity, 0, -1):
        while count[w]:
            r = capacity - w
            here = count.copy()
            here[w] -= 1  # what may stand beside one such item
            fits = np.flatnonzero(here[1 : r + 1]) + 1
            if not len(fits):
                n = 1 if 2 * w <= capacity else int(count[w])
                fixed.append((n, [(w, 1)]))
                count[w] -= n
                continue
            x = int(fits[-1])
            two = 2 * int(fits[0]) if here[fits[0]] > 1 else int(fits[0] + fits[1]) if len(fits) > 1 else r + 1
            if x != r and two <= r:
                break
            n = int(count[w] // 2) if x == w else int(min(count[w], count[x]))
            fixed.append((n, [(w, 2)] if x == w else [(w, 1), (x, 1)]))
            count[w] -= n
            count[x] -= n
    return fixed


def best_fit(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram of lengths: (bins, [(length, copies), ...]).

    Bins with equal room are handled together: the items of one length that
    best-fit would put into them one after the other are dealt at once.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    open_ = np.zeros(capacity + 1, bool)

    def put(n: int, left: int, what: list[tuple[int, int]]) -> None:
        if n:
            room.setdefault(left, []).append((n, what))
            open_[left] = True

    for w in range(capacity, 0, -1):
        n = int(count[w])
        while n:
            at = int(np.argmax(open_[w:])) + w
            if open_[at]:
                bins, what = room[at].pop()
                if not room[at]:
                    open_[at] = False
                left = at
            else:
                bins, what, left = n, [], capacity
            each = left // w
            full = min(bins, n // each)
            put(full, left - each * w, [*what, (w, each)])
            n -= full * each
            bins -= full
            if bins and 0 < n < each:
                put(1, left - n * w, [*what, (w, n)])
                bins, n = bins - 1, 0
            if what:
                put(bins, left, what)
    return [(n, what) for same in room.values() for n, what in same]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first bin, offset in the bin), ordered by length and rank.

    The k-th item of a length stands in the row whose first rank is the last
    not above k. It is made from the histogram alone, so its size depends on
    the capacity and not on the number of documents.
    """
    count = np.zeros(capacity + 1, np.int64)
    count[lengths] = counts
    used, bin_, rows = np.zeros(capacity + 1, np.int64), 0, []
    for n, what in reduce_dominated(count, capacity) + best_fit(count, capacity):
        at = 0
        for w, each in what:
            rows.append((w, used[w], each, bin_, at))
            used[w] += n * each
            at += w * each
        bin_ += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    Only the histogram of lengths (at most capacity rows) reaches the driver.
    The rank of a piece among all of its length comes from the numbers of
    pieces of each length in each task; they are joined by a shuffle, as
    their number grows with the tasks.

    Null and empty texts are the end id alone. Repeated rows and null ids are
    packed like any other row. Other columns of docs are not read. No rows
    give no rows.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer_path, id_col, text_col, capacity))
    by_task = cut(cutted.groupBy("length", "task").agg(F.count("*").alias("n")))
    hist = by_task.groupBy("length").agg(F.sum("n").alias("n")).toPandas()
    places = spark.sparkContext.broadcast(plan(hist["length"].to_numpy(np.int64), hist["n"].to_numpy(np.int64), capacity))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        key = (p[:, 0] << 44) + p[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("before").to_numpy() + b.column("nth").to_numpy()
            row = p[np.searchsorted(key, (length << 44) + rank, "right") - 1] if len(p) else p[:0]
            k = rank - row[:, 1]
            seq = pa.array(row[:, 3] + k // row[:, 2])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("i", "piece", "start", "length", "ids_crc32")), seq, pa.array(row[:, 4] + k % row[:, 2] * length)], names=["i", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = arrow(cutted.join(before.hint("merge"), ["length", "task"]).select("i", "piece", "start", "length", "ids_crc32", "before", "nth"), place, f"i {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("i", id_col)
