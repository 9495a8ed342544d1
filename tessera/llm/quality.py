"""Text quality by the votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Rolling, arrow, cut, remainder, sample_by_class, slices, utf8, word_spans

#: Labelled documents of each class that vote, at most about so many.
NEIGHBOURS_EACH = 2000
#: Terms: pairs of neighbouring bytes, hashed, and measures of form.
TERMS = 1024
DIM = 64
VOTERS = 25
#: A neighbour's vote counts as this power of its similarity.
SHARPNESS = 8
#: Weight of a measure of form beside the terms' unit vector.
FORM_WEIGHT = 1.5

_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
_WORDS, _LINES = Rolling(31), Rolling(32)
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_LETTER = np.array([chr(c).isalpha() or c >= 128 for c in range(256)])
_MARK = np.array([c in b"!#$%&*|<>=~^_{}[]@/\\+" for c in range(256)])
_NOT_BREAK = np.array([c != 10 for c in range(256)])


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[off[1:]] - run[off[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the number of distinct hashes."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    return np.bincount(r[new], minlength=len(first) - 1)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts x (terms and measures of form), over whole texts; an empty text's terms are all 0."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    terms = np.zeros(n * TERMS)
    if len(data) > 1:
        inside = doc[1:] == doc[:-1]
        pair = _PAIR[data[:-1].astype(np.int64) * 256 + data[1:]]
        terms = np.bincount((doc[:-1] * TERMS + pair)[inside], minlength=n * TERMS)
    starts, ends, first = word_spans(data, off, ~SPACE)
    h = _WORDS.words(data, starts, ends) if len(data) else np.zeros(0, np.uint64)
    words = np.diff(first)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = False
    ls, le, lf = word_spans(data, off, _NOT_BREAK)
    lines = np.diff(lf)
    lh = _LINES.words(data, ls, le) if len(data) else np.zeros(0, np.uint64)
    w, s = np.maximum(words, 1), np.maximum(size, 1)
    form = np.stack([
        _distinct(h, first) / w ** 0.85, _per_row(again, first) / w, _per_row(_UPPER[data], off) / s, _per_row(_MARK[data], off) / s,
        _per_row(_LETTER[data], off) / s, np.minimum(size / w, 30) / 30, np.log1p(words) / 10, _distinct(lh, lf) / np.maximum(lines, 1),
    ], 1)
    return np.concatenate([np.log1p(terms.reshape(n, TERMS)), form], axis=1)


@dataclass
class Space:
    idf: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    axes: np.ndarray
    voters: np.ndarray  # unit vectors
    votes: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space."""
        t = x[:, :TERMS] * self.idf
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        f = np.clip((x[:, TERMS:] - self.middle) / self.spread, -3, 3) * (FORM_WEIGHT / (3 * x.shape[1] - 3 * TERMS) ** 0.5)
        z = np.concatenate([t, f], axis=1) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """The share of label 1 among the nearest voters by exact cosine, in blocks of rows."""
        if not len(self.votes):
            return np.full(len(x), 0.5)
        out, k = np.empty(len(x)), min(VOTERS, len(self.votes))
        z = self.place(x)
        for at in range(0, len(x), block):
            cos = z[at : at + block] @ self.voters.T
            near = np.argpartition(cos, -k, axis=1)[:, -k:] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
            weight = np.clip(np.take_along_axis(cos, near, 1), 1e-6, 1.0) ** SHARPNESS
            out[at : at + block] = (weight * self.votes[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


WIDTH = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def build(x: np.ndarray, labels: list[int]) -> Space:
    """Latent axes of the labelled texts' weighted terms, and the texts' own places there; x has their features."""
    seen = (x[:, :TERMS] > 0).sum(axis=0)
    idf = np.log((1 + len(x)) / (1 + seen)) + 0.1
    middle, spread = (x[:, TERMS:].mean(axis=0), np.maximum(x[:, TERMS:].std(axis=0), 1e-6)) if len(x) else (np.zeros(WIDTH - TERMS), np.ones(WIDTH - TERMS))
    space = Space(idf, middle, spread, np.eye(WIDTH), np.zeros((0, DIM)), np.array(labels, float))
    if len(x):
        t = x[:, :TERMS] * idf
        t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        f = np.clip((x[:, TERMS:] - middle) / spread, -3, 3) * (FORM_WEIGHT / (3 * WIDTH - 3 * TERMS) ** 0.5)
        a = np.concatenate([t, f], axis=1)
        _, axes = np.linalg.eigh(a.T @ a)
        space.axes = np.ascontiguousarray(axes[:, -DIM:])
        space.voters = space.place(x)
    return space


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = NEIGHBOURS_EACH) -> Space:
    """The space of a bounded choice of labelled rows; rows without a text or label are left out.

    An id with several labels has the smallest, and one with several texts the
    one of the smallest hash. Texts become features where they are, so the
    driver gets a vector of one size for each chosen row.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    few = cut(sample_by_class(marked, "y", "i", each).select("i", "y"))  # about 2 * each rows, of a known size
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").join(few, "i")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20, 1024):
                x = features(*utf8(part.column("t")))
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["i", "h", "y", "x"])

    hashed = rows.select(F.col("i").cast("string").alias("i"), F.xxhash64("t").alias("h"), "y", "t")
    described = arrow(hashed, describe, "i string, h long, y int, x binary")
    chosen = described.groupBy("i").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("i", "r.*").collect()
    chosen.sort(key=lambda r: (r.i, r.h))
    x = np.frombuffer(b"".join(r.x for r in chosen), np.float64).reshape(len(chosen), WIDTH)
    return build(x, [r.y for r in chosen])


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row of docs, over whole texts; higher means that label 1 is likelier.

    The vote is the share of label 1 among the VOTERS most similar labelled
    texts, each weighted by its similarity to the power SHARPNESS; equal
    similarities may be taken in any order. Terms are hashed pairs of bytes,
    beside some measures of form (repeats, capitals, marks, word lengths).

    Null and empty texts are scored as texts without terms. Repeated rows each
    get a row; other columns are not read; no rows give no rows; without
    labelled rows all scores are 0.5.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(space)  # at most 2 * NEIGHBOURS_EACH vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 20, 1024):
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(shared.value.score(features(*utf8(part.column("t")))))], names=["i", "score"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return arrow(rows, run, f"i {kind}, score double").withColumnRenamed("i", id_col)


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learn from the rows outside one fold of the ids and score all: (id_col, held_out, score, predicted)."""
    fold = remainder(id_col, folds)
    space = fit(docs.where(fold != held), labels.where(fold != held), id_col, text_col, label_col)
    return score(docs, space, id_col, text_col).select(id_col, (fold == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
