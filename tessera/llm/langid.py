"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, carried, remainder, sample_by_class, slices, uncarried, utf8

#: Documents of each language that the model is trained on, at most about so many.
TRAIN_EACH = 400
#: Subwords: runs of so many bytes inside a word, its ends included.
ORDERS = (3, 5)
BUCKET_BITS = 15
DIM = 16
#: Texts are trained on in stretches of so many bytes, so that short texts are learnt too,
#: and of a text at most so many stretches, spread over all of it.
STRETCH, STRETCHES = 300, 128
EPOCHS = 6
UNKNOWN = "und"

_FOLD = np.array([32 if c < 128 and not chr(c).isalpha() else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def subwords(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of the subwords and where each starts; those over a word's or a text's end are left out."""
    low = _FOLD[data]
    inside = low != 32
    edge = np.zeros(len(low) + 1, np.int64)
    edge[off[(off > 0) & (off < len(low))]] = 1
    edge = np.cumsum(edge)[:-1] if len(low) else edge[:0]
    for n in ORDERS:
        m = len(low) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        ok = edge[:m] == edge[n - 1 :]
        for k in range(n):
            h = h * np.uint64(257) + low[k : k + m]
            if 0 < k < n - 1:
                ok &= inside[k : k + m]
        at = np.flatnonzero(ok)
        yield ((h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), at


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # languages x buckets: what a subword adds to a language's logit
    scale: float  # inverse temperature
    reject: float  # below this probability a text has no known language

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts x languages: means over all subwords of each whole text; NaN without subwords."""
        total, n = np.zeros((len(off) - 1, len(self.langs))), np.zeros(len(off) - 1)
        for h, at in subwords(data, off):
            cut = np.searchsorted(at, off)
            n += np.diff(cut)
            for c in range(len(self.langs)):
                run = np.concatenate([[0.0], np.cumsum(self.table[c][h], dtype=np.float64)])
                total[:, c] += run[cut[1:]] - run[cut[:-1]]
        with np.errstate(invalid="ignore", divide="ignore"):
            return total / n[:, None]

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its language's number and probability, and whether that is too low; without subwords it is never too low."""
        z = self.logits(data, off)
        judged = ~np.isnan(z[:, 0])
        z = np.nan_to_num(z) * self.scale
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        p = p[np.arange(len(p)), best]
        return best, p, judged & (p < self.reject)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def spread(raw: bytes) -> bytes:
    """A text, or at most STRETCHES stretches at equal distances of a longer one."""
    n = STRETCH * STRETCHES
    if len(raw) <= n:
        return raw
    return b" ".join(raw[a : a + STRETCH - 1] for a in np.linspace(0, len(raw) - STRETCH, STRETCHES).astype(int).tolist())


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> Model | None:
    """Stochastic gradient descent on stretches of the texts; a fifth of the texts calibrates temperature and rejection.

    With fewer than 20 texts for each language nothing is put aside, and the
    training texts calibrate.
    """
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = set(order[: len(order) // 5].tolist()) if len(order) >= 20 * len(names) else set()
    examples: list[tuple[np.ndarray, np.ndarray, int]] = []
    for k in range(len(texts)):
        if k in held:
            continue
        raw, y = texts[k], names.index(langs[k])
        cuts = list(range(0, len(raw), STRETCH)) or [0]
        for a in cuts:
            part = np.frombuffer(raw[a : a + STRETCH], np.uint8)
            found = [h for h, _ in subwords(part, np.array([0, len(part)]))]
            h = np.concatenate(found) if found else np.zeros(0, np.int64)
            if len(h):
                b, n = np.unique(h, return_counts=True)
                examples.append((b, n / n.sum(), y))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM))
    out = np.zeros((len(names), DIM))
    weight = 1 / np.maximum(1, np.bincount([y for _, _, y in examples], minlength=len(names)))
    weight *= len(examples) / max(1, len(names))
    steps, total = 0, max(1, EPOCHS * len(examples))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)).tolist():
            b, w, y = examples[k]
            rate = 1.0 * (1 - steps / total) * min(weight[y], 5.0)
            steps += 1
            x = w @ emb[b]
            g = _softmax(out @ x)
            g[y] -= 1
            back = out.T @ g
            out -= rate * np.outer(g, x)
            emb[b] -= rate * len(b) ** 0.5 * w[:, None] * back
    model = Model(names, np.ascontiguousarray((out @ emb.T).astype(np.float32)), 1.0, 0.0)
    check = sorted(held) or list(range(len(texts)))
    z = np.stack([model.logits(d := np.frombuffer(texts[k], np.uint8), np.array([0, len(d)]))[0] for k in check]) if check else np.zeros((0, len(names)))
    y = np.array([names.index(langs[k]) for k in check])
    known = ~np.isnan(z).any(axis=1) if len(z) else np.zeros(0, bool)
    z, y = z[known], y[known]
    if len(z):
        def loss(s: float) -> float:
            p = z * s
            p = p - p.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(y)), y]))

        model.scale = min(np.geomspace(0.05, 50, 61).tolist(), key=loss)
        p = z * model.scale
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right = p[np.arange(len(y)), y][p.argmax(axis=1) == y]
        # of texts whose language is right, about one in a thousand may be rejected, and none above even odds
        model.reject = float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.0
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = TRAIN_EACH) -> Model | None:
    """Train on a bounded choice of the rows of docs whose text and language are known: so many of each language, and a bounded part of each."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("y"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spread(t.encode()) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), pa.array(texts, pa.binary())], names=["i", "y", "t"])

    chosen = arrow(sample_by_class(rows, "y", "i", each).select("i", "y", "t"), thin, "i string, y string, t binary").collect()
    chosen.sort(key=lambda r: (r.i is not None, r.i or "", bytes(r.t)))
    return train([bytes(r.t) for r in chosen], [r.y for r in chosen])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = []) -> DataFrame:
    """(id_col, lang_pred, score, rejected, *carry) for every row of docs, over whole texts.

    A null text and one without any letter are "und" with score 0 and rejected, as is
    every text if there is no model. rejected also holds if the calibrated
    probability is below the model's threshold, which texts without a whole
    subword escape. Repeated rows each get a row;
    other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    columns, names, kinds = carried(docs, carry)
    shared = spark.sparkContext.broadcast(model)  # languages x 2**15 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                data, off = utf8(part.column("t"))
                letters = part.column("letters").to_numpy(zero_copy_only=False) if m else np.zeros(part.num_rows, bool)
                best, p, low = m.predict(data, off) if m else (np.zeros(part.num_rows, int), np.zeros(part.num_rows), ~letters)
                langs = [m.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(langs, pa.string()), pa.array(np.where(letters, p, 0.0)), pa.array(~letters | low), *(part.column(n) for n in names)], names=["i", "lang_pred", "score", "rejected", *names])

    letters = F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), *columns).withColumn("letters", letters)
    return uncarried(arrow(rows, run, f"i {kind}, lang_pred string, score double, rejected boolean{kinds}"), carry, i=id_col)


def identify_held_out(docs: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows outside one fold of the ids and identify all: (id_col, held_out, lang_pred, score, rejected)."""
    fold = remainder(id_col, folds)
    model = fit(docs.where(fold != held), id_col, text_col, lang_col)
    return identify(docs, model, id_col, text_col).select(id_col, (fold == held).alias("held_out"), "lang_pred", "score", "rejected")
