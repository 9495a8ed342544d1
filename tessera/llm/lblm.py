"""A log-bilinear language model trained by noise-contrastive estimation, over exact corpus counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batch_of, cut, partitions, remainder, slices, split_words

#: Words with an output vector of their own; all others share classes by their last letters.
TOP, CLASSES = 1023, 256
DIM = 32
#: Preceding words that predict the next, each place with weights of its own.
ORDER = 2
#: Noise words of a step, which all its examples share.
NOISE = 64
#: Examples of a step.
BATCH = 256
RATE = 0.15
#: Each position of a training text is an example of the neural model in one of the rounds.
ROUNDS = 2
#: Tokens that a model of its own is trained on in a round, before all models are averaged.
CHUNK_TOKENS = 1 << 20
#: Words whose counts go to every task, at most so many; the counts of all others are joined.
KNOWN = 200_000
#: A longer word is known by a hash of so many bits; so no table holds long words.
LONGEST = 64
#: Partial counts that a task holds before it passes them on.
HELD = 400_000
#: Bytes of text that are split into words at once.
TEXT_BYTES = 8 << 20

_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
END = b""  # no word is empty


def word_class(word: bytes) -> int:
    """The class of a word without a vector: a hash of its last three bytes."""
    return TOP + 1 + zlib.crc32(word[-3:]) % CLASSES


def tokens(raw: bytes) -> list[bytes]:
    """A text's tokens: its words with A-Z in lower case, then the end."""
    return [*raw.lower().split(), END]


def identity(word: bytes) -> bytes:
    """What a word is known by: itself, or a zero byte and a 128-bit hash if it is long."""
    return word if len(word) <= LONGEST else b"\0" + xxhash.xxh3_128_digest(word)


def coded(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts as numbers, the identities that these stand for, and the number of each text's first word."""
    flat, first = split_words(column)
    found = flat.cast(pa.binary()).dictionary_encode()
    values = found.dictionary
    if len(values) and pc.max(pc.binary_length(values)).as_py() > LONGEST:
        values = pa.array([identity(w) for w in values.to_pylist()], pa.binary())
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), values, first


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over rows(t): exact counts of the identities of all tokens, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return t.select(["word", "n_sum"]).rename_columns(["word", "n"]).cast(_COUNTS)

        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES, 1 << 20):
                code, values, first = coded(part.column("t"))
                held.append(pa.Table.from_arrays([values, pa.array(np.bincount(code, minlength=len(values)))], schema=_COUNTS))
                size, ends = size + len(values), ends + part.num_rows
                if size > HELD:
                    held = [summed()]
                    size = held[0].num_rows
                    if size > HELD // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from summed().to_batches()
        if ends:
            yield batch_of(_COUNTS, [END], [ends])

    return arrow(rows.select("t"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The commonest words with their counts, the counts of the outputs, and totals of the corpus.

    Word k of at most KNOWN + 1 is output out[k]: the end, the TOP commonest
    words, or else its class. count[k] is its count, for the places after the
    words (one for each class) 0.
    """

    words: pa.Array
    out: np.ndarray
    count: np.ndarray
    own: np.ndarray  # counts of outputs
    mass: np.ndarray  # for each class output, the sum of c + 0.5 over its words, and 0.5 for an unseen one
    n: int  # training tokens
    v: int  # distinct training tokens

    def places(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The places of all tokens, where each text's begin (one more at the end), and of the words that aren't known their tokens, numbers and identities."""
        code, values, first = coded(column)
        known = pc.index_in(values, value_set=self.words)
        place = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        odd = np.flatnonzero(place < 0)
        place[odd] = [len(self.words) + word_class(w) - TOP - 1 for w in values.take(pa.array(odd)).to_pylist()]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out = np.zeros(len(code) + len(first) - 1, np.int64)  # the end stands after each text
        at = np.arange(len(code)) + text
        out[at] = place[code]
        rare = np.flatnonzero(out >= len(self.words))
        return out, first + np.arange(len(first)), rare, code[rare - np.searchsorted(first[1:] + np.arange(1, len(first)), rare, "right")], values


def contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the outputs of whole texts the one before the last and the last, which are the end where the text has none."""
    last = np.concatenate([ids[:0], [0], ids[:-1]])[: len(ids)]
    before = np.concatenate([ids[:0], [0, 0], ids[:-2]])[: len(ids)]
    return np.where(last == 0, 0, before), last


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Collect the words above a count that at most KNOWN words reach, and the sums of the classes.

    The count comes from a histogram of a few hundred steps, so nothing is sorted.
    """
    spark = counts.sparkSession
    words = counts.where(F.length("word") > 0)
    step = F.when(F.col("n") < 1024, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 16) / 16 + 2048)
    hist = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("low")).collect()
    low, total = None, 0
    for h in sorted(hist, key=lambda h: -h.low):
        total += h.words
        if total > KNOWN:
            break
        low = h.low
    rows = words.where(F.col("n") >= low).collect() if low is not None else []
    rows.sort(key=lambda r: (-r.n, bytes(r.word)))
    known = [END, *(bytes(r.word) for r in rows)]
    end = counts.where(F.length("word") == 0).select("n").collect()
    count = np.array([end[0].n if end else 0, *(r.n for r in rows), *([0] * CLASSES)], np.int64)
    out = np.array([k if k <= TOP else word_class(w) for k, w in enumerate(known)] + list(range(TOP + 1, TOP + 1 + CLASSES)), np.int64)
    own, mass = np.zeros(TOP + 1 + CLASSES), np.full(TOP + 1 + CLASSES, 0.5)
    own[: min(TOP + 1, len(known))] = count[: min(TOP + 1, len(known))]
    common = spark.createDataFrame([(bytearray(w),) for w in known[: TOP + 1]], "word binary")
    tail = F.substring(F.col("word"), F.greatest(F.length("word") - 2, F.lit(1)), F.lit(3))
    rest = counts.join(F.broadcast(common), "word", "left_anti").groupBy((F.lit(TOP + 1) + F.pmod(F.crc32(tail), F.lit(CLASSES))).cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    for r in rest.collect():
        own[r.k], mass[r.k] = r.n, r.n + 0.5 * r.v + 0.5
    all_ = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    return Vocabulary(pa.array(known, pa.binary()), out, count, own, mass, int(all_.n or 0), int(all_.v or 0))


@dataclass
class Weights:
    """Vectors of the outputs, a bias for each, and for each place of the context a weight for each dimension."""

    r: np.ndarray  # context vectors, outputs x DIM
    q: np.ndarray  # target vectors, outputs x DIM
    c: np.ndarray  # ORDER x DIM
    b: np.ndarray


def initial(own: np.ndarray, seed: int = 9) -> Weights:
    """Small random vectors and, as biases, the log of the corpus frequencies: at first the model is the unigram model."""
    rng = np.random.default_rng(seed)
    n = len(own)
    p = (own + 0.5) / (own + 0.5).sum()
    return Weights(rng.normal(0, 0.1, (n, DIM)).astype(np.float32), rng.normal(0, 0.1, (n, DIM)).astype(np.float32), np.ones((ORDER, DIM), np.float32), np.log(p).astype(np.float32))


def train_nce(w: Weights, examples: np.ndarray, noise: np.ndarray, rate: float = RATE, seed: int = 0) -> Weights:
    """Noise-contrastive estimation: tell the true next words of a step from NOISE words drawn from the corpus frequencies.

    examples: rows (word before the last, last word, next word). The noise
    words are the same for all examples of a step, so their scores are a
    matrix product. The model's own normaliser is taken as 1, as is usual for
    this estimate. AdaGrad steps, with a rate for each output.
    """
    # an unpickled array has a type object of its own, with which numpy adds at places many times slower
    w = Weights(*(x.astype(np.float32) for x in (w.r, w.q, w.c, w.b)))
    rng, lanes = np.random.default_rng(seed), np.arange(DIM)
    cumulative, logk = np.cumsum(noise) / noise.sum(), np.log(NOISE * noise / noise.sum()).astype(np.float32)
    grad_r, grad_q, grad_b = (np.zeros(x.shape, np.float32) for x in (w.r, w.q, w.b))
    steps = [(x, g, np.full(len(x), 0.1, np.float32)) for x, g in ((w.r, grad_r), (w.q, grad_q), (w.b[:, None], grad_b[:, None]))]

    def add(to: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
        np.add.at(to.reshape(-1), (rows[:, None] * DIM + lanes).ravel(), grad.ravel())

    order = rng.permutation(len(examples))
    for lo in range(0, len(order), BATCH):
        before, last, target = examples[order[lo : lo + BATCH]].T.astype(np.int64)
        false = np.minimum(np.searchsorted(cumulative, rng.random(NOISE), "right"), len(noise) - 1)
        hidden = w.r[last] * w.c[0] + w.r[before] * w.c[1]
        true_q, false_q = w.q[target], w.q[false]
        # what the objective gains by a higher score
        up = 1 / (1 + np.exp(np.einsum("nd,nd->n", hidden, true_q) + w.b[target] - logk[target]))
        down = -1 / (1 + np.exp(-(hidden @ false_q.T + (w.b[false] - logk[false]))))
        back = up[:, None] * true_q + down @ false_q
        for _, g, _ in steps:
            g[:] = 0
        add(grad_r, last, back * w.c[0])
        add(grad_r, before, back * w.c[1])
        add(grad_q, target, up[:, None] * hidden)
        add(grad_q, false, down.T @ hidden)
        np.add.at(grad_b, target, up)
        np.add.at(grad_b, false, down.sum(axis=0))
        for x, g, squares in steps:
            squares += np.einsum("nd,nd->n", g, g) / g.shape[1]
            x += g * (rate / np.sqrt(squares))[:, None]
    return w


def pack_weights(w: Weights) -> np.ndarray:
    return np.concatenate([x.ravel() for x in (w.r, w.q, w.c, w.b)]).astype(np.float64)


def unpack_weights(raw: np.ndarray, outputs: int) -> Weights:
    raw = raw.astype(np.float32)
    a, b, c = outputs * DIM, 2 * outputs * DIM, 2 * outputs * DIM + ORDER * DIM
    return Weights(raw[:a].reshape(-1, DIM), raw[a:b].reshape(-1, DIM), raw[b:c].reshape(ORDER, DIM), raw[c:])


_IDS = pa.schema([("key", pa.int64()), ("ids", pa.binary())])
_CHUNKS = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])


def chunks(rows: DataFrame, vocab: Vocabulary, tokens_each: int = CHUNK_TOKENS) -> DataFrame:
    """(shard, part, ids): the outputs of all texts of rows(key, t), about so many in a row, as little-endian 16-bit numbers.

    A text's shard follows from its key and a shard's texts are in the order
    of their keys, so the same rows make the same chunks however they are
    partitioned. A shard of twice the size, as copies of one row would make,
    is cut.
    """
    spark = rows.sparkSession
    shards = max(1, round(vocab.n / tokens_each))
    shared = spark.sparkContext.broadcast(vocab)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES, 1 << 20):
                place, first, *_ = v.places(part.column("t"))
                ids = pa.py_buffer(v.out[place].astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * first).astype(np.int32)), ids])], schema=_IDS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, size = None, 0, [], 0
        for b in batches:
            for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if held and (shard != now or size > 4 * tokens_each):
                    yield batch_of(_CHUNKS, [now], [part], [b"".join(held)])
                    part, held, size = part + 1, [], 0
                if shard != now:
                    now, part = shard, 0
                held.append(ids)
                size += len(ids)
        if held:
            yield batch_of(_CHUNKS, [now], [part], [b"".join(held)])

    numbered = arrow(rows.select("key", "t"), number, "key long, ids binary").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return arrow(numbered.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "key").select("shard", "ids"), gather, "shard long, part int, ids binary")


def fit(rows: DataFrame, vocab: Vocabulary, tokens_each: int = CHUNK_TOKENS) -> Weights:
    """Train on rows(key, t): a model of each chunk, each position in one of ROUNDS rounds, averaged by their examples after each round.

    A round's models are summed in double precision by task and then on a few
    executors, so the driver gets a bounded number of models, whatever the
    number of tasks. Neither the partitions of rows nor their order matter
    (but for the order of those sums).
    """
    spark = rows.sparkSession
    weights = initial(vocab.own)
    noise = (vocab.own + 0.5) / (vocab.own + 0.5).sum()
    table = cut(chunks(rows, vocab, tokens_each))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, noise))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, noise = shared.value
            total, n = 0.0, 0
            for b in batches:
                for shard, part, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids = np.frombuffer(raw, "<u2").astype(np.int64)
                    examples = np.stack([*contexts(ids), ids], 1)[turn::ROUNDS].astype(np.int16)
                    if len(examples):
                        w = train_nce(start, examples, noise, seed=zlib.crc32(f"{shard} {part} {turn}".encode()))
                        total, n = total + pack_weights(w) * len(examples), n + len(examples)
            if n:
                yield batch_of(_COUNTS, [total.tobytes()], [n])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for b in batches:
                for raw, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total, n = total + np.frombuffer(raw, np.float64), n + k
            if n:
                yield batch_of(_COUNTS, [total.tobytes()], [n])

        models = arrow(arrow(table, run, "word binary, n long").repartition(8), add, "word binary, n long").collect()
        if models:
            weights = unpack_weights(sum(np.frombuffer(m.word, np.float64) for m in models) / sum(m.n for m in models), len(vocab.own))
    return weights


@dataclass
class Tables:
    """Log-probabilities by table: the score is linear in the places of the context, so a table for each place and one of normalisers is all."""

    place: np.ndarray  # ORDER x outputs x outputs: context word, next word
    bias: np.ndarray
    norm: np.ndarray  # outputs x outputs: natural log of the normaliser of each context

    def log_probability(self, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Natural log-probability of t after a and then b."""
        return self.place[1][a, t] + self.place[0][b, t] + self.bias[t] - self.norm[a, b]


def tables(w: Weights) -> Tables:
    """Batched matrix products over all contexts of two words; exact normalisers over all outputs."""
    place = np.stack([(w.r * w.c[k]) @ w.q.T for k in range(ORDER)])
    n = len(w.b)
    norm = np.empty((n, n), np.float32)
    # exp(place[1][a] + place[0][b] + bias) summed over outputs is a product of exponentials
    near, far = place[0] + w.b, place[1]
    top_near, top_far = near.max(axis=1), far.max(axis=1)
    left, right = np.exp(far - top_far[:, None], dtype=np.float64), np.exp(near - top_near[:, None], dtype=np.float64)
    for lo in range(0, n, 256):
        norm[lo : lo + 256] = np.log(np.maximum(left[lo : lo + 256] @ right.T, 1e-300)) + top_far[lo : lo + 256, None] + top_near[None, :]
    return Tables(place.astype(np.float32), w.b, norm)


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) for every row of docs.

    score is the base-10 log-probability of the text: the neural model gives
    each token's output, a word or a class, and a word of a class has the share
    of its count, c + 0.5, in the class; an unseen word has 0.5. base_score is
    the smoothed unigram model. The words that aren't known to every task meet
    their counts in a join; sums of each text's come back by its row's number.

    A null text counts as empty, whose one token is the end. Repeated rows each
    get a row; other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    shared = spark.sparkContext.broadcast((vocab, tables(weights)))  # bounded by KNOWN and the outputs
    listed = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, t = shared.value
        log_count, log_mass, done = np.log10(v.count + 0.5), np.log10(v.mass), TaskContext.get().partitionId() << 40
        log_count[len(v.words) :] = 0.0  # joined later
        for batch in batches:
            for part in slices(batch, "t", TEXT_BYTES, 1 << 20):
                place, first, odd, code, values = v.places(part.column("t"))
                ids, starts = v.out[place], first[:-1]
                p = t.log_probability(*contexts(ids), ids).astype(np.float64) / np.log(10.0)
                of_count = log_count[place]
                p += np.where(ids > TOP, of_count - log_mass[ids], 0.0)  # in a class, a word has its share of the class's mass
                # the words whose counts are to come, once for each text
                pair = np.sort((np.searchsorted(first, odd, "right") - 1 << 32) | code)
                at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
                words = pa.StructArray.from_arrays([values.take(pa.array(pair[at] & 0xFFFFFFFF)), pa.array(np.diff(np.append(at, len(pair))).astype(np.int32))], ["word", "tf"])
                offsets = pa.array(np.searchsorted(pair[at] >> 32, np.arange(part.num_rows + 1)).astype(np.int32))
                sums = [np.add.reduceat(x, starts) for x in (v.count[place] > 0, of_count, p)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("i"), pa.array(done + np.arange(part.num_rows)), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(offsets, words).cast(listed)],
                    names=["i", "row", "n_tokens", "known", "logs", "lm", "words"],
                )
                done += part.num_rows

    scored = cut(arrow(rows, run, f"i {kind}, row long, n_tokens long, known long, logs double, lm double, words array<struct<word:binary,tf:int>>"))
    found = scored.select("row", F.explode("words").alias("w")).select("row", "w.word", "w.tf").join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more_known")
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("words").join(found, "row", "left").select(
        F.col("i").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(vocab.n + 0.5 * (vocab.v + 1))))).alias("base_score"), (F.col("lm") + more).alias("score"),
    )


def score_held_out(docs: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows outside one fold of the ids and score all: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    fold = remainder(id_col, folds)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.where(fold != held).select(F.xxhash64(F.col(id_col), text).alias("key"), text.alias("t"))
    counts = cut(count_words(rows))
    vocab = vocabulary(counts)
    scored = score(docs, counts, vocab, fit(rows, vocab), id_col, text_col)
    return scored.select(id_col, (fold == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
