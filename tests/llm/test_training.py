"""What the language model's neural part learns from, and that neither the layout of the rows nor long words matter."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lblm


def _moved(spark, *parts):
    """How far training moves the context vector of each word."""
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda p: [(t,) for t in p]), "t string").withColumn("key", F.xxhash64("t"))
    vocab = lblm.vocabulary(lblm.count_words(df).cache())
    w, start = lblm.fit(df, vocab), lblm.initial(vocab.own)
    return {k.decode(): float(np.abs(w.r[vocab.out[p]] - start.r[vocab.out[p]]).max()) for p, k in enumerate(vocab.words.to_pylist())}


def test_every_position_trains(spark):
    # each word is a context of the one after it, so it moves only if that position is an example
    moved = _moved(spark, ["a b", " ".join(f"w{k}" for k in range(20))])
    assert len(moved) == 23 and all(moved.values())


def test_chunks_hold_all_texts_whatever_the_layout(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["x y z"] * 200
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i long, t string").withColumn("key", F.xxhash64("t"))
    vocab = lblm.vocabulary(lblm.count_words(df).cache())
    found = []
    for n in (1, 7):
        rows = lblm.chunks(df.repartition(n).orderBy(F.rand(n)) if n > 1 else df, vocab, tokens_each=100).collect()
        found.append(sorted((r.shard, r.part, bytes(r.ids)) for r in rows))
    assert found[0] == found[1] and len(found[0]) > 10 and max(len(x) for _, _, x in found[0]) < 6 * 100 * 2
    ends = sum((np.frombuffer(x, "<u2") == 0).sum() for _, _, x in found[0])
    assert ends == len(texts) and sum(len(x) // 2 for _, _, x in found[0]) == vocab.n == sum(len(t.split()) + 1 for t in texts)


def test_contexts_stop_at_the_ends_of_texts():
    before, last = lblm.contexts(np.array([5, 6, 7, 0, 0, 8, 9, 0]))
    assert last.tolist() == [0, 5, 6, 7, 0, 0, 8, 9] and before.tolist() == [0, 0, 5, 6, 0, 0, 0, 8]


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of a few hundred words in which each word limits the next."""
    rng = random.Random(3)
    nxt = {k: [rng.randint(0, 299) for _ in range(6)] for k in range(300)}
    rows = []
    for i in range(700):
        k, words = rng.randint(0, 299), []
        for _ in range(60):
            words.append(f"w{k}")
            k = rng.choice(nxt[k])
        rows.append((i, " ".join(words)))
    rows += [(1000, "q" * 70 + " " + "w5 " * 3), (1001, "Q" * 70 + " " + "r" * 200), (1002, None), (1002, None), (1003, "  w1\x0b\n w2\t"), (1003, "  w1\x0b\n w2\t")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_layouts_agree_and_the_model_beats_the_counts(spark, corpus):
    df, rows = corpus
    one, many = ({(r.doc_id, r.n_tokens): r for r in lblm.score_held_out(x).collect()} for x in (df.coalesce(1), df.repartition(13)))
    assert one.keys() == many.keys()
    assert all(one[k].base_score == pytest.approx(many[k].base_score) and one[k].score == pytest.approx(many[k].score, rel=1e-3) for k in one)
    out = [r for r in many.values() if r.held_out]
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / tokens > sum(r.base_score for r in out) / tokens + 0.3


def test_counts_of_odd_words(spark, corpus):
    df, rows = corpus
    got = collections.defaultdict(list)
    for r in lblm.score_held_out(df).collect():
        got[r.doc_id].append(r)
    train = [(t or "") for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = collections.Counter(w for t in train for w in lblm.tokens(t.encode()))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows[-6:]:
        words = lblm.tokens((t or "").encode())
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n) and r.base_score == pytest.approx(base)
    assert len(got[1002]) == len(got[1003]) == 2
