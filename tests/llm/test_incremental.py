"""Batches against brute force over all batches so far."""

import collections
import random

import pytest

from tessera.errors import CommitConflict
from tessera.llm import runstore, substring
from tessera.llm.runs import RUN_SCHEMA
from tessera.llm.runstore import RunStore

SCHEMA = "doc_id long, text string"


def test_substring_by_batches(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    shared = [words(30) for _ in range(6)]
    store, seen, at, removed = RunStore(spark, f"file://{tmp_path}/store"), collections.Counter(), 0, []
    for k in range(4):
        texts = [words(rng.randint(0, 60)) for _ in range(25)]
        for p in range(k, k + 3):  # passages of this batch, the one before and the next
            for _ in range(2 if p == k else 1):
                texts.append(words(15) + shared[p] + words(9))
        texts.append(["same"] + shared[0][:22] + ["row"])
        rows = [(at + j, " ".join(w)) for j, w in enumerate(texts)] + [(at + 90, None), (None, " ".join(shared[1]))] + [(7, "x " + " ".join(shared[5]))]
        at += 100
        seen.update(tuple((t or "").split()[s : s + 20]) for _, t in rows for s in range(len((t or "").split()) - 19))
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), window=20, store=store).collect())
        want = collections.Counter()
        for i, t in rows:
            w = (t or "").split()
            gone = [any(seen[tuple(w[s : s + 20])] > 1 for s in range(max(0, j - 19), min(j, len(w) - 20) + 1)) for j in range(len(w))]
            want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
        assert got == want, k
        removed.append(sum(x[2] * n for x, n in got.items()))
        if k in (1, 2):
            monkeypatch.setattr(runstore, "BUCKET_BYTES", 64 if k == 2 else 1 << 20)
            old = store.latest()
            before = store.runs(old.runs).where("n >= 0").count()
            store.compact()
            now = store.latest()
            assert (len(now.runs), len(now.texts), now.batches) == (1, 1, k + 1) and (store.runs(now.runs).where("n >= 0").count() < before) == (k == 1) == (now.buckets == old.buckets)
    assert all(removed) and not (tmp_path / "store" / old.runs[0]).exists()
    with pytest.raises(ValueError):
        substring.remove_repeats(spark.createDataFrame([], SCHEMA), window=21, store=store)
    with pytest.raises(CommitConflict):
        store.commit(old, store.write(spark.createDataFrame([], RUN_SCHEMA), spark.createDataFrame([], "k1 long, k2 long, t string")))


def test_words_with_equal_rolling_hashes(spark):
    """Two words of the letters a and b in the order of the Thue-Morse sequence, and with a and b exchanged: no polynomial modulo 2**64 tells them apart."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    one, other = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    around = " ".join(f"w{k}" for k in range(34))
    df = spark.createDataFrame([(1, f"{one} {around}"), (2, f"{other} {around}"), (3, f"x {one} {around}"), (4, around)], SCHEMA)
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(df, window=35).collect()}
    assert got == {1: 35, 2: 0, 3: 35, 4: 0}
