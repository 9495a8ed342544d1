"""The parts of the FM-index against plain versions, and whole shards of odd texts."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import fmindex


@pytest.mark.parametrize("seed", range(5))
def test_suffix_order(seed):
    rng = random.Random(seed)
    texts = [[rng.randint(1, 3) for _ in range(rng.randint(0, 40))] for _ in range(12)]
    texts += [texts[0], texts[0] * 4, [1] * 70, [1] * 69, []]
    flat = np.array([x for t in texts for x in [*t, 0]])
    ends = {p: k for k, p in enumerate(np.flatnonzero(flat == 0).tolist())}
    plain = sorted(range(len(flat)), key=lambda s: [(0, ends[p]) if v == 0 else (1, v) for p, v in zip(range(s, len(flat)), flat[s:].tolist(), strict=True)])
    assert fmindex.suffix_order(flat, 3).tolist() == plain


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        s = rng.integers(0, 37, n)
        tree = fmindex.WaveletTree(s, 36)
        symbol, at = rng.integers(0, 40, 200) % 37, rng.integers(0, n + 1, 200)
        assert tree.rank(symbol, at).tolist() == [(s[:b] == a).sum() for a, b in zip(symbol, at, strict=True)]
        got, rank = tree.access(np.arange(n))
        assert got.tolist() == s.tolist() and rank.tolist() == [(s[:k] == s[k]).sum() for k in range(n)]


def test_search_of_a_shard():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["é", "漢字", "A", "b-c"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"i{k % 9}", text(rng.randint(0, 16)).encode()) for k in range(30)] + [("x", b"w1"), ("y", b""), ("z", b"only here 12345")]
    docs = [text(rng.randint(0, 200)) for _ in range(40)] + [None, "", " ", "w1", "unknown " * 500, items[3][1].decode() * 3]
    docs[5] = docs[6]
    p = fmindex.Phrases(items)
    size, hit, found = fmindex.search(pa.array(docs, pa.string()), p, p.known())
    windows = collections.defaultdict(set)
    for name, raw in items:
        w = fmindex.words_of(raw)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(name)
    for k, t in enumerate(docs):
        w = fmindex.words_of((t or "").encode())
        cover, names = np.zeros(len(w), bool), set()
        for x, who in windows.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    cover[s : s + len(x)] = True
                    names |= who
        assert size[k] == len(w) and hit[k].tolist() == cover.tolist() and {p.names[i] for i in found[k]} == names


def test_no_items_and_no_words():
    p = fmindex.Phrases([])
    size, hit, found = fmindex.search(pa.array(["a b", None]), p, p.known())
    assert size.tolist() == [2, 0] and not hit[0].any() and not len(found[0])
    p = fmindex.Phrases([("a", b"x")])
    assert fmindex.search(pa.array(["", None], pa.string()), p, p.known())[0].tolist() == [0, 0]
