"""Candidate groups of more lines than a block, wide characters, and the recall of the bands."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import linededup
from tessera.llm.graph import components


def _jaccard(a, b):
    a, b = linededup.shingles(a), linededup.shingles(b)
    return len(a & b) / len(a | b)


def _union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


LETTERS = "abcdefghij klmno pqrst"


def _line(rng, n, letters=LETTERS):
    return "x" + "".join(rng.choice(letters) for _ in range(n - 2)) + "x"


def test_similar_pairs_are_exact():
    rng = random.Random(5)
    texts = [_line(rng, rng.randint(2, 120), letters) for letters in (LETTERS, "漢字かな交じり文é ", "aé\x00b") for _ in range(30)]
    texts += [t[:k] + "é" + t[k + 1 :] for t in texts[:60] for k in (len(t) // 2,)] + ["abc", "abc\x00\x00\x00\x00\x00", "a", "é", "漢"]
    for part in (texts, [t for t in texts if max(map(ord, t)) < 256 and "\x00" not in t]):
        s = linededup.Sets(part)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(part)), np.arange(len(part))))
        want = [_jaccard(part[i], part[j]) >= 0.8 for i, j in zip(a, b, strict=True)]
        assert s.similar(a, b, 0.8).tolist() == want and sum(want) > len(part) + 10


@pytest.mark.parametrize("block", [3, 1024])
def test_groups_of_many_blocks_lose_no_link(spark, block):
    rng = random.Random(9)
    texts = []
    for _ in range(4):  # crowds, and chains whose ends are far from the leader
        line = _line(rng, 160)
        texts += [line[:k] + "%" + line[k + 1 :] for k in range(10, 150, 12)]
        for _ in range(14):
            k = rng.randint(20, 140)
            line = line[:k] + rng.choice("XYZW") + line[k + 1 :]
            texts.append(line)
    texts = list(dict.fromkeys(t.lower() for t in texts))
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    edges = linededup.near_line_edges(df, block=block)
    keys = linededup.Lines(pa.array(texts)).keys().view(np.int64)
    got = {r.id: r.root for r in components(edges.select("a", "b")).collect()}
    n = len(texts)
    want = _union(n, [(i, j) for i in range(n) for j in range(i) if _jaccard(texts[i], texts[j]) >= 0.8])
    sets = {}
    for k in range(n):
        sets.setdefault(want[k], set()).add(got.get(int(keys[k, 0]), int(keys[k, 0])))
    assert all(len(x) == 1 for x in sets.values()) and len(set.union(*sets.values())) == len(sets) < n / 4
    assert {(r.a, r.a_check) for r in edges.collect()} <= set(map(tuple, keys.tolist()))


@pytest.mark.parametrize("length", [40, 60, 90, 140, 220, 400])
def test_bands_find_pairs_near_the_threshold(length):
    rng = random.Random(length)
    a, b = [], []
    while len(a) < 300:
        x = _line(rng, length)
        y = x[: rng.randint(length // 2, length)]  # a shorter line
        y = y + _line(rng, rng.randint(2, 12))
        if 0.8 <= _jaccard(x, y) <= 0.88:
            a.append(x)
            b.append(y)
    bands = [linededup._bands(x.signatures(np.arange(len(a)))) for x in (linededup.Lines(pa.array(a)), linededup.Lines(pa.array(b)))]
    assert (bands[0] == bands[1]).any(axis=1).mean() >= 0.97


def test_lines_of_odd_texts(spark):
    odd = ["", "\n", " \n\n", "a" + " " * 5000 + "b \n" + "\t" * 300 + "c" + " " * 300, "é\n漢\né", "same line of a text that is long enough\r\n" * 3, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)] + [(None, "same line of a text that is long enough"), (0, "c")], "doc_id long, text string")
    got = {(r.doc_id, r.kept_text): (r.n_lines, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert got == {
        (0, ""): (1, 0), (1, "\n"): (2, 0), (2, " \n\n"): (3, 0), (3, odd[3].split("\n")[0]): (2, 1), (4, "é\n漢"): (3, 1),
        (5, "same line of a text that is long enough\r\n"): (4, 2), (6, None): (0, 0), (None, ""): (1, 1), (0, "c"): (1, 0),
    }
