"""Fingerprints against a plain loop over the published hash, and ids that are no numbers."""

import random

import xxhash

from tessera.llm import simhash


def _plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    pieces = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    votes = [0] * 64
    for p in pieces:
        h = xxhash.xxh64(p.encode("utf-8"), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(pieces))


def test_fingerprints_and_text_ids(spark):
    rng = random.Random(2)
    words = ["An", "the", "ÉTÉ", "über", "ñu", "x\u00a0y", "\x1c", "漢字", "A"]
    seps = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r"]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \n", "one", "one two", "a b a b a b a b", "w " * 300_000, texts[0].upper().replace("É", "é"), texts[1]]
    rows = [(f"id-{k}", t) for k, t in enumerate(texts)] + [(None, texts[3])]
    got = {}
    for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect():
        got[r.doc_id] = r
    for i, t in rows[:-1]:
        assert got[i].fingerprint == f"{_plain(t):016x}", i
    n = len(rows)
    prints = [_plain(t) for _, t in rows]
    root = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    for k, (i, _) in enumerate(rows):
        assert got[i].component_id == min(x for x, _ in (rows[j] for j in range(n) if root[j] == root[k]) if x is not None)
