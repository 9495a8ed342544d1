"""Each operator against a brute-force version on a small corpus with the awkward cases in it."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import fmindex, graph, langid, lblm, linededup, packing, pii, quality, rpforest, simhash, substring
from tessera.llm.queries import tokenizer_path

RNG = random.Random(4)
WORDS = ["an", "the", "ion", "ère", "über", "ñu", "re", "on,", "At", "en.", "nd", "ti"]


def _text(n):
    return " ".join("".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 3))) for _ in range(n))


LONG = _text(3000)
PASSAGE = _text(45)
TEXTS = [_text(RNG.randint(5, 120)) + "\n" + _text(12) for _ in range(40)]
TEXTS += [TEXTS[0], TEXTS[0], TEXTS[1] + " x", None, "", " \n\t ", "one", "A a\na A", LONG, LONG[:4000], PASSAGE + " " + TEXTS[2], TEXTS[3] + " " + PASSAGE + "\n" + TEXTS[4].split("\n")[1], "12.5.9.300 +1 (509) 555-6973 a.b@c.de @ 4111 1111 1111 1111"]
IDS = list(range(len(TEXTS)))
EMPTY = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", None, 1) for i, t in zip(IDS, TEXTS, strict=True)] + [(None, "no id here", None, None, 1), (3, TEXTS[3], "de", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, t string, i string, key int").repartition(3)


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


def test_components(spark):
    edges = [(RNG.randint(0, 60), RNG.randint(0, 60)) for _ in range(45)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame([*edges, (5, 5), (None, 3)], "a long, b long")).collect()}
    want = _union(61, edges)
    assert got == {v: want[v] for e in edges if e[0] != e[1] for v in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs, spark):
    got = collections.defaultdict(set)
    for r in simhash.near_duplicates(docs).collect():
        got[r.doc_id].add((r.fingerprint, r.component_id))
    prints = [simhash.fingerprint((t or "").encode()) for t in TEXTS]
    pairs = [(a, b) for a in IDS for b in IDS if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = _union(len(IDS), pairs)
    assert all(got[i] == {(f"{prints[i]:016x}", want[i])} for i in IDS)
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 16])
def test_simhash_tiles(spark, block):
    """Small tiles, and keys with more rows than a tile."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 300)
    near = np.concatenate([base, base[:150] ^ (1 << rng.integers(0, 60, 150)), base[0] ^ (1 << np.arange(60))])
    roots = {r.id: r.root for r in graph.components(simhash.links(spark.createDataFrame([(int(x),) for x in np.unique(near)], "fp long"), 3, tile=16, block=block)).collect()}
    u = np.unique(near)
    i, j = np.nonzero(np.bitwise_count(u[:, None].view(np.uint64) ^ u[None, :].view(np.uint64)) <= 3)
    want = _union(len(u), zip(i, j, strict=True))
    assert all(roots.get(int(x), int(x)) == int(u[want[k]]) for k, x in enumerate(u))


def test_substring(docs, spark):
    got = {r.doc_id: r for r in substring.remove_repeats(docs, window=20).collect()}
    words = [(i, (t or "").encode().split()) for i, t in [*zip(IDS, TEXTS, strict=True), (None, "no id here"), (3, TEXTS[3])]]
    seen = collections.Counter(tuple(w[s : s + 20]) for _, w in words for s in range(len(w) - 19))
    for i, w in words:
        gone = [any(seen[tuple(w[s : s + 20])] > 1 for s in range(max(0, k - 19), min(k, len(w) - 20) + 1)) for k in range(len(w))]
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert substring.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    cyclic = spark.createDataFrame([(1, "a b c " * 40), (2, "x " * 34)], EMPTY)
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(cyclic).collect()} == {1: 120, 2: 0}


def test_lines(docs, spark):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    ids = [*IDS, 3]
    lines = [(i, k, x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()) for i in ids for k, x in enumerate((TEXTS[i] or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    distinct = list(dict.fromkeys(x[2] for x in lines))
    sets = [linededup.shingles(x) for x in distinct]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = dict(zip(distinct, _union(len(distinct), pairs), strict=True))
    first = {}
    for i, k, x in sorted(lines):
        first.setdefault(root[x], (i, k))
    for i in IDS:
        gone = {k for a, k, x in lines if a == i and first[root[x]] != (i, k)}
        want = None if TEXTS[i] is None else "\n".join(x for k, x in enumerate(TEXTS[i].split("\n")) if k not in gone)
        assert (got[i].kept_text, got[i].n_removed) == (want, len(gone)), i
    assert linededup.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_phrases(docs, spark, block):
    items = [("a", PASSAGE), ("b", " ".join(PASSAGE.split()[5:30])), ("c", "one"), ("d", ""), ("e", None), (None, "no id here"), ("b", "nothing of the kind")]
    got = {r.doc_id: r for r in fmindex.find_phrases(docs, spark.createDataFrame(items, "item_id string, text string"), block_bytes=block, carry=["t"]).collect()}
    windows = collections.defaultdict(set)
    for name, t in items:
        w = fmindex.words_of((t or "").encode())
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(name or "null")
    for i, t in zip(IDS, TEXTS, strict=True):
        w = fmindex.words_of((t or "").encode())
        hit, names = set(), set()
        for x, who in windows.items():
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    names |= who
        r = got[i]
        assert (r.n_words, sum(b - a for a, b in r.hit_spans), r.item_ids) == (len(w), len(hit), sorted(names)), i
        assert r.clean_text == t if not hit else len(fmindex.words_of(r.clean_text.encode())) == len(w) - len(hit)
        assert i == 3 or r.t == ("en" if i % 2 else "de")
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.hit_spans for r in fmindex.find_phrases(docs, none).collect())
    assert fmindex.find_phrases(spark.createDataFrame([], EMPTY), none).count() == 0


def test_fm_index_against_search():
    rng = np.random.default_rng(0)
    s = np.append(rng.integers(0, 5, 400), 0)
    index = fmindex.FMIndex(s, 4)
    patterns = np.array([[1, 2, 0], [3, 3, 3], [4, 0, 0], [2, 1, 4]])
    lengths = np.array([2, 3, 1, 3])
    lo, hi = index.count(patterns, lengths)
    for k in range(4):
        want = [p for p in range(len(s) - lengths[k] + 1) if (s[p : p + lengths[k]] == patterns[k, : lengths[k]]).all()]
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_packing(docs, spark):
    from tokenizers import Tokenizer

    got = packing.pack(docs, tokenizer_path(), capacity=256).collect()
    t = Tokenizer.from_file(tokenizer_path())
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, text in zip(IDS, TEXTS, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
        assert sorted(set(by[i])) == want
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    assert len(used) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack(spark.createDataFrame([], EMPTY), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 10) for _ in range(9)]

    def optimum(left, bins=()):
        if not left:
            return len(bins)
        x, rest = left[0], left[1:]
        tries = [optimum(rest, tuple(sorted([*bins[:k], bins[k] - x, *bins[k + 1 :]]))) for k in range(len(bins)) if bins[k] >= x and bins[k] not in bins[:k]]
        return min([*tries, optimum(rest, tuple(sorted([*bins, 10 - x])))])

    count = np.bincount(items, minlength=11)
    fixed = packing.reduce_dominated(count, 10)
    left = [w for w in range(1, 11) for _ in range(count[w])]
    assert sum(n for n, _ in fixed) + optimum(sorted(left, reverse=True)) == optimum(sorted(items, reverse=True))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.03 * rng.standard_normal((30, 16)), base[:5], np.repeat(base[:1], 40, 0) + 0.01 * rng.standard_normal((40, 16))]).astype(np.float32)
    rows = [(k, [float(v) for v in r], k % 2 if k < 60 else (k - 60) % 2 if k < 90 else (k - 90) % 2 if k < 95 else 0, None) for k, r in enumerate(x)]
    odd = [(900, None, 0, None), (901, [0.0] * 16, 0, None), (902, [1.0, None] + [0.0] * 14, 0, None), (903, [float("nan")] * 16, 0, None), (904, rows[0][1], None, None), (905, [], 0, None), (906, [1.0, 2.0], 0, None), (907, [2.0, 4.0], 0, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rpforest.near_duplicates(df, leaf=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = _union(len(x), np.argwhere(near).tolist())
    want = {k: (int(near[k].sum()), root[k], root[k] == k) for k in range(len(x))}
    assert sum(got[k] == want[k] for k in want) >= 0.9 * len(want)
    assert all(got[k][0] <= want[k][0] for k in want)
    assert all(got[k] == (0, k, True) for k in range(900, 906)) and got[906] == (1, 906, True) and got[907] == (1, 906, False)
    assert rpforest.near_duplicates(df.limit(0)).count() == 0


def test_language_model(docs, spark):
    full = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in lblm.score_held_out(full).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in IDS}
    counts = collections.Counter(w for i in IDS if not held[i] for w in lblm.tokens((TEXTS[i] or "").encode()))
    n, v = sum(counts.values()), len(counts)
    for i in IDS:
        t = lblm.tokens((TEXTS[i] or "").encode())
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(w in counts for w in t), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0
    assert lblm.score_held_out(spark.createDataFrame([], EMPTY)).count() == 0


def test_language_model_is_normalised():
    w = lblm.train_nce(lblm.initial(np.arange(lblm.TOP + 1 + lblm.CLASSES, dtype=float)), np.random.default_rng(0).integers(0, 50, (2000, 3)), np.ones(lblm.TOP + 1 + lblm.CLASSES) / (lblm.TOP + 1 + lblm.CLASSES))
    t = lblm.tables(w)
    every = np.arange(len(w.b))
    for a, b in ((0, 0), (3, 17), (1200, 5)):
        p = np.exp(t.log_probability(np.full(len(every), a), np.full(len(every), b), every).astype(float))
        assert p.sum() == pytest.approx(1, abs=1e-3)


def test_language_id(spark):
    en, de = ["the and of ing tion er"] * 30, ["der die und ung lich ein"] * 30
    rows = [(k, f"{t} {k}", y, None) for k, (t, y) in enumerate([(t, "en") for t in en] + [(t, "de") for t in de])] + [(100, None, "en", None), (101, "12 34 !", None, None), (102, "", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, letters string")
    got = {r.doc_id: r for r in langid.identify_held_out(df).collect()}
    assert all(got[k].lang_pred == rows[k][2] for k in range(60)) and all(0 <= r.score <= 1 for r in got.values())
    assert all((got[k].lang_pred, got[k].rejected) == ("und", True) for k in (100, 101, 102))
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_quality(spark):
    good, bad = [_text(40) for _ in range(40)], [" | ".join(_text(1) + "$$$" for _ in range(30)) for _ in range(40)]
    rows = [(k, t, None) for k, t in enumerate(good + bad)] + [(200, None, None), (201, "", None), (202, "x" * 100000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)] + [(None, 1, 0), (81, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_held_out(df, labels).collect()}
    assert all(got[k].predicted == int(k < 40) for k in range(80)) and all(0 <= got[k].score <= 1 for k in (200, 201, 202))
    assert {r.score for r in quality.score_held_out(df, labels.limit(0)).collect()} == {0.5}


def test_pii(docs, spark):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    last = got[len(TEXTS) - 1]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 0, 1, 1)
    assert last.spans == "phone:11:28,email:29:37,card:40:59" and "[card]" in last.redacted
    assert got[IDS[TEXTS.index(None)]].redacted is None and got[0].redacted == TEXTS[0] and got[0].spans == ""
    assert pii.find(spark.createDataFrame([], EMPTY)).count() == 0


def test_pii_rules_on_hard_texts():
    import re

    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice("ab@.@+-1234567890  ()é\n") for _ in range(rng.randint(0, 60)))
        want = []
        for kind, pattern in rules:
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m.group())
                if (kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)):
                    want.append((kind, *m.span()))
        assert sorted(pii.base_spans(text)) == sorted(want)
