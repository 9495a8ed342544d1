"""Quality votes against plain numpy, held-out accuracy of both classifiers, and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import langid, quality

WORDS = {"en": ["the", "and", "with", "house", "water", "through", "night", "which", "there", "again"], "de": ["der", "und", "mit", "haus", "wasser", "durch", "nacht", "welche", "wieder", "über"], "fr": ["le", "et", "avec", "maison", "eau", "par", "nuit", "lequel", "encore", "très"]}


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def _quality_rows(rng, n):
    good = lambda: ". ".join(_text(rng, "en", rng.randint(5, 12)).capitalize() for _ in range(6))
    bad = lambda: " | ".join(rng.choice(["BUY!!!", "$$$", "click", "##", "&&&"]) for _ in range(60))
    return [(k, good() if k % 2 else bad()) for k in range(n)]


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(2)
    x = np.abs(rng.standard_normal((60, quality.WIDTH)))
    y = rng.integers(0, 2, 60).tolist()
    space = quality.build(x, y)
    new = np.abs(rng.standard_normal((33, quality.WIDTH)))
    got = space.score(new, block=10)
    t = np.concatenate([x, new])
    terms = t[:, : quality.TERMS] * space.idf
    terms /= np.linalg.norm(terms, axis=1, keepdims=True)
    form = np.clip((t[:, quality.TERMS :] - x[:, quality.TERMS :].mean(0)) / x[:, quality.TERMS :].std(0), -3, 3) * (quality.FORM_WEIGHT / (3 * (quality.WIDTH - quality.TERMS)) ** 0.5)
    place = np.concatenate([terms, form], 1) @ space.axes
    for k, z in enumerate(place[60:]):
        cos = sorted(((float(z @ v / np.linalg.norm(z) / np.linalg.norm(v)), j) for j, v in enumerate(place[:60])), reverse=True)[: quality.VOTERS]
        weight = [min(1.0, max(1e-6, c)) ** quality.SHARPNESS for c, _ in cos]
        assert got[k] == pytest.approx(sum(w * y[j] for w, (_, j) in zip(weight, cos, strict=True)) / sum(weight))


def test_quality_of_held_out_rows(spark):
    rng = random.Random(1)
    rows = _quality_rows(rng, 240)
    docs = spark.createDataFrame([*rows, *rows[:5], (500, None), (501, ""), (502, "word " * 600_000), (None, "no id")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k, _ in rows] + [(k, int(k % 2), 1) for k, _ in rows[:20]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_held_out(docs, labels).collect()
    assert len(got) == 249 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    again = {(r.doc_id, r.score) for r in quality.score_held_out(docs.repartition(2), labels.repartition(5)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_conflicting_labels_and_texts_have_a_rule(spark):
    rows = _quality_rows(random.Random(3), 60)
    docs = spark.createDataFrame([*rows, (1, "another text of id 1"), (1, "and a third")], "doc_id long, text string")
    twice = [(k, int(k % 2)) for k, _ in rows] + [(1, 0), (5, 0)]
    spaces = [quality.fit(docs.repartition(n), spark.createDataFrame(twice, "doc_id long, quality int").repartition(n)) for n in (1, 6)]
    assert (spaces[0].voters == spaces[1].voters).all() and len(spaces[0].votes) == 60 and spaces[0].votes.sum() == 28


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.score_held_out(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert langid.identify_held_out(none).count() == 0
    some = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify_held_out(some).collect()] == [("und", 0.0)]


def test_languages_of_held_out_rows(spark):
    rng = random.Random(5)
    rows = [(k, _text(rng, lang, rng.randint(3, 60)), lang) for k, lang in enumerate(list(WORDS) * 70)]
    rows += rows[:4] + [(900, "... 12 !", "en"), (901, None, "en"), (902, "", "fr"), (903, _text(rng, "de", 200_000), "de"), (904, "x", None), (None, _text(rng, "fr", 30), "fr"), (905, "漢字" * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = langid.identify_held_out(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {k: lang for k, _, lang in rows[:210]} | {903: "de"}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"}
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify_held_out(df.coalesce(1)).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in got}


def test_scores_are_the_tables_means():
    model = langid.train([_text(random.Random(k), lang, 30).encode() for k, lang in enumerate(list(WORDS) * 30)], list(WORDS) * 30)
    raw = "Wasser und über the house".encode()
    d = np.frombuffer(raw, np.uint8)
    total, n = np.zeros(3), 0
    for h, _ in langid.subwords(d, np.array([0, len(d)])):
        total, n = total + model.table[:, h].astype(float).sum(1), n + len(h)
    p = np.exp(total / n * model.scale)
    best, score, _ = model.predict(np.concatenate([d, d]), np.array([0, len(d), 2 * len(d)]))
    assert score == pytest.approx([(p / p.sum()).max()] * 2) and best.tolist() == [int(p.argmax())] * 2


def test_long_texts_are_trained_on_all_over():
    raw = bytes(range(65, 91)) * 40_000
    part = langid.spread(raw)
    assert len(part) <= langid.STRETCH * langid.STRETCHES and langid.spread(raw[:1000]) == raw[:1000]
    assert langid.spread(b"a" * 500_000 + b"b" * 500_000).count(b"b") > 0.4 * len(part)
