"""Texts without digits and at signs get the spans that the generators and the model give without any gate."""

import random

from tessera.llm import pii


def test_find_equals_ungated_spans(spark):
    rng, model = random.Random(3), pii.train()
    texts = ["write to jane at example (dot) com today", "mail jane at example [dot] com now", "contact jane at example.com soon", "reach jane at example dot com", "see abcd:beef:cafe:face:abba:dead:beef:cafe there", "mail jane\u2003AT\u2003example.org", "no such thing", ""]
    for text, _, _ in pii.examples(400, seed=11):
        texts.append("".join(" " if c.isdigit() or c == "@" else c for c in text))
    for _ in range(300):
        texts.append("".join(rng.choice([" at ", "(at)", "[ at ]", " AT\n", " dot ", "(dot)", ".", ":", "ab", "cafe", "com", " ", "{"]) for _ in range(rng.randint(1, 12))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(df, model).collect()}
    want = {k: pii.joined(b + pii.added_spans(t, b, model)) for k, t in enumerate(texts) for b in [pii.base_spans(t)]}
    assert got == want and sum(map(bool, want.values())) > 20 and want[0] and want[1]
