"""The pipeline's stages on a small corpus, and what each must have done."""

import corpus_pipeline as p


def test_stages(spark, tmp_path):
    line = "a line that many of these documents share with each other"
    texts = [f"{line}\n" + " ".join(f"word{k}x{j} the and of" for j in range(30)) for k in range(6)]
    texts += [texts[0], "12345 !!!", None, "exam " + " ".join(f"q{k}" for k in range(12)) + " end of it"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(12)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in p.STAGES[:-1]:
        docs = p.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == p.COLUMNS
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["language_id"]) == {0, 1, 2, 3, 4, 5, 6, 9}
    assert line in seen["line_dedup"][0].text and all(line not in seen["line_dedup"][k].text for k in range(1, 6)) and 6 not in seen["line_dedup"]
    assert all(r.n_chars == len(r.text) for r in seen["decontaminate"].values())
    assert seen["decontaminate"][9].text == "exam  end of it"
    packed = p.pack(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["decontaminate"]) and len({r.sequence_id for r in packed}) == 1
