"""Rows without an id and repeated rows in the pipeline's stage of near duplicates."""

import collections

import corpus_pipeline as p


def test_near_dedup_keeps_one_row_of_each_group(spark):
    texts = [" ".join(f"{w}{k}x{j}" for j in range(60)) for k, w in enumerate(("red", "oak", "sea", "fig", "sun", "elk"))]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (2, texts[2])]
    rows += [(3, texts[3]), (4, texts[3]), (4, texts[4]), (5, texts[4]), (None, texts[5])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = p.near_dedup(spark, df, "")
    assert got.columns == p.COLUMNS
    want = [(None, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[3]), (4, texts[4]), (None, texts[5])]
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(want)


def test_stages_take_odd_tables(spark, tmp_path):
    """No rows at all; nulls in every column; repeated rows; an empty benchmark; one very long text."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = spark.createDataFrame([], kind)
    for name, stage in p.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    long_ = " ".join(f"word{k % 977} of the house" for k in range(120_000))
    same = (7, "the same row twice, with the words of a house and a garden in it", "en", "s", 63)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, long_, "en", "s", len(long_)), same, same, (None, "a row without an id, of the house and the water", "en", None, None)]
    docs = spark.createDataFrame(rows, kind)
    for _, stage in p.STAGES[:-1]:
        docs = p.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == p.COLUMNS
    left = collections.Counter(r.doc_id for r in docs.collect())
    assert left == {2: 1, 7: 1, None: 1}
    packed = p.pack(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {2, 7, None} and max(r.length for r in packed) == 4096
