"""The queries opN_<name>: each applies one operator to its whole table.

They only pick the columns of the contract; the operators have the general
interfaces. SQL is given where DuckDB can express a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fmindex, langid, lblm, linededup, packing, pii, quality, rpforest, simhash, substring
from .runstore import RunStore
from .sql import SQL

#: A public BPE vocabulary with word ends, as the tokenizers library reads it.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"), with_redacted=False)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.score_held_out(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.find_phrases(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = RunStore.scratch(spark)  # the whole table is its first batch
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False, store=store)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality_classifier, op3_embedding_near_dedup, op4_simhash_near_dedup, op5_best_fit_packing, op6_lm_scoring, op7_language_id, op8_benchmark_decontamination, op9_line_dedup, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
