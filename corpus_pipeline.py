"""The corpus pipeline: stages over documents, each written and read again.

Language identification, line deduplication, near-duplicate removal,
benchmark decontamination, and packing into sequences. Every stage takes all
that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fmindex, langid, linededup, packing, simhash
from tessera.llm.common import cut
from tessera.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language the calibrated model can't tell, go.

    The model learns from the stage's own documents with a known language. The
    lang column stays as it is. A null text goes; repeated rows are judged alike.
    """
    found = langid.identify(docs, langid.fit(docs), carry=["text", "lang", "source", "n_chars"])
    return found.where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a line before them resembles go; so does a document of which only blank lines are left by that.

    n_chars is counted anew. A text that was null or blank stays as it is.
    """
    found = linededup.dedup_lines(docs, carry=["lang", "source"])
    left = F.coalesce(F.col("n_removed") == 0, F.lit(True)) | F.col("kept_text").rlike(r"[^ \t\n\x0B\f\r]")
    return found.where(left).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the one with the smallest id, null ids last.

    Rows are told apart by a number of their own, so repeated rows are a group
    and equal ids with different texts are not. Of equal ids the smallest hash
    of the text decides, then that of the other columns, then the number.
    """
    rows = cut(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("lang", "source", "n_chars").alias("other_hash"), "row")
    groups = simhash.near_duplicates(rows, id_col="row").join(rows.select("row", key.alias("key")), "row")
    kept = groups.groupBy("component_id").agg(F.min("key").alias("key")).select("key.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that hold windows of benchmark items are cut out; n_chars is counted anew."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = fmindex.find_phrases(docs, benchmark, carry=["lang", "source"])
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents left: a row for each piece and its place."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: SQL can't express a trained model, the signatures or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
