"""A training corpus from raw documents, in five stages; each works on all that the one before kept.

Stages decide on rows, which a doc_id and a hash of the text tell apart: null and repeated ids are treated as others are. Repeated rows count once from the
second stage on. Empty tables give empty tables, and further columns come along until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.byte_bpe import bpe_round_trip
from sedimenta.llm.decontaminate import contaminated
from sedimenta.llm.language_id import fit_languages, groups
from sedimenta.llm.near_dedup import near_duplicates
from sedimenta.llm.queries import SURROGATE_KEY, VOCABULARY
from sedimenta.llm.rows import filter_rows, rewrite_column
from sedimenta.sources.scratch import Scratch
from sedimenta.llm.surrogates import Replacer, settle, surrogate_table


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that are not among found (doc_id, text_hash)."""
    gone = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash")), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and lies near enough to a language's centroid."""
    model = spark.sparkContext.broadcast(fit_languages(docs))
    return filter_rows(docs, "text", lambda column: [ok for texts in groups(column) for ok in model.value.predict(texts)[2]])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies; of repeated rows one."""
    scratch = Scratch(spark, "found")
    found = scratch.keep(near_duplicates(docs).select("doc_id", "text_hash", "stays"), "rows")
    left = without(docs, found.where(~F.col("stays")))
    repeated = found.where("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with surrogates for personal data, and their length."""

    settled = settle(surrogate_table(docs, SURROGATE_KEY), SURROGATE_KEY)

    def change():
        replace = Replacer(SURROGATE_KEY, settled)
        return lambda text: replace(text)[0]

    done = rewrite_column(docs, "text", change)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of token ids, and the hashes of the ids and of what they decode to."""
    return bpe_round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("pii_surrogates", without_personal_data),
    ("byte_bpe", tokens),
]
#: Alignment, surrogates and BPE have no SQL; tests/llm/test_pipeline.py runs all stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
