"""A corpus pipeline of five stages over ``documents``; each works on all that the stage before it kept.

Handling of odd input: rows without letters go in the first stage, null and empty texts with them, and those that line dedup
empties stay as empty texts; rows of one id are one document to the third and fourth stage, whose rows all stay or go; rows
with a null id are kept by every stage after the first test of their text; very long texts are whole throughout; columns
other than those of ``documents`` are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, linededup, minhash, packing
from tessera.llm.common import materialize, release, table, without_ids

#: Rows of a batch that goes to Python: texts are long, and what a batch takes comes on top of an executor's heap.
BATCH_ROWS = 1000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language gets less than this share of the score has no language.
MIN_SCORE = 0.3


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or a clear language go."""
    _small_batches(spark)
    profiles = langid.learn_profiles(docs.where(~langid.held_out("doc_id")))
    out = langid.predict_language(docs, profiles, carry=COLUMNS)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in the last of them."""
    _small_batches(spark)
    out = linededup.drop_repeated_lines(docs, carry=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates stays."""
    _small_batches(spark)
    return without_ids(docs, minhash.near_duplicates(docs).where("not kept").select("doc_id")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, as it is or with other numbers and names, go."""
    _small_batches(spark)
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, leaks.select("doc_id")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]
#: SQL can express neither the profiles nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            release(last)
            last = docs
    return docs
