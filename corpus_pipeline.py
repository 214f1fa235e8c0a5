"""The corpus pipeline: language ID, near duplicates, repeated passages, mixture, packing.

Each stage takes the documents that its predecessor kept, and all but the
last return the columns of ``documents``.  ``run`` writes what a stage
returns to the shared folder and reads it again, so no stage computes
another's work twice and a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formspark.llm import common, jaccard, langid, mixing, packing, repeats

#: Bytes of a passage that the third stage removes where it comes again; 50 words have more.
PASSAGE_BYTES = 150


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language can't be told."""
    found = langid.identify(docs, F.col("text"), F.col("lang"), F.col("source"))
    return found.where(F.col(langid.result_names(docs.columns)[3])).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates: five words, 0.8."""
    return jaccard.keep_one(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has, and n_chars after that."""
    left = repeats.remove_repeats(docs, length=PASSAGE_BYTES)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix_documents(docs, mixing.word_count(F.col("text")), F.array("source"))
    size, _, _, taken = map(F.col, mixing.result_names(docs.columns))
    times = F.when(size > 0, taken / size).otherwise(0).cast("int")
    copy = mixing.common.free(mixed.columns, "__copy")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", sequences)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
