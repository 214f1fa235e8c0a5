"""Structured Streaming around the batch operators: new documents, and reviewers' edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from formspark.operators import records


def documents_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "batch") -> DataStreamWriter:
    """A batch query over every micro-batch, into one folder for each.

    A batch that runs again after a failure overwrites its own folder, so each
    document's records are there once.
    """

    def write(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{sink}/{key}={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def edits_in_force(edits: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Streaming form of the latest edit of each field, without edits that come later than the watermark.

    edits(keys, value, original, at timestamp)
    """
    return edits.withWatermark("at", lateness).groupBy(*keys, F.window("at", "1 day")).agg(F.max_by("value", "at").alias("edit"), F.min_by("original", "at").alias("original"), F.max("at").alias("at"))


def with_edits(stored: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Stored records with the log's edits in force: what a reader of both sees."""
    return records.overlay(stored, records.current_edits(log, keys), keys)


def progress(jobs: DataFrame, keep: int = 40) -> DataFrame:
    """The newest jobs; jobs(id, created, stage, done, total)."""
    w = Window.orderBy(F.desc("created"), "id")
    # the first limit is taken by every task on its own, so the window sees `keep` rows
    newest = jobs.orderBy(F.desc("created"), "id").limit(keep)
    return newest.withColumns({"position": F.row_number().over(w), "share": F.coalesce(F.col("done") / F.nullif("total", F.lit(0)), F.lit(0.0))})
