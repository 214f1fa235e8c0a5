"""Sharding by a two-pass external shuffle (operator 4).

Pass one scatters records into buckets by a seeded hash; the number of
buckets follows from the input's bytes, so that each fits a task's memory.
Pass two orders a bucket by id and text hash, so that reruns agree, and
gives it a seeded Fisher-Yates shuffle.  Buckets end to end are the shuffled
corpus; its places are cut into shards whose counts differ by one at most.

The bucket's hash takes id and text, so one id or one text in a third of all
rows does not fill a bucket.  Rows that are equal in both and together larger
than a bucket are dealt to several, by a number that is written down first.
Bucket counts (one number each, summed by groups of buckets) give each bucket
its first place; they are dealt to the buckets' tasks, so the records move
once.

Defined cases: null text has no bytes; null ids are shuffled like others;
rows that are equal in all are interchangeable; fewer rows than shards leave
shards empty; an empty table gives no rows.  Extra columns stay, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formspark.llm import common

#: Bytes of records that a bucket has.
BUCKET_BYTES = 16 << 20


def _shuffled(seed: int):
    def run(t: pa.Table, first: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"row": t.column("row"), "place": pa.array([], pa.int64())})
        bucket = t.column("bucket")[0].as_py()
        t = t.sort_by([("id", "ascending"), ("hash", "ascending")])
        rng = np.random.default_rng([seed, bucket])
        order = np.arange(t.num_rows)
        draws = rng.random(t.num_rows)
        for i in range(t.num_rows - 1, 0, -1):  # Fisher-Yates
            j = int(draws[i] * (i + 1))
            order[i], order[j] = order[j], order[i]
        return pa.table({"row": t.column("row").take(pa.array(order)), "place": pa.array(first.column("before")[0].as_py() + np.arange(t.num_rows))})

    return common.tidy(run)


def result_names(columns: list[str]) -> list[str]:
    """What ``shard_documents`` calls its two results beside these columns: with underscores in front of taken names."""
    return [common.free(columns, x) for x in ("__shard", "__slot")]


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """``docs`` with __shard (0 to shards - 1) and __slot (its place there, from 0)."""
    common.lean(docs.sparkSession)
    rows, size = common.text_bytes(docs, text_col)
    buckets = max(1, math.ceil((size + 16 * rows) / BUCKET_BYTES))
    mixed = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), mixed.alias("hash"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).alias("size"))
    large = every.groupBy("hash").agg(F.ceil(F.sum("size") / BUCKET_BYTES).alias("copies")).where("copies > 1")
    salt = F.lit(0).cast("long")
    if large.limit(1).count():  # rows equal in id and text that no bucket holds: a hash is a bucket's bytes at least
        numbered = every.join(large, "hash", "left").withColumn("salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), "copies"), F.lit(0)))
        every, salt = common.stored(numbered.drop("copies"), "scattered"), F.col("salt")
    dealt = every.select("row", "id", "hash", F.pmod(F.xxhash64("hash", salt), F.lit(buckets)).alias("bucket"))
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    first = common.running(counts, "bucket", "n", "before").select((F.col("bucket") + 0).alias("of"), "before")
    shape = T.StructType([dealt.schema["row"], T.StructField("place", T.LongType())])
    shuffled = dealt.groupBy("bucket").cogroup(first.groupBy("of")).applyInArrow(_shuffled(seed), shape)
    place = F.col("place")
    # the first of `more` shards have one row more than `least`
    least, more = divmod(rows, shards)
    head = more * (least + 1)
    shard = F.when(place < head, F.floor(place / F.lit(least + 1))).otherwise(F.lit(more) + F.floor((place - head) / F.lit(max(least, 1))))
    start = F.when(F.col("shard") < more, F.col("shard") * (least + 1)).otherwise(F.lit(head) + (F.col("shard") - more) * least)
    names = result_names(docs.columns)
    return shuffled.withColumn("shard", shard.cast("int")).select("row.*", F.col("shard").alias(names[0]), (place - start).cast("long").alias(names[1]))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """The shards as one folder each; a file is a run of slots in order, that of a bucket, so records move once."""
    names = result_names(docs.columns)
    placed = shard_documents(docs, shards, **options)
    placed.sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_documents(docs, 40)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
