"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Raw bytes that one task should hold of what is dealt to it as packed blobs.
TASK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[str, str] = {}


def _shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir``; only a session in one process,
    as in tests, may do without, and gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top:
        return top
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _made.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="shared-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, without its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner see what is no longer used: shuffle files and checkpoints of rounds gone by."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once as a compressed table in the shared folder: for what is wide."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores in front while ``columns`` have such a name (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lean(spark: SparkSession) -> None:
    """Small Arrow batches, in the session's settings: memory must not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def gathered(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, so that what is packed by batch packs well."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def give_back() -> None:
    """Returns freed memory to the system; idle Python workers would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """``f``, a function for mapInArrow or applyInArrow, that gives memory back when it is done."""
    if inspect.isgeneratorfunction(f):

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(batches)
            give_back()

        return each
    if f.__code__.co_argcount == 2:

        def both(a: pa.Table, b: pa.Table) -> pa.Table:
            out = f(a, b)
            give_back()
            return out

        return both

    def one(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    return one


def parts_for(total_bytes: float, spark: SparkSession, per_task: int = TASK_BYTES) -> int:
    """Partitions for so many raw bytes: bounded memory each, and all cores busy."""
    return max(spark.sparkContext.defaultParallelism * 2, math.ceil(total_bytes / per_task))


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return row["n"], row["b"] or 0


def sample(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """``n`` rows at most, those of smallest seeded hash of the keys.

    Hashes above what n rows need twice over go before the sort, so a task
    has some rows to send and not n.
    """
    lot = F.xxhash64(*keys, F.lit(seed))
    share = min(1.0, 2.0 * n / max(1, df.count()))
    few = df.withColumn("__lot", lot).where(F.pmod(F.xxhash64("__lot"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return few.orderBy("__lot", *keys).limit(n).drop("__lot")


def pack(array: np.ndarray) -> bytes:
    """One numpy column as a compressed blob; ``unpack`` is the way back."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def blobs(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    """All blobs of a column, end to end."""
    parts = [unpack(x, dtype) for x in table.column(name).to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, .. for counts[i] numbers, end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.arange(total) + np.repeat(starts - shift, counts)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking nodes a[i] and b[i]: the smallest node of each class."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
    return labels


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the links (a, b): (node, smallest node of its class)."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    labels = join_labels(np.arange(len(nodes)), back[: len(a)], back[len(a) :])
    child = labels != np.arange(len(nodes))
    return nodes[child], nodes[labels[child]]


def numbered(df: DataFrame, order: list[str], out: str, parts: int) -> DataFrame:
    """``df`` with ``out``: each row's place from 0 in the order of the columns, without gaps; computed once.

    Rows are dealt to ``parts`` sorted ranges; the ranges' counts, a row a
    range, come to the driver and go back as each range's first place.
    """
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id())
    placed = cut(placed.withColumns({"__range": F.shiftright("__n", 33), "__n": F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted(tuple(r) for r in placed.groupBy("__range").count().collect())
    first, at = [], 0
    for p, n in counts:
        first.append((p, at))
        at += n
    firsts = df.sparkSession.createDataFrame(first, "__range long, __first long")
    return placed.join(F.broadcast(firsts), "__range").withColumn(out, F.col("__first") + F.col("__n")).select(*df.columns, out)


def running(counts: DataFrame, key: str, number: str, out: str, group: int = 4096) -> DataFrame:
    """``counts`` (a key from 0 and a number a row) with ``out``: the sum over all smaller keys.

    Keys are summed by groups of ``group``, so no task holds more than that
    many rows of a group, and one row a group.
    """
    of = F.floor(F.col(key) / F.lit(group)).cast("long")
    tops = counts.groupBy(of.alias("__of")).agg(F.sum(number).alias("__all"))
    tops = tops.select("__of", F.coalesce(F.sum("__all").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum(number).over(Window.partitionBy("__of").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__of", of).withColumn("__inner", inner).join(tops, "__of").withColumn(out, F.col("__base") + F.col("__inner")).select(*counts.columns, out)


#: Rows that are broadcast where their number has been checked.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, weight: int = 1) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, each of ``weight`` numbers; else as it is."""
    few = df.limit(BROADCAST_ROWS // weight + 1).count() <= BROADCAST_ROWS // weight
    return F.broadcast(df) if few else df


#: A node with this share of all links, and so many of them, is a hub: there can be two thousand at most.
HUB, HUB_LINKS = 1000, 200
#: Links, 16 bytes each, that one task joins; more are joined by distributed rounds.
TASK_LINKS = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the classes of all links of a partition."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        node, root = forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each linked node but the roots; links are (src, dst) longs.

    TASK_LINKS links at most are joined in one task, as each round of the
    others writes files for every task of several shuffles, however few the
    links.  More are joined by alternating large-star and small-star rounds
    of aggregates, combined before they are dealt, and equi-joins against one
    row a node.  The links of hubs, which would meet in one task, don't take
    part in the join: a hub has a thousandth of all links, so two thousand
    hubs at most come to the driver with their smallest neighbours and are
    broadcast.  Lineage is cut every round.
    """

    def large_star(e: DataFrame, total: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"), F.count(F.lit(1)).alias("n"))
        hubs = low.where(F.col("n") >= max(HUB_LINKS, total // HUB)).select("src", "low").collect() if total >= HUB_LINKS else []
        greater = both.where("dst > src")
        if not hubs:
            return greater.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        known = F.broadcast(e.sparkSession.createDataFrame([tuple(r) for r in hubs], "src long, hub long"))
        marked = greater.join(known, "src", "left")
        usual = marked.where("hub is null").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        return usual.unionByName(marked.where("hub is not null").select(F.col("dst").alias("src"), F.col("hub").alias("dst")))

    def small_star(large: DataFrame) -> DataFrame:
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.when(F.col("dst") > F.col("low"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.col("low").alias("dst"))
        return small.distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    e = cut(links.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")))
    if e.count() <= TASK_LINKS:
        return cut(e.coalesce(1).mapInArrow(tidy(_joined), "node long, root long"))
    e = cut(e.distinct())
    before = state(e)
    for n in range(most_rounds):
        if not before[0]:
            break
        if n % 2 == 0:
            release(e.sparkSession)
        e = cut(small_star(large_star(e, before[0])))
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
