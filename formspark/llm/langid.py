"""Language ID by Bayesian evidence fusion (operator 6).

For each language: log P(text | language), of a model of hashed three-byte
grams in words, tempered as neighbouring grams aren't independent; P(declared
language | language), of how the markup's declarations agree with texts; and
a prior of the host, smoothed towards its domain, that towards its address
suffix, and that towards all rows.  Counts for priors and declarations are
grouped aggregates over all rows; a host with any share of the rows is one
row of a join, and the tables joined are broadcast only where Spark finds
them small.

The gram model is trained on a bounded sample of distinct texts with a declared
language, the SAMPLE_ROWS of smallest hash of each; copies count once.  Every declared language that
has letters in its texts gets a model; models travel as the grams that occur,
packed, and workers spread BLOCK of them at a time.  A row holds one number a
language.  A further class, "und", has all grams alike; it wins where a text
looks like no language known.

Defined cases: null or empty texts, and texts without letters, have no text
evidence and are rejected; null declarations and hosts say nothing; without
any declared row all is "und" and rejected; repeated and null ids play no
part; a text over SLICE_BYTES is scanned in runs, and grams across their
borders don't count; an empty table gives no rows; extra columns are kept,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formspark.llm import common
from formspark.llm.textscan import lowered, pieces

#: Training texts of a language, and hashed grams.
SAMPLE_ROWS, GRAM_BITS = 400, 15
#: Languages whose dense tables a worker holds at a time.
BLOCK = 64
#: Grams that a text's evidence counts for at most, and in proportion.
MOST_GRAMS, TEMPER = 400.0, 0.5
#: Rows that a level of the host hierarchy counts for in the level below it.
STRENGTH = 20.0
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed three-byte grams of lower-case words, with a space at either end, and their rows."""
    data = lowered(data)
    letter = _LETTER[data]
    plain = np.where(letter, data, 0x20).astype(np.uint32)
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (plain[:-2] << np.uint32(16)) | (plain[1:-1] << np.uint32(8)) | plain[2:]
    keep = letter[1:-1].copy()
    inner = offsets[1:-1]
    for shift in (1, 2):  # grams that reach into the next text
        at = inner - shift
        keep[at[(at >= 0) & (at < len(keep))]] = False
    at = np.flatnonzero(keep)
    slot = ((code[at] * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
    return slot, np.searchsorted(offsets, at, side="right") - 1


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, held = batch.column(0).to_pylist(), {}
        for rows, data, offsets in pieces(batch.column(1)):
            slot, row = _grams(data, offsets)
            bounds = np.searchsorted(row, np.arange(len(offsets)))
            for i, r in enumerate(rows.tolist()):
                own = slot[bounds[i] : bounds[i + 1]]
                if r in held:
                    held[r] += np.bincount(own, minlength=1 << GRAM_BITS)  # a text of several runs
                elif len(rows) == 1:
                    held[r] = np.bincount(own, minlength=1 << GRAM_BITS)
                elif len(own):
                    held[r] = np.unique(own, return_counts=True)
        out = []
        for r, own in held.items():
            grams, n = own if isinstance(own, tuple) else (np.flatnonzero(own), own[own > 0])
            if len(grams):
                out.append((names[r], grams.astype(np.uint16).tobytes(), (n * min(1.0, 2000 / n.sum())).tobytes()))  # no text rules the model
        columns = zip(*out, strict=True) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["language", "slots", "counts"])


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(1 << GRAM_BITS)
    for slots, counts in zip(t.column("slots").to_pylist(), t.column("counts").to_pylist()):
        total[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts)
    some = np.flatnonzero(total)
    return pa.table({"language": t.column("language")[:1], "slots": pa.array([common.pack(some.astype(np.uint16))], pa.binary()), "counts": pa.array([common.pack(total[some])], pa.binary())})


def _dense(slots: bytes, counts: bytes) -> np.ndarray:
    """A language's log-probabilities of grams."""
    total = np.full(1 << GRAM_BITS, 0.1)
    total[common.unpack(slots, "uint16")] += common.unpack(counts, "float64")
    return np.log(total / total.sum())


def train(docs: DataFrame, text: Column, declared: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], list[tuple[bytes, bytes]]]:
    """Languages, "und" last, and the packed grams and counts of all but "und", from a bounded sample."""
    key = F.xxhash64("text", F.lit(9)).alias("key")
    known = docs.select(declared.alias("language"), text.alias("text")).where("language is not null and text is not null").select("language", "text", key)
    texts = common.cut(known.select("language", "key").distinct())
    # twice the keys wanted go to the sort, whatever a language has; the last key wanted is its bound
    many = texts.groupBy("language").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * sample_rows)
    place = F.col("key").cast("double") / 2.0**64 + 0.5
    few = texts.join(F.broadcast(many), "language", "left").where(F.col("n").isNull() | (place < 2.0 * sample_rows / F.col("n")))
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy("language").orderBy("key")))
    bounds = few.where(F.col("nth") <= sample_rows).groupBy("language").agg(F.max("key").alias("last"))
    found = known.join(F.broadcast(bounds), "language").where("key <= last").groupBy("language", "key").agg(F.first("text").alias("text"))
    shape = "language string, slots binary, counts binary"
    sums = found.select("language", "text").mapInArrow(_train, shape).groupBy("language").applyInArrow(_add, shape).collect()
    sums.sort(key=lambda r: r["language"])
    return [*(r["language"] for r in sums), UNKNOWN], [(bytes(r["slots"]), bytes(r["counts"])) for r in sums]


def _likelihoods(model):
    kept = {}

    def tables() -> Iterator[tuple[int, np.ndarray]]:
        models = model.value
        for first in range(0, len(models), BLOCK):
            table = kept.get(first)
            if table is None:
                table = np.array([_dense(*x) for x in models[first : first + BLOCK]])
                if len(models) <= BLOCK:
                    kept[first] = table
            yield first, table

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        width = len(model.value) + 1
        flat, grams = np.zeros((len(texts), width)), np.zeros(len(texts), np.int64)
        for rows, data, offsets in pieces(texts):
            slot, row = _grams(data, offsets)
            bounds = np.searchsorted(row, np.arange(len(offsets)))
            n = np.diff(bounds)
            grams[rows] += n
            some = n > 0
            if some.any():
                for first, table in tables():
                    for k in range(len(table)):
                        flat[rows[some], first + k] += np.add.reduceat(table[k][slot], bounds[:-1][some])
        flat[:, -1] = grams * (-GRAM_BITS * math.log(2))
        flat *= np.where(grams > 0, TEMPER * np.minimum(grams, MOST_GRAMS) / np.maximum(grams, 1), 0)[:, None]
        flat -= flat.max(axis=1, keepdims=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width, dtype=np.int32)), pa.array(flat.ravel()))
        common.give_back()
        return pc.if_else(pa.array(grams == 0), pa.scalar(None, lists.type), lists)

    return run


def _numbers(values: list[float]) -> Column:
    """One literal, however many numbers."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _best(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int")


def _named(place: Column, languages: list[str]) -> Column:
    """Language by place; a declared name has no hyphen."""
    return F.element_at(F.split(F.lit("-".join(languages)), "-"), place)


def result_names(columns: Sequence[str]) -> list[str]:
    """What ``identify`` calls its four results beside these columns: with underscores in front of taken names."""
    return [common.free(columns, x) for x in ("__language", "__confidence", "__text_language", "__accepted")]


def identify(docs: DataFrame, text: Column, declared: Column | None = None, host: Column | None = None, least: float = 0.5, sample_rows: int = SAMPLE_ROWS, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with __language, __confidence (its posterior), __text_language and __accepted.

    ``host`` is a name such as an address has; its last two labels are its
    domain and the last its suffix.  A name without dots has neither.  With
    ``keep`` each text is scored once, its numbers going into a checkpoint;
    without, texts are scored for the counts and for the result, as writing
    them down would cost the disk their size.  See ``result_names`` for
    inputs that have such columns.
    """
    common.lean(docs.sparkSession)
    narrow = keep is not None
    keep = list(keep) if narrow else docs.columns
    none = F.lit(None).cast("string")
    declared = F.lower(F.split(F.coalesce(declared, none), "[-_]")[0]) if declared is not None else none
    host = F.lower(host) if host is not None else none
    languages, models = train(docs, text, declared, sample_rows)
    model = docs.sparkSession.sparkContext.broadcast(models)
    n = len(languages)
    labels = F.split(F.col("__host"), "\\.")
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), declared.alias("__declared"), host.alias("__host"), _likelihoods(model)(text).alias("__text"))
    known = known.withColumns({
        "__domain": F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")),
        "__suffix": F.when(F.size(labels) > 1, F.element_at(labels, -1)),
        "__best": _best(F.col("__text")),
    })
    found = common.cut(known) if narrow else known

    # one small table of all rows, from which all counts follow
    cells = common.cut(found.where("__best is not null").groupBy("__host", "__domain", "__suffix", "__declared", "__best").agg(F.count(F.lit(1)).alias("n")))
    every = [0.0] * n
    for r in cells.groupBy("__best").agg(F.sum("n").alias("n")).collect():
        every[r["__best"] - 1] = float(r["n"])
    smooth = [c + 1.0 for c in every]
    root = _numbers([c / sum(smooth) for c in smooth])

    def level(keys: list[str], name: str, only: str = "true") -> DataFrame:
        found = cells.where(" and ".join([only, *(f"{k} is not null" for k in keys)])).groupBy(*keys, "__best").agg(F.sum("n").cast("double").alias("n"))
        found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__best", "n"))).alias("m"))
        return found.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias(name))

    def shrink(own: Column, up: Column) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.coalesce(F.zip_with(own, up, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH)), up)

    suffixes = level(["__suffix"], "c").select("__suffix", shrink(F.col("c"), root).alias("__ps"))
    domains = level(["__suffix", "__domain"], "c").join(suffixes, "__suffix").select("__domain", shrink(F.col("c"), F.col("__ps")).alias("__pd"))
    hosts = level(["__domain", "__host"], "c").join(domains, "__domain", "left").select("__host", shrink(F.col("c"), F.coalesce("__pd", root)).alias("__prior"))
    lone = level(["__host"], "c", "__domain is null").select("__host", shrink(F.col("c"), root).alias("__prior"))
    # of n rows that a text calls x, how many declare d: P(d | x), smoothed
    total = _numbers(every)
    says = level(["__declared"], "c").select("__declared", F.zip_with("c", total, lambda c, t: F.log((c + 0.5) / (t + 0.5 * (n + 1)))).alias("__says"))

    hosts = common.small(common.cut(hosts.unionByName(lone)), n)
    out = found.join(hosts, "__host", "left").join(common.small(common.cut(says), n), "__declared", "left")
    prior = F.transform(F.coalesce("__prior", root), lambda p: F.log(p))
    flat = F.array_repeat(F.lit(0.0), n)
    score = F.zip_with(F.zip_with(F.coalesce("__text", flat), prior, lambda a, b: a + b), F.coalesce("__says", flat), lambda a, b: a + b)
    out = out.withColumn("__score", score)
    odds = F.aggregate(F.transform("__score", lambda x: F.exp(x - F.array_max("__score"))), F.lit(0.0), lambda a, x: a + x)
    best = _named(_best(F.col("__score")), languages)
    sure = F.lit(1.0) / odds
    accepted = F.col("__text").isNotNull() & (best != UNKNOWN) & (sure >= least)
    names = result_names(keep)
    return out.select("row.*", *(c.alias(x) for c, x in zip((best, sure, _named(F.col("__best"), languages), accepted), names, strict=True)))


def _page_parts(html: Column, url: Column) -> tuple[Column, Column, Column]:
    """A web page's text without tags, the html element's lang, and the address's host."""
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    lang = F.nullif(F.regexp_extract(html, "(?i)<html[^>]*\\blang=[\"']?([A-Za-z]+)", 1), F.lit(""))
    host = F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return text, lang, host


def identify_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``identify`` for web pages."""
    return identify(pages, *_page_parts(F.col(html_col), F.col(url_col)))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents`` (doc_id) and of ``pages`` (page_id), identified as one table."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    text, lang, host = _page_parts(F.col("html"), F.col("url"))
    pages = common.table(spark, sf_dir, "pages").select("page_id", text.alias("text"), lang.alias("declared"), host.alias("host"))
    found = identify(docs.unionByName(pages, allowMissingColumns=True), F.col("text"), F.col("declared"), F.col("host"), keep=["doc_id", "page_id"])
    return found.select("doc_id", "page_id", F.col("__language").alias("language"), F.round("__confidence", 6).alias("confidence"), F.col("__text_language").alias("text_language"), F.col("__accepted").alias("accepted"))
