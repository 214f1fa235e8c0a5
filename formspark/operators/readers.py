"""Readers: prompts, calls in batches, and the order of reading, second opinion and retry.

A reader is any object with ``read(page, items)``; calls run in
``applyInPandas`` a page, the only place where rows leave Catalyst.  No model
comes with this package: ``EchoReader`` is a deterministic stand-in for tests.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formspark.operators import records
from formspark.operators.layout import batches

#: Fields of one call.
BATCH = 6


class Reader(Protocol):
    name: str

    def read(self, page: object, items: list[dict]) -> dict[str, str]:
        """Values by field; a field may be missing."""


class EchoReader:
    """Returns a column of the items."""

    def __init__(self, column: str, name: str = "echo") -> None:
        self.column, self.name = column, name

    def read(self, page: object, items: list[dict]) -> dict[str, str]:
        return {i["field"]: i[self.column] for i in items if i.get(self.column) is not None}


def ink_note(ink: Column, base: Column) -> Column:
    """What the ink says about a field, where it tells."""
    verdict = records.ink_verdict(ink, base)
    return F.when(verdict == "", "").otherwise(F.concat(F.lit(" ["), verdict, F.lit("]")))


def page_prompts(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prompt): a numbered line a field; a spec that several fields share is marked.

    items(keys, ordinal, label, spec, ink_px, baseline_px); the specs come as
    a table, so a form's wording is data.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))
    uses = F.count(F.lit(1)).over(Window.partitionBy(*keys, "spec"))
    line = F.concat(n.cast("string"), F.lit(". "), "label", F.lit(" - "), F.when(uses > 1, "(as above) ").otherwise(""), "spec", ink_note(F.col("ink_px"), F.col("baseline_px")))
    lines = items.select(*keys, n.alias("n"), line.alias("line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


def parse_answers(raw: Column) -> Column:
    """A map from number to value of a reader's JSON answer; null if it isn't JSON."""
    return F.from_json(raw, "map<string,string>")


def read_pages(items: DataFrame, reader: Reader, keys: tuple[str, ...] = ("doc", "page"), size: int = BATCH) -> DataFrame:
    """(doc, page, field, value, source, model) of each item read, ``size`` items a call."""
    name = reader.name

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        got = reader.read(tuple(first[k] for k in keys), pdf.to_dict("records"))
        rows = [(*(first[k] for k in keys), f, v, "page", name) for f, v in got.items()]
        return pd.DataFrame(rows, columns=[*keys, "field", "value", "source", "model"])

    types = dict(items.dtypes)
    shape = ", ".join(f"{k} {types[k]}" for k in keys) + ", field string, value string, source string, model string"
    return batches(items, list(keys), ["ordinal"], size).groupBy(*keys, "batch").applyInPandas(call, shape)


def run(items: DataFrame, cache: DataFrame, reader: Reader, second: Reader | None = None, retry: Reader | None = None) -> DataFrame:
    """The cache with what was missing read, structured fields read twice, arbitration applied, and doubtful values read again.

    items(doc, page, field, label, type, ordinal, ink_px, baseline_px); fields
    without ink are settled without a reader.  With ``retry``, on pages where
    something was missing, what has no value, an invalid one or one that the
    ink contradicts is read again, structured fields by ``second`` if there is
    one; a further value counts if it is valid or the first.
    """
    todo = records.unread(items, cache, ["doc", "field"])
    blank = todo.where(~records.needs_reader(F.col("ink_px"))).select("doc", "page", "field", F.lit("").alias("value"), F.lit("ink-gate").alias("source"), F.lit("").alias("model"))
    read = read_pages(todo.where(records.needs_reader(F.col("ink_px"))), reader)
    fresh = blank.unionByName(read).withColumn("disputed", F.lit(False))
    if second is not None:
        asked = fresh.join(items.select("doc", "field", "type", "label", "ordinal", "ink_px", "baseline_px"), ["doc", "field"])
        wanted = asked.where(records.sweeps(F.col("type"), records.ink_verdict(F.col("ink_px"), F.col("baseline_px")), F.col("source")))
        again = read_pages(items.join(wanted.select("doc", "field"), ["doc", "field"], "left_semi"), second).select("doc", "field", F.col("value").alias("second"), F.col("model").alias("model2"))
        both = wanted.withColumnRenamed("value", "first").drop("source", "disputed").join(again, ["doc", "field"], "left")
        swept = records.sweep(both, "first", "second", "type")
        swept = swept.select("doc", "page", "field", "value", "source", F.when(F.col("source") == "ocr-sweep", F.col("model2")).otherwise(F.col("model")).alias("model"), "disputed")
        fresh = fresh.join(swept.select("doc", "field"), ["doc", "field"], "left_anti").unionByName(swept)
    known = cache.unionByName(fresh, allowMissingColumns=True)
    return known if retry is None else reread(items.join(todo.select("doc", "page").distinct(), ["doc", "page"], "left_semi"), known, retry, second)


def reread(items: DataFrame, known: DataFrame, reader: Reader, second: Reader | None = None) -> DataFrame:
    """``known`` with values that can't be right read once more; see ``run``."""
    # readers are called once: what they said is kept, and what is asked next
    known = known.persist()
    asked = items.join(known.select("doc", "field", F.col("value").alias("__first"), F.col("source").alias("__from")), ["doc", "field"], "left")
    asked = asked.withColumns({"__found": records.assess(F.col("__first"), F.col("type")), "__verdict": records.ink_verdict(F.col("ink_px"), F.col("baseline_px"))})
    reason = records.retry_reason(F.col("__from").isNotNull(), F.coalesce("__from", F.lit("")), F.col("__found"), F.col("__verdict"))
    bad = asked.withColumn("reason", reason).where("reason is not null").drop("__found", "__verdict", "__from").persist()
    special = F.col("type").isin(records.rules.READER_TYPES) if second is not None else F.lit(False)
    again = read_pages(bad.where(~special), reader)
    if second is not None:
        again = again.unionByName(read_pages(bad.where(special), second))
    again = again.withColumnsRenamed({"value": "second", "source": "__s"}).join(bad.select("doc", "field", "type", "__first"), ["doc", "field"]).persist()
    taken = again.where(records.retry_takes(F.col("second"), F.col("__first"), records.assess(F.col("second"), F.col("type"))))
    taken = taken.select("doc", "page", "field", F.col("second").alias("value"), F.lit("retry").alias("source"), "model", F.lit(False).alias("disputed"))
    return known.join(taken.select("doc", "field"), ["doc", "field"], "left_anti").unionByName(taken, allowMissingColumns=True)
