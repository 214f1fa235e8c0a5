"""Boxes, words and rows: range, nearest and as-of joins, ordered grouping.

Joins on ranges carry equi-keys: the page, and a band of the coordinate that
the range is over, so that each is a hash or sort-merge join of a bounded
number of candidates and not a nested loop.  Order is always an explicit
column; nothing relies on the order of a DataFrame.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def close_to(color: Column, target: list[float], tolerance: float) -> Column:
    """Is each component of a colour within the tolerance of the target's?"""
    wanted = F.array(*map(F.lit, target))
    return (F.size(color) == len(target)) & F.forall(F.zip_with(color, wanted, lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)


def box_kind(width: Column, height: Column, cells: Column) -> Column:
    """grid of three narrow cells or more, block, checkbox or text."""
    return F.when((cells >= 3) & (width <= 21), "grid").when((height >= 20) & (width > 14), "block").when(width <= 14, "checkbox").otherwise("text")


# ---- ordered grouping


def anchored_rows(df: DataFrame, keys: list[str], position: str, order: list[str], tolerance: float, out: str = "row") -> DataFrame:
    """A row number for each item: it joins the last row if within the tolerance of that row's first item.

    The fold runs inside Catalyst over one sorted array a group, as intervals
    of anchors; items come back by a range lookup, so the fold's state is one
    number a row and not one an item.
    """
    items = F.sort_array(F.collect_list(F.col(position).cast("double")))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<double>").alias("anchors"))

    def add(state: Column, x: Column) -> Column:
        fresh = state["at"].isNull() | (x - state["at"] > tolerance)
        return F.struct(F.when(fresh, x).otherwise(state["at"]).alias("at"), F.when(fresh, F.concat(state["anchors"], F.array(x))).otherwise(state["anchors"]).alias("anchors"))

    rows = df.groupBy(*keys).agg(F.aggregate(items, start, add)["anchors"].alias("__anchors"))
    spans = rows.select(*keys, F.posexplode("__anchors").alias("__n", "__anchor"))
    marks = spans.select(*keys, F.col("__anchor").alias("__at"), F.lit(0).alias("__item"), (F.col("__n") + 1).cast("long").alias(out), F.col("__anchor").alias("anchor"))
    # an item's row is that of the last anchor at or before it
    both = df.withColumns({"__at": F.col(position).cast("double"), "__item": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy("__at", "__item", *order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({out: F.last(out, ignorenulls=True).over(last), "anchor": F.last("anchor", ignorenulls=True).over(last)})
    return both.where("__item = 1").drop("__at", "__item")


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Callable[[Callable[[str], Column]], Column], out: str = "island") -> DataFrame:
    """Numbers runs: ``breaks(previous)`` says whether an item starts a new one, previous(c) being the last item's c."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.coalesce(breaks(lambda c: F.lag(c).over(w)), F.lit(True)), 1).otherwise(0)
    marked = df.withColumn("__break", flag)
    return marked.withColumn(out, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def tolerant_distinct(df: DataFrame, keys: list[str], edges: list[str], order: list[str], tolerance: float) -> DataFrame:
    """Drops an item if one kept before it is within the tolerance at all edges; greedy and in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        boxes = pdf[edges].to_numpy(float)
        kept: list[int] = []
        for i in range(len(boxes)):
            if not kept or not (abs(boxes[kept] - boxes[i]) < tolerance).all(axis=1).any():
                kept.append(i)
        return pdf.iloc[kept]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def page_ranges(df: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Runs of following pages: first, last and their number."""
    w = Window.partitionBy(*keys).orderBy(page)
    distinct = df.select(*keys, page).distinct()
    grouped = distinct.withColumn("__run", F.col(page) - F.row_number().over(w)).groupBy(*keys, "__run")
    return grouped.agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count(F.lit(1)).alias("pages")).drop("__run")


def numbered_ids(df: DataFrame, base: Column, order: list[str], out: str = "id") -> DataFrame:
    """base, base__2, base__3 .. in order."""
    n = F.row_number().over(Window.partitionBy("__base").orderBy(*order))
    return df.withColumn("__base", base).withColumn("__n", n).withColumn(out, F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("__"), F.col("__n").cast("string")))).drop("__base", "__n")


def numbered_labels(df: DataFrame, keys: list[str], label: str, order: list[str], out: str = "name") -> DataFrame:
    """Each label, in order, or label (2), label (3) .. : the first of these that its group doesn't have yet.

    Only labels that are alike but for such endings can get in each other's
    way.  Where all labels of a group's family are equal the number is the
    row's place, by a window; the rows of the others are taken one by one, in
    order, and the state is one family's names.
    """
    family = Window.partitionBy(*keys, "__family")
    marked = df.withColumn("__family", F.regexp_replace(label, r"( \([0-9]+\))+\z", ""))
    marked = marked.withColumns({"__mixed": F.coalesce(F.min(label).over(family) != F.max(label).over(family), F.lit(False)), "__n": F.row_number().over(family.orderBy(*order))})
    place = F.when(F.col("__n") == 1, F.col(label)).otherwise(F.concat(label, F.lit(" ("), F.col("__n").cast("string"), F.lit(")")))
    mixed = marked.where("__mixed").repartition(*keys, "__family").sortWithinPartitions(*keys, "__family", "__n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set[str] = set()
        following: dict[str, int] = {}
        for batch in batches:
            names = []
            for n, one in zip(batch.column("__n").to_pylist(), batch.column(label).to_pylist(), strict=True):
                if n == 1:
                    taken, following = set(), {}
                i = following.get(one, 1)
                while (name := one if i == 1 else f"{one} ({i})") in taken:
                    i += 1
                taken.add(name)
                following[one] = i + 1
                names.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, "__name"])

    scanned = mixed.mapInArrow(run, T.StructType([*mixed.schema.fields, T.StructField("__name", T.StringType())]))
    both = marked.where("not __mixed").withColumn("__name", place).unionByName(scanned)
    return both.withColumn(out, F.col("__name")).drop("__family", "__mixed", "__n", "__name")


def batches(df: DataFrame, keys: list[str], order: list[str], size: int, out: str = "batch") -> DataFrame:
    return df.withColumn(out, F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


def continuing_words(df: DataFrame, keys: list[str], order: list[str], left: str, right: str, text: str, size: str) -> DataFrame:
    """Characters to words: cut at white space and at a gap above 0.7 and 0.06 of the size."""
    gap = lambda prev: (F.col(left) - prev(right) > F.greatest(F.lit(0.7), F.col(size) * 0.06)) | F.btrim(prev(text)).__eq__("") | (F.btrim(F.col(text)) == "")
    words = islands(df, keys, order, gap, "word").where(F.btrim(F.col(text)) != "")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "")
    return words.groupBy(*keys, "word").agg(joined.alias("text"), F.min(left).alias("x0"), F.max(right).alias("x1"))


# ---- joins


def _bands(df: DataFrame, low: Column, high: Column, width: float, name: str = "__band") -> DataFrame:
    """One copy of a row for each band that its range touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def contained(points: DataFrame, boxes: DataFrame, keys: list[str], x: str = "x", y: str = "y", margin_x: float = 0.0, margin_y: float = 0.0, band: float = 32.0) -> DataFrame:
    """Points with the boxes (x0, y0, x1, y1) they are in: an equi-join on keys and y band, then the exact test."""
    spread = _bands(boxes, F.col("y0") - margin_y, F.col("y1") + margin_y, band)
    joined = points.withColumn("__band", F.floor(F.col(y) / band)).join(spread, [*keys, "__band"])
    inside = F.col(x).between(F.col("x0") - margin_x, F.col("x1") + margin_x) & F.col(y).between(F.col("y0") - margin_y, F.col("y1") + margin_y)
    return joined.where(inside).drop("__band")


def last_before(df: DataFrame, heads: DataFrame, keys: list[str], at: str, head_at: str, name: str, slack: float = 0.0) -> DataFrame:
    """As-of join: the name of the last head at or before each row's place plus the slack; one pass over both."""
    marks = heads.select(*keys, F.col(head_at).alias("__at"), F.lit(0).alias("__row"), F.col(name).alias("__name"))
    rows = df.withColumns({"__at": F.col(at) + slack if slack else F.col(at), "__row": F.lit(1)})
    w = Window.partitionBy(*keys).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn(name, F.last("__name", ignorenulls=True).over(w))
    return both.where("__row = 1").select(*df.columns, name)


def nearest(df: DataFrame, others: DataFrame, on: list[str], condition: Column, distance: Column, tie: list[str], keep: dict[str, Column], key: list[str]) -> DataFrame:
    """Of the others that meet the condition the nearest, ties to the smallest; inner.

    ``condition`` and ``distance`` speak of the sides as a and b.  Aggregating
    keeps one candidate a row before anything else is joined.
    """
    pairs = df.alias("a").join(others.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]).where(condition)
    order = F.struct(distance.alias("d"), *[F.col(f"b.{c}").alias(f"t_{c}") for c in tie])
    payload = F.struct(*[v.alias(k) for k, v in keep.items()])
    best = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in key]).agg(F.min_by(payload, order).alias("__best"))
    return best.select(*key, "__best.*")


def near_band(df: DataFrame, at: str, reach: float) -> tuple[DataFrame, DataFrame]:
    """The rows with their band, and with each band from which they lie within reach: sides of an equi-join."""
    left = df.withColumn("band", F.floor(F.col(at) / reach))
    right = df.withColumn("band", F.explode(F.array(F.floor(F.col(at) / reach), F.floor(F.col(at) / reach) + 1)))
    return left, right


def first_in(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def table_cells(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Every row with every column: the cells of one ruled table, whose size is the result's."""
    return rows.crossJoin(columns)


def owners(points: DataFrame, boxes: list[tuple[str, float, float, float, float]], x: str = "x", y: str = "y", inset: float = 1.0) -> DataFrame:
    """The box nearest to each point, of a page's boxes given as literals; ties to the first.

    The boxes are a page's, some hundred at most, so they are an array in the
    plan and no join at all.
    """
    given = F.array(*[F.struct(F.lit(n).alias("box"), *[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (a + inset, b + inset, c - inset, d - inset), strict=True)]) for n, a, b, c, d in boxes])
    far = F.transform(given, lambda b: F.struct(F.hypot(F.greatest(b["x0"] - F.col(x), F.col(x) - b["x1"], F.lit(0.0)), F.greatest(b["y0"] - F.col(y), F.col(y) - b["y1"], F.lit(0.0))).alias("distance"), b["box"].alias("box")))
    best = F.array_min(F.transform(far, lambda d, i: F.struct(d["distance"].alias("distance"), i.alias("i"), d["box"].alias("box"))))
    return points.withColumn("__best", best).select("*", "__best.box", "__best.distance").drop("__best")


# ---- order-dependent scans


def carried_questions(df: DataFrame, keys: list[str], order: list[str], probe: str, option: str, schema: T.StructType | None = None) -> DataFrame:
    """The question each tick box belongs to, carried along a page's boxes in reading order.

    A probed text starts a new question unless it is the current one, its
    wrapped end, or a run of the last options' words.  The state is one
    question and its options, so a page's rows are taken one by one.
    """
    import re

    def plain(s: str) -> str:
        return re.sub("[^a-z0-9]", "", s.lower())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        current, options, out = "", [], []
        for text, label in zip(pdf[probe].fillna(""), pdf[option].fillna(""), strict=True):
            new = plain(text)
            if text and text != current:
                tails = {plain("".join(options[i:])) for i in range(len(options))}
                if not current or not new or not (plain(current).endswith(new) or new in tails):
                    current, options = text, []
            options.append(label)
            out.append(current)
        return pdf.assign(question=out)

    return df.groupBy(*keys).applyInPandas(run, T.StructType([*(schema or df.schema).fields, T.StructField("question", T.StringType())]))


def column_labels(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Unlabelled cells of a ruled table get their column's label and row number; later cells see earlier labels.

    Cells of equal left edge and width are one column.  A column keeps its
    labelled cells by height, so a cell looks once into each column beside
    its own and not at all cells; labels are counted by what stands before
    each " (row" in them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import re

        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        labels, top = pdf["label"].fillna("").tolist(), pdf["y0"].tolist()
        left = pdf["x0"].to_numpy(float)
        wide = pdf["x1"].to_numpy(float) - left
        placed = np.isfinite(left) & np.isfinite(wide) & pdf["y0"].notna().to_numpy()
        edges, of = np.unique(np.stack([left[placed], wide[placed]], axis=1), axis=0, return_inverse=True)  # by left edge
        column = np.full(len(pdf), -1)
        column[placed] = of.ravel()
        column = column.tolist()
        beside: dict[int, list[int]] = {}
        heights: list[list] = [[] for _ in edges]
        first: list[dict] = [{} for _ in edges]
        rows: dict[str, int] = {}

        def enter(i: int) -> None:
            for m in re.finditer(r" \(row", labels[i]):
                rows[labels[i][: m.start()]] = rows.get(labels[i][: m.start()], 0) + 1
            c = column[i]
            if c >= 0:
                if top[i] not in first[c]:
                    bisect.insort(heights[c], top[i])
                first[c][top[i]] = min(i, first[c].get(top[i], i))

        for i in np.flatnonzero(np.array(labels, object) != "").tolist():
            enter(i)
        for i, c in enumerate(column):
            if labels[i] or c < 0:
                continue
            if c not in beside:
                a, b = np.searchsorted(edges[:, 0], (edges[c, 0] - 7, edges[c, 0] + 7))
                beside[c] = (a + np.flatnonzero((abs(edges[a:b] - edges[c]) < 6).all(axis=1))).tolist()
            head = None
            for other in beside[c]:
                k = bisect.bisect_left(heights[other], top[i])
                if k:
                    y = heights[other][k - 1]
                    if head is None or (y, -first[other][y]) > head:
                        head = (y, -first[other][y])
            if head:
                base = re.sub(r"\s*\(row [0-9]+\)$", "", labels[-head[1]])
                labels[i] = f"{base} (row {rows.get(base, 0) + 2})"
                enter(i)
        return pdf.assign(label=labels)

    return df.groupBy(*keys).applyInPandas(run, df.schema)
