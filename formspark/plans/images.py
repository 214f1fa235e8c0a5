"""Queries of the image operators over pages drawn from events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.operators import images
from formspark.plans.registry import Tables, query

SIDE = 96


def _drawn(pdf: pd.DataFrame) -> np.ndarray:
    ink = np.zeros((SIDE, SIDE), bool)
    ink[pdf.y.to_numpy(int), pdf.x.to_numpy(int)] = True
    return ink


def _points(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("page"), (F.col("event_id") % SIDE).cast("int").alias("x"), (F.floor(F.col("value") * 7) % SIDE).cast("int").alias("y"))


@query()
def q_image_components(t: Tables) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = images.components(images.dilate(_drawn(pdf), 1))
        sizes = np.unique(labels[labels > 0], return_counts=True)[1]
        return pd.DataFrame([(pdf.page.iloc[0], len(sizes), int(sizes.max()), int(sizes.sum()))], columns=["page", "components", "largest", "ink"])

    return _points(t).groupBy("page").applyInPandas(run, "page long, components long, largest long, ink long")


@query()
def q_image_ownership(t: Tables) -> DataFrame:
    boxes = np.array([[8, 8, 40, 24], [50, 10, 90, 30], [10, 60, 80, 80]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ink = images.dilate(_drawn(pdf), 1)
        whose, far = images.ownership(ink.shape, boxes)
        rows = []
        for i in range(len(boxes)):
            mine = images.owned(ink, whose, far, i, 8, reclaim=True)
            rows.append((pdf.page.iloc[0], i, int(mine.sum()), images.extent(mine)))
        return pd.DataFrame(rows, columns=["page", "box", "ink_px", "extent"])

    return _points(t).groupBy("page").applyInPandas(run, "page long, box long, ink_px long, extent array<double>")


@query()
def q_image_alignment(t: Tables) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        page = int(pdf.page.iloc[0])
        ink = images.dilate(_drawn(pdf), 1)
        moved = np.roll(ink, (page % 5, page % 3), axis=(0, 1))
        dx, dy = images.offset(ink.astype(float), moved.astype(float))
        back = np.roll(moved, (-round(dy), -round(dx)), axis=(0, 1))
        return pd.DataFrame([(page, dx, dy, images.coverage(ink, back))], columns=["page", "dx", "dy", "coverage"])

    return _points(t).groupBy("page").applyInPandas(run, "page long, dx double, dy double, coverage double")
