"""Columns on a page and reading order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What makes columns (points, and shares of the page).
MIN_GUTTER, MIN_SPAN, NARROW, ROW, MIN_BLOCKS = 40.0, 0.5, 0.3, 2.0, 4


def cluster(x: np.ndarray, k: int, rounds: int = 25) -> np.ndarray | None:
    """One-dimensional k-means from evenly spaced seeds; labels from left to right,
    None where the values don't make k clusters. Ties go to the seed on the left,
    and a cluster that loses all members stays where it is."""
    if len(x) < k or x.min() == x.max():
        return None
    centre = x.min() + (x.max() - x.min()) * np.arange(k) / (k - 1)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label = np.abs(x[:, None] - centre).argmin(axis=1)
        size = np.bincount(label, minlength=k)
        new = np.where(size > 0, np.bincount(label, x, k) / np.maximum(size, 1), centre)
        if (new == centre).all():
            break
        centre = new
    if len(np.unique(label)) < k:
        return None
    return np.argsort(np.argsort(centre, kind="stable"))[label]


def page_columns(page: pd.DataFrame) -> pd.Series:
    """The column of each block of one page, in reading order, or none at all."""
    height, width = page["page_height"].iloc[0], page["page_width"].iloc[0]
    nothing = pd.Series(pd.NA, index=page.index, dtype="Int32")
    if len(page) < MIN_BLOCKS or not height or pd.isna(height):
        return nothing
    for k in (3, 2):
        label = cluster(page["x0"].to_numpy(float), k)
        if label is None:
            continue
        box = page.groupby(label).agg(left=("x0", "min"), right=("x1", "max"), top=("y0", "min"), bottom=("y1", "max"))
        gutters = box["left"].to_numpy()[1:] - box["right"].to_numpy()[:-1]
        if (gutters < MIN_GUTTER).any() or ((box["bottom"] - box["top"]) / height < MIN_SPAN).any():
            continue
        narrow = ((box["right"] - box["left"]) / (width or 1.0) < NARROW).astype(int).to_numpy()
        place = np.empty(k, int)
        place[np.lexsort((np.arange(k), narrow))] = np.arange(k)
        return pd.Series(place[label], index=page.index, dtype="Int32")
    return nothing


def detect_columns(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """`blocks` with `column`: a page (some dozens of blocks) is one group."""
    names = blocks.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", `column` int"

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("seq", kind="stable")
        return page[names].assign(column=page_columns(page))

    return blocks.groupBy(doc, "page").applyInPandas(run, schema)


def sort_keys(with_geometry: bool = True) -> list:
    """Page, column, row (two points high, half to even), left edge; else as given."""
    if not with_geometry:
        return [F.col("page"), F.col("seq")]
    return [F.col("page"), F.coalesce(F.col("column"), F.lit(0)), F.bround(F.col("y0") / ROW), F.col("x0"), F.col("seq")]


def reading_order(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """`blocks` with `column` and `position`. Documents none of whose blocks has a
    page height keep the order they came in."""
    from pyspark.sql import Window

    placed = blocks if "column" in blocks.columns else detect_columns(blocks, doc)
    flat = F.max(F.coalesce(F.col("page_height"), F.lit(0.0))).over(Window.partitionBy(doc)) == 0
    keys = [F.when(F.col("flat"), F.lit(None)).otherwise(k) for k in sort_keys()[1:4]]
    order = [F.col("page"), *keys, F.col("seq")]
    return placed.withColumn("flat", flat).withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).drop("flat")
