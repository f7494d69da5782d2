"""Rectangles on pages, and guards on a document's text layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tiles(boxes: DataFrame, size: float) -> DataFrame:
    """A row for each square of the page that a box touches."""
    for axis in ("x", "y"):
        low, high = (F.floor(F.col(f"{axis}{n}") / size) for n in (0, 1))
        boxes = boxes.withColumn(f"t{axis}", F.explode(F.sequence(low, F.greatest(low, high))))
    return boxes


def overlap_pairs(left: DataFrame, right: DataFrame, page: list[str], tile: float = 100.0) -> DataFrame:
    """(page, lid, rid) of boxes (page, id, x0, y0, x1, y1) whose insides meet.

    Boxes meet only where they touch a common tile, so this is an equi-join on
    page and tile, not a product of all boxes.
    """
    a = _tiles(left.select(*page, F.col("id").alias("lid"), *("x0", "y0", "x1", "y1")), tile)
    b = _tiles(right.select(*page, F.col("id").alias("rid"), *("x0", "y0", "x1", "y1")), tile)
    b = b.select(*page, "rid", "tx", "ty", *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    meets = (F.col("x0") < F.col("rx1")) & (F.col("rx0") < F.col("x1")) & (F.col("y0") < F.col("ry1")) & (F.col("ry0") < F.col("y1"))
    return a.join(b, [*page, "tx", "ty"]).where(meets).select(*page, "lid", "rid").distinct()


def in_table(blocks: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """`blocks` with from_table: whether a table of four cells or more meets it."""
    real = tables.where(F.col("n_rows") * F.col("n_cols") >= 4)
    hit = overlap_pairs(blocks, real, page).select(*page, F.col("lid").alias("id")).distinct().withColumn("from_table", F.lit(True))
    return blocks.join(hit, [*page, "id"], "left").withColumn("from_table", F.coalesce("from_table", F.lit(False)))


def skill_bars(drawings: DataFrame, texts: DataFrame, page: list[str]) -> DataFrame:
    """Pages with three filled bars or more that no text touches: ratings that
    carry no text."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    bars = drawings.where(F.col("filled") & (w >= 40) & (h > 0) & (h <= 20))
    touched = overlap_pairs(bars, texts, page).select(*page, F.col("lid").alias("id")).distinct()
    return bars.join(touched, [*page, "id"], "left_anti").groupBy(*page).agg(F.count("*").alias("bars")).where("bars >= 3")


def hull(words: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised words (keys, word_no, text, confidence, pixel box) to lines: words
    of at least 30 % confidence in order, their common box in points."""
    scale = 72.0 / 300
    seen = words.where((F.col("confidence") >= 30) & (F.trim("text") != ""))
    parts = F.array_sort(F.collect_list(F.struct("word_no", F.trim("text").alias("t"))))
    return seen.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"),
        *((F.min if n == "0" else F.max)(f"{a}{n}").alias(f"{a}{n}") for n in "01" for a in "xy"),
    ).select(*keys, "text", *((F.col(f"{a}{n}") * scale).alias(f"{a}{n}") for n in "01" for a in "xy"))


def decorated(blocks: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with the largest font and whether all their visible runs are painted
    like the page; 0 and no where a block has no runs."""
    from tallyproof.functions.values import near_white

    hidden = F.bool_and(F.when(F.trim("run_text") != "", near_white(F.col("color"))))
    of = runs.groupBy(*keys).agg(F.max("size").alias("max_font_size"), F.coalesce(hidden, F.lit(True)).alias("hidden_text"))
    return blocks.join(of, keys, "left").fillna({"max_font_size": 0.0, "hidden_text": False})


def text_guard(pages: Column, images: Column, repaired: Column, visible: Column, odd: Column) -> Column:
    """The code a document is rejected with by its text layer, or null: damaged,
    scanned, empty, or garbled, tried in that order. `visible` counts characters
    that aren't white space, `odd` those of them that are neither letter nor digit."""
    return (
        F.when(repaired & (visible < 50), "corrupt_file")
        .when((visible == 0) | (images & (visible / F.greatest(pages, F.lit(1)) < 100)), "scanned_no_text_layer")
        .when(visible < 50, "empty_document")
        .when(odd / visible > 0.30, "garbled_text")
    )


def open_guard(opens: Column, locked: Column, pages: Column) -> Column:
    return F.when(~opens, "corrupt_file").when(locked, "password_protected").when(pages > 15, "file_too_large").when(pages == 0, "corrupt_file")


def visible_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\p{IsWhite_Space}\x1C-\x1F]", ""))


def odd_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\p{IsWhite_Space}\x1C-\x1F\p{L}\p{N}]", ""))
