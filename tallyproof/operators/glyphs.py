"""Words from the places of glyphs, where the text layer lost or spread them.

Glyph rows: keys of a line, ord, ch, x0, x1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Factor on the median gap, floor of a gap, share of the largest gap.
WORD_FACTOR, MIN_GAP, GAP_SHARE = 2.0, 0.3, 0.5


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted array, the upper one of two."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def _text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One line of text for each group, a space before the glyphs marked `gap`."""
    parts = F.array_sort(F.collect_list(F.struct("ord", F.concat(F.when(F.col("brk"), " ").otherwise(""), F.col("ch")).alias("s"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"))


def with_gaps(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """The gap in front of each glyph; none in front of the first."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return glyphs.withColumn("gap", F.col("x0") - F.lag("x1").over(w))


def join_letterspaced(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Words of letter-spaced lines: a gap over twice the upper median of the
    positive gaps ends one; glyphs that are white space don't count."""
    rows = with_gaps(glyphs.where(F.trim("ch") != ""), keys)
    median = rows.where("gap > 0").groupBy(*keys).agg(upper_median(F.collect_list("gap")).alias("mid"))
    rows = rows.join(median, keys, "left")
    return _text(rows.withColumn("brk", F.coalesce(F.col("gap") > WORD_FACTOR * F.col("mid"), F.lit(False))), keys)


def split_run_on(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Words of lines without spaces: a gap of at least half the largest, and not
    under the floor, starts one, unless the glyph is white space itself."""
    rows = with_gaps(glyphs, keys)
    most = rows.groupBy(*keys).agg(F.greatest(F.lit(MIN_GAP), GAP_SHARE * F.max("gap")).alias("least"))
    rows = rows.join(most, keys)
    return _text(rows.withColumn("brk", F.coalesce((F.col("gap") >= F.col("least")) & (F.trim("ch") != ""), F.lit(False))), keys)
