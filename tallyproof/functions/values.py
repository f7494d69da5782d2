"""Dates as written, percentages, colours, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Two places, half to even; 100 of nothing."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 2)).otherwise(100.0)


def when_text(raw: Column, year: Column, month: Column, present: Column) -> Column:
    """Present, YYYY-MM, YYYY, or else as written; nothing for no date."""
    zero = F.coalesce(year, F.lit(0)) == 0
    return (
        F.when(raw.isNull() & year.isNull() & month.isNull() & present.isNull(), "")
        .when(present, "Present")
        .when(~zero & (F.coalesce(month, F.lit(0)) != 0), F.format_string("%d-%02d", year, month))
        .when(~zero, year.cast("string"))
        .otherwise(F.coalesce(raw, F.lit("")))
    )


def date_text(raw: Column, present: Column) -> Column:
    """As written; Present only where nothing is written."""
    return F.when(F.coalesce(present, F.lit(False)) & (F.coalesce(raw, F.lit("")) == ""), "Present").otherwise(F.coalesce(raw, F.lit("")))


def range_text(start: Column, end: Column) -> Column:
    """Both ends with a dash, without one that hangs loose."""
    both = F.concat(start, F.lit(" – "), end)
    return F.when((start == "") & (end == ""), "").otherwise(F.regexp_replace(both, "^[ –]+|[ –]+$", ""))


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def channels(color: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(color, n).bitwiseAND(255) for n in (16, 8, 0))


def near_white(color: Column, tolerance: int = 8) -> Column:
    red, green, blue = (F.abs(c - 255) <= tolerance for c in channels(color))
    return red & green & blue


def points(pixels: Column, dpi: int = 300) -> Column:
    return pixels * 72.0 / dpi


def upload_ms(size: Column) -> Column:
    """The time an upload of so many bytes is expected to take, in ms."""
    return F.least(F.lit(420000.0), 30000.0 + 2600.0 * size / 1024.0)


def zone(y0: Column, y1: Column, height: Column) -> Column:
    """header in the top 7 %, footer in the bottom 7 %, else body; header first."""
    return F.when(y0 < 0.07 * height, "header").when(y1 > 0.93 * height, "footer").otherwise("body")
