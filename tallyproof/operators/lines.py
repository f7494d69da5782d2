"""From texts and blocks to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.functions import text as T


def split_lines(text: Column) -> Column:
    """The lines of a text: any line break ends one, and the last needs none."""
    parts = F.split(F.coalesce(text, F.lit("")), T.LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, no, text): every line of a plain text, blank ones too, from 1."""
    return docs.select(F.col(id_col), F.posexplode(split_lines(F.col(text_col))).alias("no", "text")).withColumn("no", F.col("no") + 1)


def physical_lines(blocks: DataFrame, keys: list[str], text_col: str = "text", decompose: bool = True) -> DataFrame:
    """A row for each line break in each block, cleaned for display; other columns
    stay, an `is_bullet` of the block counts for all its lines."""
    pieces = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\n+\z", ""), "\n", -1)
    others = [c for c in blocks.columns if c not in (text_col, "is_bullet")]
    own = F.coalesce(F.col("is_bullet"), F.lit(False)) if "is_bullet" in blocks.columns else F.lit(False)
    rows = blocks.select(*others, own.alias("of_block"), F.posexplode(pieces).alias("piece", "raw"))
    rows = rows.withColumn("shown", T.display(F.col("raw"), decompose))
    return rows.select(*others, "piece", F.col("shown.text").alias("text"), (F.col("of_block") | F.col("shown.is_bullet")).alias("is_bullet"), T.script(F.col("shown.text")).alias("script"))


def furniture(lines: DataFrame, doc: str, page: str, zone: str = "zone", text_col: str = "text") -> DataFrame:
    """`lines` with `drop_reason`: repeated_page_footer for text with digits that,
    digits masked, stands outside the body on two pages or more;
    repeated_on_every_page for text that stands there on all of several pages.

    Pages are counted by aggregation and joined back, so that a line shared by
    very many pages isn't gathered in one window.
    """
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("page_count"))
    return repeated(lines, pages, doc, page, zone, text_col)


def repeated(lines: DataFrame, pages: DataFrame, doc: str, page: str, zone: str = "zone", text_col: str = "text") -> DataFrame:
    """`furniture` where `pages` (doc, page_count) are counted already: of `lines`, those
    of the body may be left out."""
    # only lines outside the body can go, and they are few: the others pass by all joins
    may = (F.col(zone) != "body") & (F.col(text_col) != "")
    outside = lines.where(may).withColumn("masked", T.digit_mask(F.col(text_col)))
    of_mask = outside.groupBy(doc, "masked").agg(F.countDistinct(page).alias("mask_pages"))
    of_text = outside.groupBy(doc, text_col).agg(F.countDistinct(page).alias("text_pages"))
    rows = outside.join(of_mask, [doc, "masked"], "left").join(of_text, [doc, text_col], "left").join(pages, doc, "left")
    reason = F.when((F.col("masked") != F.col(text_col)) & (F.col("mask_pages") >= 2), "repeated_page_footer").when(
        (F.col("page_count") > 1) & (F.col("text_pages") >= F.col("page_count")), "repeated_on_every_page"
    )
    rest = lines.where(~F.coalesce(may, F.lit(False))).withColumn("drop_reason", F.lit(None).cast("string"))
    return rows.withColumn("drop_reason", reason).select(*lines.columns, "drop_reason").unionByName(rest)


def _join_pairs(lines: DataFrame, part: list[str], order: list[str], eligible: Column, glue: str) -> DataFrame:
    """Joins eligible rows with the next, left to right, none twice. What makes a
    row eligible is its original neighbour, so the first, third, ... of each run of
    eligible rows are the heads."""
    w = Window.partitionBy(*part).orderBy(*order)
    rows = lines.withColumn("ok", F.coalesce(eligible, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w))
    at = F.sum(F.col("ok").cast("int")).over(Window.partitionBy(*part, "run").orderBy(*order))
    # an unbroken run shares `run` with the row before it, which isn't eligible; count eligible rows only
    rows = rows.withColumn("head", F.col("ok") & (at % 2 == 1))
    rows = rows.withColumn("second", F.coalesce(F.lag("head").over(w), F.lit(False)))
    rows = rows.withColumn("following", F.lead("text").over(w)).where(~F.col("second"))
    joined = F.when(F.col("head"), F.concat(F.col("text"), F.lit(glue), F.col("following"))).otherwise(F.col("text"))
    halves = F.when(F.col("head"), F.array("text", "following")).otherwise(F.col("unjoined"))
    others = [c for c in lines.columns if c not in ("text", "unjoined")]
    return rows.select(*others, joined.alias("text"), halves.alias("unjoined"))


def _ready(lines: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return lines if "unjoined" in lines.columns else lines.withColumn("unjoined", empty)


def join_hyphens(lines: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """A word broken at a hyphen goes on in the next line of the same page and
    column; the hyphen stays. Only Latin script. Both halves are kept."""
    w = Window.partitionBy(*part).orderBy(*order)
    following = F.lead("text").over(w)
    ok = (
        F.endswith(F.col("text"), F.lit("-"))
        & ~F.endswith(F.col("text"), F.lit("--"))
        & (F.length("text") > 1)
        & F.regexp_like(following, F.lit(r"\A\p{IsLowercase}"))
        & (F.lead("page").over(w) == F.col("page"))
        & F.lead("column").over(w).eqNullSafe(F.col("column"))
        & (F.col("script") == "latin")
        & (F.lead("script").over(w) == "latin")
    )
    return _join_pairs(_ready(lines), part, order, ok, "")


def join_page_breaks(lines: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """A sentence that goes on behind a page break becomes one line, with a space."""
    w = Window.partitionBy(*part).orderBy(*order)
    following = F.lead("text").over(w)
    ok = (
        (F.lead("page").over(w) == F.col("page") + 1)
        & (F.col("text") != "")
        & (following != "")
        & ~T.ends_sentence(F.col("text"))
        & ~T.is_heading(F.col("text"))
        & ~T.is_heading(following)
        & ~F.lead("is_bullet").over(w)
        & (F.col("script") == "latin")
    )
    return _join_pairs(_ready(lines), part, order, ok, " ")


def number(lines: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    return lines.withColumn("no", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def to_lines(blocks: DataFrame, doc: str = "doc_id", order: str = "seq", decompose: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ordered blocks (doc, seq, page, column, zone, text) to numbered lines, and
    the lines dropped on the way, numbered -1, -2, ..."""
    rows = physical_lines(blocks, [doc, order], decompose=decompose)
    rows = furniture(rows, doc, "page")
    keys = [order, "piece"]
    dropped = number(rows.where(F.col("drop_reason").isNotNull()), [doc], keys)
    dropped = dropped.select(doc, (-F.col("no")).alias("no"), "text", F.col("drop_reason").alias("reason"))
    kept = rows.where(F.col("drop_reason").isNull()).drop("drop_reason")
    kept = join_page_breaks(join_hyphens(kept, [doc], keys), [doc], keys)
    return number(kept, [doc], keys), dropped
