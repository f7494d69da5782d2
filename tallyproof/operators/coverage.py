"""Which lines are claimed, represented, unassigned or flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.functions.text import is_blank
from tallyproof.functions.values import percent


def claimed_lines(claims: DataFrame, doc: str = "doc_id") -> DataFrame:
    return claims.select(doc, F.explode("source_lines").alias("no")).distinct()


def represented_lines(judged: DataFrame, doc: str = "doc_id") -> DataFrame:
    return claimed_lines(judged.where(F.col("flag") == "ok"), doc)


def line_states(lines: DataFrame, claimed: DataFrame, represented: DataFrame, dropped: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """A row for each line: non_blank (and not dropped), claimed, represented."""
    rows = lines.select(doc, "no", "text")
    if dropped is not None:
        rows = rows.join(dropped.select(doc, "no").distinct().withColumn("gone", F.lit(True)), [doc, "no"], "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("boolean"))
    for name, part in (("claimed", claimed), ("represented", represented)):
        rows = rows.join(part.select(doc, "no").distinct().withColumn(name, F.lit(True)), [doc, "no"], "left")
    live = ~is_blank(F.col("text")) & F.col("gone").isNull()
    return rows.select(doc, "no", "text", live.alias("non_blank"), (live & F.col("claimed").isNotNull()).alias("claimed"), (live & F.col("represented").isNotNull()).alias("represented"))


def accounts(lines: DataFrame, marks: DataFrame, dropped: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """What `line_states` gives, with the reasons for which a line is flagged, from
    `verify.marks`, in one join. Marks on lines that don't exist are kept as rows that
    aren't `there`, for they are flags of their document too."""
    rows = lines.select(doc, "no", "text", F.lit(True).alias("there")).join(marks, [doc, "no"], "full")
    if dropped is not None:
        rows = rows.join(dropped.select(doc, "no").distinct().withColumn("gone", F.lit(True)), [doc, "no"], "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("boolean"))
    there = F.coalesce("there", F.lit(False))
    live = there & ~is_blank(F.col("text")) & F.col("gone").isNull()
    marked = lambda c: (live & F.coalesce(c, F.lit(False))).alias(c)
    return rows.select(doc, "no", "text", there.alias("there"), live.alias("non_blank"), marked("claimed"), marked("represented"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def account_report(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """`report` of `accounts`, flags included, by one grouping."""
    flagged = F.array_sort(F.flatten(F.collect_list(F.transform("reasons", lambda r: F.struct(F.col("no").alias("no"), r.alias("reason"))))))
    out = _counts(rows, doc, F.count_if("there"), flagged.alias("flagged"))
    return _percentages(out.where("total_lines > 0"))


def account_gutter(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """`gutter` of `accounts`, without another join."""
    state = F.when(F.size("reasons") > 0, "flag").when(F.col("non_blank") & ~F.col("claimed"), "unassigned").otherwise("claimed")
    return rows.where("there").select(doc, "no", state.alias("state"))


def _counts(rows: DataFrame, doc: str, total: Column, *more: Column) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("no"))))
    return rows.groupBy(doc).agg(
        total.alias("total_lines"), count(F.col("non_blank")).alias("non_blank_lines"), count(F.col("claimed")).alias("claimed_lines"), count(F.col("represented")).alias("represented_lines"),
        listed(F.col("non_blank") & ~F.col("claimed")).alias("unassigned"), listed(F.col("claimed") & ~F.col("represented")).alias("claimed_not_represented"), *more,
    )


def _percentages(out: DataFrame) -> DataFrame:
    return out.withColumn("coverage_pct", percent(F.col("claimed_lines"), F.col("non_blank_lines"))).withColumn("represented_pct", percent(F.col("represented_lines"), F.col("non_blank_lines")))


def report(states: DataFrame, flags: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Counts, percentages and sorted line lists of each document."""
    out = _percentages(_counts(states, doc, F.count("*")))
    if flags is None:
        return out
    listed_flags = flags.select(doc, "no", "reason").distinct().groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("no", "reason"))).alias("flagged"))
    empty = F.array().cast("array<struct<no:int,reason:string>>")
    return out.join(listed_flags, doc, "left").withColumn("flagged", F.coalesce("flagged", empty))


def gutter(states: DataFrame, flags: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, no, state): flag before unassigned before claimed; blank lines count as claimed."""
    bad = flags.select(doc, "no").distinct().withColumn("bad", F.lit(True))
    state = F.when(F.col("bad"), "flag").when(F.col("non_blank") & ~F.col("claimed"), "unassigned").otherwise("claimed")
    return states.join(bad, [doc, "no"], "left").select(doc, "no", state.alias("state"))


def summary(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count("*").alias("n_docs"), F.bround(F.avg("coverage_pct"), 4).alias("mean_coverage"), F.min("coverage_pct").alias("min_coverage"),
        F.bround(F.avg("represented_pct"), 4).alias("mean_represented"), F.min("represented_pct").alias("min_represented"),
        F.bround(F.avg(F.col("coverage_pct") - F.col("represented_pct")), 4).alias("mean_gap"),
    )


def reverse_index(claims: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, no, claim_ids): who claims a line."""
    return claims.select(doc, "claim_id", F.explode("source_lines").alias("no")).distinct().groupBy(doc, "no").agg(F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))
