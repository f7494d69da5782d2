"""Report views over claims and entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.operators.overrides import ranked_within


def ordered_groups(rows: DataFrame, keys: list[str], group: str, value: str, order: str) -> DataFrame:
    """(keys, group, first_at, position, value): what `first_seen_groups` lists, a row for
    each value, for groups of any size. Sorted by keys, first_at and position it reads as
    that does; equal places are told apart by the value."""
    ranked = ranked_within(rows.select(*keys, group, value, order), [*keys, group], [order, value])
    first = rows.groupBy(*keys, group).agg(F.min(order).alias("first_at"))
    of = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, group]))
    return ranked.alias("a").join(first.alias("b"), of).select(*(f"a.{k}" for k in [*keys, group]), "first_at", "position", value)


def first_seen_groups(rows: DataFrame, keys: list[str], group: str, value: str, order: str) -> DataFrame:
    """Values by group, groups in the order in which they first appear. A group is one
    array: for those of one document; `ordered_groups` is for groups without a bound."""
    parts = F.array_sort(F.collect_list(F.struct(order, value)))
    out = rows.groupBy(*keys, group).agg(F.min(order).alias("first_at"), parts.alias("parts"))
    return out.select(*keys, group, "first_at", F.transform("parts", lambda p: p[value]).alias("values"))


def alphabetical_groups(rows: DataFrame, keys: list[str], group: str, value: str, order: str) -> DataFrame:
    return first_seen_groups(rows, keys, group, value, order).orderBy(*keys, group)


def section(rows: DataFrame, ord_: int, title: str | Column, item: Column, label: Column, value: Column, lines: Column, flag: Column, row: Column | None = None) -> DataFrame:
    """Rows of one section of a proof sheet."""
    title = F.lit(title) if isinstance(title, str) else title
    return rows.select(
        "doc_id", F.lit(ord_).alias("section_ord"), title.alias("section"), item.alias("item_ord"), (row if row is not None else F.lit(0)).alias("row_ord"), label.alias("label"), value.alias("value"),
        F.array_join(F.transform(lines, lambda n: n.cast("string")), ",").alias("lines"), flag.alias("flag"),
    )


def proof_sheet(parts: list[DataFrame]) -> DataFrame:
    """Sections in their order; rows without value or label fall away, and with
    them sections that have nothing to show."""
    return reduce(DataFrame.unionByName, parts).where((F.coalesce("value", F.lit("")) != "") | (F.coalesce("label", F.lit("")) != ""))


def batch_table(targets: DataFrame, results: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """Every target in input order with its figures or its failure."""
    return targets.join(results, key, "left").join(failures, key, "left").orderBy("input_ord")
