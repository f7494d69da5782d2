"""Nested roles as an adjacency table: (doc, role_id, parent_role_id, ord, company, title)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.functions.text import same_company
from tallyproof.operators.overrides import ranked_within
from tallyproof.sources.files import settled


def walk(roles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Every role with depth, its path of positions (an array, which sorts in document
    order) and whether its company differs from its parent's.

    Goes down level by level until a level is empty, each a join on the parent's id
    with the level before, which is settled. Roles that no top-level role leads to are
    left out; see `unreached`. An id that stands below itself raises an error.
    """
    level = roles.where(F.col("parent_role_id").isNull()).select("*", F.lit(0).alias("depth"), F.array("ord").alias("path"), F.lit(True).alias("foreign"))
    columns, most = level.columns, roles.count()
    levels = [settled(level)]
    while levels[-1].limit(1).count():
        if len(levels) > most:
            raise ValueError("a role stands below itself")
        parent = levels[-1].select(doc, F.col("role_id").alias("parent_role_id"), F.col("path").alias("above"), F.col("company").alias("of"))
        below = roles.join(parent, [doc, "parent_role_id"]).withColumn("depth", F.lit(len(levels))).withColumn("path", F.concat("above", F.array("ord")))
        levels.append(settled(below.withColumn("foreign", ~same_company(F.col("company"), F.col("of"))).select(*columns)))
    return reduce(DataFrame.unionByName, levels)


def unreached(roles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Roles whose parent is missing or that stand below each other in a ring."""
    return roles.join(walk(roles, doc).select(doc, "role_id"), [doc, "role_id"], "left_anti")


def promote(roles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Roles at another company than the one they are nested under go to the top
    level, in document order; those at the same company stay where they are."""
    at = walk(roles, doc)
    top = F.when(~F.col("foreign"), F.col("parent_role_id"))
    rows = ranked_within(at.withColumn("new_parent", top), [doc, "new_parent"], ["path", "role_id"], "new_ord")
    return rows.withColumn("new_ord", (F.col("new_ord") - 1).cast("int"))


def flatten(roles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Roles in pre-order with depth and the path they have in the parse
    (experience.0.sub_roles.1). One document may hold most of the roles: they are
    numbered over ranges of paths."""
    at = walk(roles, doc)
    parts = F.transform("path", lambda p: p.cast("string"))
    named = at.withColumn("parse_path", F.concat(F.lit("experience."), F.array_join(parts, ".sub_roles.")))
    return ranked_within(named, [doc], ["path", "role_id"]).withColumn("position", F.col("position").cast("int"))
