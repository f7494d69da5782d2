"""A training corpus from `documents`: quality, near-duplicates, personal data,
mixing, packing. Each stage gets all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyproof.llm import mixing, near_dup, packing, pii, quality
from tallyproof.llm.common import small_or_not, workspace, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns of documents; a stage sees all others under names of its own choosing.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def any_names(stage: Stage) -> Stage:
    """A stage for tables with further columns of whatever names, names that a stage uses
    inside or that differ by case alone from others among them. Columns are told apart by
    their place: all but those of documents are renamed ahead of the stage and get their
    names back behind it, if it returns the columns it got."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in COLUMNS else f"also_{k}_" for k, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.toDF(*docs.columns) if out.columns == names else out

    return run


@any_names
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier, fitted on these documents, accepts. Texts
    without words, null included, go; rows that repeat, or have null ids, are decided
    like any other."""
    return quality.accepted(docs)


@any_names
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows are decided one
    by one: of those with one id, each stays or goes by its own text, and a null id
    comes after all others. Of rows that repeat id and text one stays."""
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        found = written(near_dup.near_duplicates(docs).select("doc_id", "kept"), "dedup")
        gone = found.where("not kept").select("doc_id")
        return docs.join(small_or_not(gone), "doc_id", "left_anti").select(docs.columns)
    # rows get numbers in the order of ids, null last; the last key only deals out equal rows
    order = [F.col("doc_id").asc_nulls_last(), F.col("text"), F.monotonically_increasing_id()]
    rows = written(docs.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = written(near_dup.near_duplicates(rows, id_col="__row").select("__row", "kept"), "dedup")
    left = written(rows.join(small_or_not(found.where("not kept").select("__row")), "__row", "left_anti").select(docs.columns), "left")
    again = left.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


@any_names
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows. All rows stay."""
    return pii.redact(docs)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with nr, a number among those of one (id, size, tie): counted by blocks of
    written rows first, then within each, so that no group of equal rows is one task."""
    keys = ["id", "size", "tie"]
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), name).withColumn("block", F.shiftright("at", 33))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "block").agg(F.count("*").alias("n"))
    counts = counts.select(*keys, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy(*keys, "block").orderBy("at")))
    return own.join(counts, [*keys, "block"]).withColumn("nr", F.col("own") + F.col("before")).drop("at", "block", "own", "before")


@any_names
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; where it takes a part,
    the text ends behind that many words and is as it was before. A null text has no
    words and is not taken. Other columns, whatever their names, come along."""
    full = F.coalesce("text", F.lit(""))
    tie = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")), full)
    plan = written(mixing.mix(docs, tie=tie).select("doc_id", "size", "taken", "tie"), "mix")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    odd = plan.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if odd:  # rows that repeat an id are told apart by their source and text; equal ones have a number
        name = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")).alias("id")
        size = F.regexp_count(full, F.lit(mixing.WORD)).cast("long").alias("size")
        left = _numbered(docs.select(name, size, tie.alias("tie"), row), "mix-rows")
        right = _numbered(plan.select(name, "size", "tie", "taken"), "mix-plan")
        joined = left.join(right, ["id", "size", "tie", "nr"])
    else:
        few = small_or_not(plan.where("taken > 0").select(F.col("doc_id").alias("id"), "size", "taken"))
        joined = docs.select(F.col("doc_id").alias("id"), row).join(few, "id")
    joined = joined.where("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("long")
    takes = F.concat(F.array_repeat(F.col("size"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = joined.select("row", "size", F.explode(takes).alias("take"))
    # all behind the words taken comes as the last part; blanks in front give an empty part
    text, blank = F.col("row.text"), r"[\x20\x09-\x0D]+"
    lead = F.when(F.regexp_like(text, F.lit(rf"\A{blank}")), 1).otherwise(0)
    behind = F.element_at(F.split(text, blank, (F.col("take") + 1 + lead).cast("int")), -1)
    first = F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(behind)), F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumn("cut", F.when(F.col("take") < F.col("size"), first))
    now = {"text": F.coalesce("cut", text), "n_chars": F.coalesce(F.length("cut").cast("long"), F.col("row.n_chars"))}
    return rows.select(*(now.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


@any_names
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece and place; a document that the mix takes several times
    has its pieces in as many places (sequence_id, offset), by which its rows differ.
    Null and empty texts are packed as their end id."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, tokenizers and MinHash have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if (name, stage) == STAGES[-1]:
            return out
        path = workspace(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
