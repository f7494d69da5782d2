"""Mixing sources to target weights, with DataFrame functions alone.

Sources share the words of the corpus by fixed weights; none is repeated more
than `cap` times, and what that leaves is shared again among the others. Within
a source, complete epochs come first; the rest of its target is drawn by
Efraimidis-Spirakis sampling: every document gets the exponential key
-ln(u) / quality weight, the smallest keys win, and their prefix sum meets the
budget (the last document is taken in part). Prefix sums go by ranges of
(source, key): sums of each range first, then within each range, so a source
with a third of all rows is spread over as many tasks as its share. Rows alike in
all that (one id, or null ids, of one size) are put in order by a number of the
written row, so that they too are spread; which of them is taken doesn't show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import small_or_not, written

WORD = r"[^\x20\x09-\x0D]+"
#: Marks that running text does without; the more of them, the smaller a document's weight.
MARKS = r"[#%&*$|!]"


def default_quality(text: Column, size: Column) -> Column:
    return F.when(size > 0, 1 / (1 + F.regexp_count(text, F.lit(MARKS)) / size)).otherwise(1.0)


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """`sources(skey, source_size)` with `target`: shares by weight of the sum of
    sizes, none above `cap` times its size. The level that the uncapped reach is
    found in one pass over the sources in the order in which they meet their cap: the
    table of sources, a few numbers each, is sorted in one task. That holds for some
    ten million of them; with finer ones (each page its own) group them first."""
    cycle = F.array(*(F.lit(w) for w in weights))
    rank = F.row_number().over(Window.orderBy("skey"))
    s = sources.withColumn("w", F.element_at(cycle, F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("long"))
    s = s.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most").cast("double") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(order), F.lit(0)))
    s = s.withColumn("sharing", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0)))
    s = s.withColumn("level", F.col("left").cast("double") / F.col("sharing"))
    # the first source that isn't capped has the largest `sharing` among those that fit
    first = F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("sharing", "level"))).over(everything)
    s = s.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("sharing") > F.col("first.sharing"))
    return s.select("skey", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(F.col("first.level") * F.col("w")).alias("target"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    quality: Column | None = None,
    tie: Column | None = None,
) -> DataFrame:
    """A row for each row: id, size, source_size, target, taken.

    size counts words (runs without space, tab or line break; 0 for a null text);
    sources in code-point order, the null source last, weigh `weights` in turn.
    Keys come from the id, so runs agree; a null id has a key as well, and equal
    rows share a key and lie side by side. taken is at most `cap` times size. An
    empty table gives an empty one. Other columns are not looked at, unless
    `quality` does. `tie`, a whole number, comes through as a column `tie` and puts rows in
    order that are alike in key, id and size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t")).alias("skey"),
        size.alias("size"),
        (quality if quality is not None else default_quality(text, size)).alias("q"),
        *([] if tie is None else [tie.alias("tie")]),
    )
    also = [] if tie is None else ["tie"]
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    rows = rows.withColumn("key", -F.ln((drawn + 1).cast("double") / F.lit(float(1 << 52))) / F.col("q")).drop("q")
    # one scan of the texts; from here on rows are a few numbers
    sized = written(rows.withColumn("nr", F.monotonically_increasing_id()), "sized")
    cut = written(sized.repartitionByRange("skey", "key", "id", "size", *also, "nr").withColumn("part", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_source = targets(sums.groupBy("skey").agg(F.sum("part_size").alias("source_size")), weights, cap)
    ranges = sums.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0))).join(per_source, "skey").drop("part_size")
    within = Window.partitionBy("skey", "part").orderBy("key", "id", "size", *also, "nr").rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(small_or_not(written(ranges, "source-ranges")), ["skey", "part"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - whole * F.col("source_size") - F.col("before") - F.col("ahead")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *also)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#%&*$|!]')) AS marks,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS drawn
  FROM documents),
k AS (SELECT doc_id, skey, size,
             -ln(CAST(drawn + 1 AS DOUBLE) / 4503599627370496.0)
             / CASE WHEN size > 0 THEN 1 / (1 + CAST(marks AS DOUBLE) / size) ELSE 1.0 END AS key FROM d),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY skey),
r AS (SELECT *, source_size * 3 AS most,
             CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY skey) - 1) % 3 AS INT)] AS BIGINT) AS w FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER o, 0) AS BIGINT) AS rest,
             CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS sharing
      FROM r WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(sharing) AS sharing FROM l WHERE CAST(rest AS DOUBLE) / sharing * w <= most),
v AS (SELECT l.sharing, CAST(l.rest AS DOUBLE) / l.sharing AS level FROM l, f WHERE l.sharing = f.sharing),
t AS (SELECT skey, source_size,
             CASE WHEN v.sharing IS NULL OR l.sharing > v.sharing THEN CAST(most AS DOUBLE) ELSE v.level * w END AS target
      FROM l LEFT JOIN v ON true),
c AS (SELECT k.*, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k),
x AS (SELECT c.doc_id, c.size, c.ahead, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
      FROM c JOIN t USING (skey))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - ahead)) AS BIGINT) AS taken
FROM x
"""
