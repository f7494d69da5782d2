"""Prefix trie of conversations, built level by level.

Conversations are rebuilt and numbered without bringing one into one task: rows are
sorted in ranges, and counts of the ranges before give the places. From then on a turn
is a few numbers: conversation, depth, a digest of (role, text), code points.

Per depth, live conversations are grouped by (parent node, next turn); the smallest
conv_id of a group names the node. A group whose members are all one and the same
conversation (one member alone, or copies) can't branch any more: it leaves the loop,
and its chain of nodes down to the end is read off the turns of its smallest member.
So the loop ends with the depth to which unlike conversations agree. Leaves and savings
then go up the levels in reverse, each level joined to the sums of its children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyproof.llm.common import BROADCAST_ROWS, small_or_not, workspace, written

#: Turns that a conversation may take from its base at most, so h is below this.
HEADS = 6
#: conv_ids that are joined to one string before their digest is worked out.
CHUNK = 4096
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, key, chars) with their place k in the conversation, from 1, and
    the code points up to it: by ranges, so that a long conversation is many tasks."""
    rows = written(rows.withColumn("nr", F.monotonically_increasing_id()), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("key"), F.col("nr")]  # nr only deals out equal rows
    cut = written(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    sums = sums.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    # only conversations that begin in an earlier range need their sums
    late = small_or_not(written(sums.where("n0 > 0"), "range-sums"))
    within = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumn("k", F.count("*").over(within)).withColumn("upto", F.sum("chars").over(within))
    out = out.join(late, ["conv", "part"], "left")
    return out.select("conv", (F.col("k") + F.coalesce("n0", F.lit(0))).alias("k"), "key", "chars", (F.col("upto") + F.coalesce("c0", F.lit(0))).alias("upto"))


def crc_heads(conv: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, d, key, chars, upto): turns of the rebuilt conversations, upto the code points
    up to each; and (conv, len, total, fp1, fp2): a row for every conversation, turnless
    ones included, with two fingerprints of all its turns."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.length(text).cast("long").alias("chars"))
    own = written(_numbered(rows.where("conv is not null")), "numbered")
    # at most HEADS - 1 turns of a conversation can be a head
    heads = own.where(F.col("k") < HEADS).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", "key", "chars", "upto"))).alias("heads"))
    sizes = own.groupBy("conv").agg(F.count("*").alias("n"), F.sum("chars").alias("own_chars")).join(heads, "conv")
    base = F.col("conv") - F.col("conv") % 100
    convs = sizes.withColumn("h", crc_heads(F.col("conv"))).withColumn("base", base)
    convs = convs.join(heads.select(F.col("conv").alias("base"), F.col("heads").alias("from_base")), "base", "left")
    last = lambda heads, n: F.when(n > 0, F.element_at(heads, n)["upto"]).otherwise(F.lit(0))
    convs = convs.withColumn("taken", F.least(F.col("h"), F.coalesce(F.size("from_base"), F.lit(0)).cast("int")))
    convs = convs.withColumn("left_out", F.least(F.col("h"), F.size("heads"))).withColumn("shift", F.col("taken") - F.col("left_out"))
    convs = convs.withColumn("chars_shift", last(F.col("from_base"), F.col("taken")) - last(F.col("heads"), F.col("left_out")))
    convs = written(convs, "conversations")
    head = convs.where("taken > 0").select("conv", F.explode(F.slice("from_base", F.lit(1), F.col("taken"))).alias("t"))
    head = head.select("conv", F.col("t.k").alias("d"), "t.key", "t.chars", "t.upto")
    shifts = small_or_not(convs.select("conv", "left_out", "shift", "chars_shift"))
    tail = own.join(shifts, "conv").where(F.col("k") > F.col("left_out"))
    tail = tail.select("conv", (F.col("k") + F.col("shift")).alias("d"), "key", "chars", (F.col("upto") + F.col("chars_shift")).alias("upto"))
    turns = written(head.unionByName(tail).repartitionByRange("d", "conv").sortWithinPartitions("d"), "rebuilt")
    prints = turns.groupBy("conv").agg(F.bit_xor(F.xxhash64("d", "key")).alias("fp1"), F.bit_xor(F.xxhash64("key", "d", F.lit(7))).alias("fp2"))
    whole = convs.select("conv", (F.col("n") + F.col("shift")).alias("len"), (F.col("own_chars") + F.col("chars_shift")).alias("total"))
    whole = whole.join(prints, "conv", "left").na.fill(0, ["fp1", "fp2"])
    return turns, written(whole, "whole")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, node, conv) to strings of up to CHUNK ids, as they come."""
    now, ids = None, []

    def out():
        return pa.RecordBatch.from_pydict({"depth": [now[0]], "node": [now[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    for batch in batches:
        for d, n, c in zip(*(batch.column(k).to_pylist() for k in ("depth", "node", "conv")), strict=True):
            if ids and (now != (d, n) or len(ids) == CHUNK):
                yield out()
                ids = []
            now = (d, n)
            ids.append(c)
    if ids:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (depth, node, first) to a digest for each node, read as a stream."""
    now, state = None, None
    schema = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends", pa.string())])
    row = lambda: pa.RecordBatch.from_pydict({"depth": [now[0]], "node": [now[1]], "ends": [state.hexdigest()]}, schema=schema)
    for batch in batches:
        for d, n, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "node", "ids")), strict=True):
            if now != (d, n):
                if now:
                    yield row()
                now, state = (d, n), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if now:
        yield row()


def few(df: DataFrame, count: int) -> DataFrame:
    """`df`, to be broadcast where `count`, a bound on its rows, is small."""
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends): SHA-256 of the ids of each (depth, node) in `ends`, ascending
    and comma-joined. The ids are joined in sorted ranges first, so that a node where very
    many end is a row for every CHUNK of them when its digest is worked out in order."""
    chunks = ends.repartitionByRange("depth", "node", "conv").sortWithinPartitions("depth", "node", "conv")
    chunks = chunks.mapInArrow(_chunks, "depth long, node long, first long, ids string")
    return chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node long, ends string")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node of the trie over all rebuilt conversations, the root included.

    Turns go by `turn_col`, null first, ties by a digest of role and text; null roles and
    texts count as empty. Rows with a null conversation id belong to none and are left out;
    rows that repeat are turns of their own. Conversations may be turnless: they are members
    of the root. An empty table gives no node. Other columns are not looked at.
    """
    spark = df.sparkSession
    turns, whole = rebuilt(df, conv_col, turn_col, role_col, text_col)
    kind = (F.min("fp1") == F.max("fp1")) & (F.min("fp2") == F.max("fp2")) & (F.min("len") == F.max("len")) & (F.min("total") == F.max("total"))
    sums = [F.min("conv").alias("node"), F.count("*").alias("n"), kind.alias("same"), F.max("chars").alias("chars")]
    top = whole.withColumn("chars", F.lit(0).cast("long")).agg(*sums).first()
    if not top["n"]:
        return spark.createDataFrame([], SCHEMA)
    root = {"parent": None, **top.asDict()}
    kinds = {"parent": "long", "node": "long", "n": "long", "same": "boolean", "chars": "long"}
    levels = [spark.range(1).select(*(F.lit(root[c]).cast(t).alias(c) for c, t in kinds.items()))]
    members = whole.withColumn("node", F.lit(top["node"]).cast("long"))
    live = members if not top["same"] else members.limit(0)
    ends, rolled = workspace(spark, "ends"), workspace(spark, "rolled")
    members.where("len = 0" if not top["same"] else "true").select(F.col("len").alias("depth"), "node", "conv").write.parquet(ends)
    counts, depth, open_nodes = [1], 0, 0 if top["same"] else 1
    while open_nodes:
        depth += 1
        at = turns.where(F.col("d") == depth).select("conv", "key", "chars")
        step = written(live.withColumnRenamed("node", "parent").where(F.col("len") >= depth).join(at, "conv"), "step")
        level = written(step.groupBy("parent", "key").agg(*sums), "level")
        size = level.agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("open")).first()
        levels.append(level)
        counts.append(size["n"])
        open_nodes = size["open"]
        # single conversations go no further
        known = few(level.where("not same or n > 1").select("parent", "key", "node", "same"), size["n"])
        members = step.join(known, ["parent", "key"]).drop("parent", "key", "chars")
        live = members.where("not same").drop("same")
        done = (F.col("len") == depth) | F.col("same")
        members.where(done).select(F.col("len").alias("depth"), "node", "conv").write.mode("append").parquet(ends)
    # chains of nodes below those that can't branch, their first node among them
    heads = [lv.where("same").select(F.lit(k).cast("long").alias("top"), "node", "parent", "n") for k, lv in enumerate(levels)]
    settled = reduce(DataFrame.unionByName, heads)
    settled = written(settled.join(whole.select(F.col("conv").alias("node"), "len", "total"), "node"), "settled")
    below = turns.join(small_or_not(settled).withColumnRenamed("node", "conv"), "conv").where(F.col("d") >= F.col("top"))
    saves = (F.col("n") - 1) * (F.col("total") - F.col("upto") + F.col("chars"))
    chain = below.select(
        F.col("conv").alias("node"), F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent"), "n",
        (F.col("d") < F.col("len")).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), saves.alias("saved"),
        F.when((F.col("d") == F.col("len")) & (F.col("n") == 1), F.sha2(F.col("conv").cast("string"), 256)).alias("alone"),
    )
    # the root where it can't branch has no turn of its own
    crown = settled.where("top = 0").select("node", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n", (F.col("len") > 0).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("total")).alias("saved"), F.when((F.col("len") == 0) & (F.col("n") == 1), F.sha2(F.col("node").cast("string"), 256)).alias("alone"))
    found = chain.unionByName(crown)
    # leaves and savings go up, level by level
    up = None
    for k in range(depth, -1, -1):
        here = settled.where(F.col("top") == k)
        gains = []
        if k:
            here = here.join(turns.where(F.col("d") == k).select(F.col("conv").alias("node"), "upto", "chars"), "node")
            gains.append(here.select("parent", F.lit(1).cast("long").alias("leaves"), saves.alias("saved")))
        if up is not None:
            rows = levels[k].where("not same").join(few(up, counts[k]), "node")
            rows = rows.select("node", F.lit(k).cast("long").alias("depth"), "parent", "n", "kids", "leaves", (F.col("below") + (F.col("n") - 1) * F.col("chars")).alias("saved"), F.lit(None).cast("string").alias("alone"))
            rows.write.parquet(f"{rolled}/{k}")
            rows = spark.read.schema(rows.schema).parquet(f"{rolled}/{k}")
            gains.append(rows.select("parent", "leaves", "saved"))
        if k:
            both = gains[0] if len(gains) == 1 else gains[0].unionByName(gains[1])
            up = written(both.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below")), "sums")
    if depth:
        found = found.unionByName(spark.read.schema(found.schema).parquet(*(f"{rolled}/{k}" for k in range(depth))))
    marks = written(digests(spark.read.schema("depth long, node long, conv long").parquet(ends)), "digests")
    out = found.join(marks, ["depth", "node"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("alone", "ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


TRIE_SQL = """
WITH o AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, key, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS k FROM o),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM o),
h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(s) + 1), lambda j: CAST(ascii(substr(s, j, 1)) AS UBIGINT))),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(1 AS UBIGINT), 1, 1, 1, 1, 1, 1, 1]),
                                      lambda x, y: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT)) % 6 AS h
  FROM ids),
r AS (
  SELECT h.conv_id, k.k AS d, k.key, k.chars FROM h JOIN k ON k.conv_id = h.base AND k.k <= h.h
  UNION ALL
  SELECT h.conv_id, k.k - h.h + (SELECT count(*) FROM k b WHERE b.conv_id = h.base AND b.k <= h.h), k.key, k.chars
  FROM h JOIN k ON k.conv_id = h.conv_id AND k.k > h.h),
p AS (
  SELECT conv_id, d, chars, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM h),
m AS (SELECT conv_id, d, chars, min(conv_id) OVER (PARTITION BY d, path) AS node, max(d) OVER (PARTITION BY conv_id) AS len FROM p),
n AS (
  SELECT d, node, count(*) AS n, max(chars) AS chars,
         sha256(coalesce(string_agg(CASE WHEN d = len THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
  FROM m GROUP BY d, node),
u AS (SELECT n.*, up.node AS parent FROM n LEFT JOIN m up ON up.conv_id = n.node AND up.d = n.d - 1),
c AS (SELECT d - 1 AS d, parent AS node, count(*) AS kids FROM u WHERE d > 0 GROUP BY d, parent),
t AS (
  SELECT m.d, m.node, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (WHERE c.kids IS NULL) AS leaves
  FROM n JOIN m ON m.conv_id = n.node AND m.d <= n.d LEFT JOIN c ON c.d = n.d AND c.node = n.node
  GROUP BY m.d, m.node)
SELECT u.node AS conv_id, CAST(u.d AS BIGINT) AS depth, u.parent AS parent_conv_id, u.n AS n_convs, CAST(coalesce(c.kids, 0) AS BIGINT) AS n_children,
       CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, u.ends AS ends_sha256
FROM u JOIN t ON t.d = u.d AND t.node = u.node LEFT JOIN c ON c.d = u.d AND c.node = u.node
"""
