"""Texts looked up in the lines of documents, by what they can't differ in.

A partial likeness of 95 leaves room for few letters taken out or put in: of one more
pieces of the shorter string than there may be such letters, one stands whole in the
longer one. So pieces of the shorter strings meet runs of as many letters of the longer
ones in an equi-join on their hashes, in both directions, and only strings that share one
are scored, and only where the piece lets the shorter one begin. Most pieces that are met
by chance are told by the letters beside them (`borne_out`), before anything is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyproof.functions.fuzzy import windows_score
from tallyproof.functions.text import folded_ascii, match_key
from tallyproof.operators.lines import split_lines
from tallyproof.operators.verify import THRESHOLD
from tallyproof.sources.files import few, settled

#: Letters of a piece at most; letters of a stretch of a text that is cut into runs at once (a run is found by counting
#: letters from where the stretch begins, so that short ones are faster).
LONGEST, STRETCH = 9, 32
#: Letters that a run is given on either side: those of another piece, and one put in.
BESIDE = LONGEST + 1
#: Fixed value: characters that a line needs to be looked up in a longer item.
LEAST_LINE = 12


def key_of(text: Column) -> Column:
    """`match_key`, inside the JVM for ASCII text."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, folded_ascii(text)).otherwise(match_key(F.when(~plain, text)))


def room(m: Column) -> Column:
    """Letters that may differ where the shorter string has `m`; rounding of scores included."""
    return F.floor(2 * m * (1.000001 - THRESHOLD / 100)).cast("int")


def piece_size(m: Column) -> Column:
    return F.least(F.floor(m / (room(m) + 1)).cast("int"), F.lit(LONGEST))


def _hash(text: Column, size: Column) -> Column:
    return F.xxhash64(size, text).alias("h")


def pieces(rows: DataFrame, own: str) -> DataFrame:
    """(own, m, offset, h, side, other): of each key `k` of m letters its room + 1 pieces,
    which lie side by side, cut in one pass over the key. They are taken two by two: `other`
    is the piece on the right (side 1) or left (-1); a last one may be alone (0)."""
    rows = rows.where("m > 0").withColumn("q", piece_size(F.col("m")))
    cut = F.slice(F.regexp_extract_all("k", F.concat(F.lit("(?s).{"), F.col("q").cast("string"), F.lit("}")), F.lit(0)), F.lit(1), room(F.col("m")) + 1)
    each = rows.select(own, "m", "q", cut.alias("cut")).select(own, "m", "q", "cut", F.posexplode("cut").alias("j", "piece"))
    side = F.when(F.col("j") % 2 == 1, -1).when(F.col("j") + 1 < F.size("cut"), 1).otherwise(0)
    return each.withColumn("side", side).select(
        own, "m", (F.col("j") * F.col("q")).alias("offset"), _hash(F.col("piece"), F.col("q")), "side", F.get("cut", F.col("j") + F.col("side")).alias("other")
    )


def runs(rows: DataFrame, own: str, sizes: list[int]) -> DataFrame:
    """(own, m, at, h, q, s, i): all runs of `sizes` letters q of each key `k`; s has the letters
    from BESIDE before the run to BESIDE behind it from its letter i on. The key is cut into
    stretches first, each with the letters that a run from it may reach into, so that a
    very long line costs no more for each letter than a short one."""
    stretch = F.regexp_extract_all("k", F.lit(rf"(?s)(?=(.{{1,{BESIDE + STRETCH + LONGEST - 1 + BESIDE}}})).{{1,{STRETCH}}}"), F.lit(1))
    # no piece reaches into what is put before the beginning
    ahead = F.concat(F.lit("\0" * BESIDE), "k").alias("k")
    parts = rows.where("m > 0").select(own, "m", ahead).select(own, "m", F.posexplode(stretch).alias("part", "s")).withColumn("n", F.col("m") - F.col("part") * STRETCH)

    # rows, not arrays, so that all of it stays in generated code
    each = parts.select(own, "m", "part", "s", "n", F.explode(F.array(*map(F.lit, sizes))).alias("q")).where("n >= q")
    each = each.withColumn("last", F.least(F.lit(STRETCH), F.col("n") - F.col("q") + 1)).select(own, "m", "part", "s", "q", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("i"))
    return each.select(own, "m", (F.col("part") * STRETCH + F.col("i") - 1).alias("at"), _hash(F.substring("s", F.col("i") + BESIDE, F.col("q")), F.col("q")), "q", "s", "i")


def borne_out() -> Column:
    """Whether a piece that meets a run can be the one by which the strings are alike.

    Of pieces that are more than the letters that differ, some two hold fewer such letters
    than pieces, or the one alone holds none. So one stands whole, with the other next to
    it, of which one letter at most is missing or put in: either its near half is whole in
    its place, or its far half is, one letter off.
    """
    q, other, beside = F.col("q"), F.col("other"), F.substring("s", F.col("i"), F.col("q") + 2 * BESIDE)
    near = F.floor(q / 2).cast("int")
    far = q - near
    same = lambda start, n, of: F.substring(beside, start + 1, n) == F.substring(other, of + 1, n)
    end = q + BESIDE
    right = same(end, near, F.lit(0)) | same(end + near - 1, far, near) | same(end + near + 1, far, near)
    left = same(BESIDE - near, near, far) | same(BESIDE - q - 1, far, F.lit(0)) | same(BESIDE - q + 1, far, F.lit(0))
    return F.when(F.col("side") == 1, right).when(F.col("side") == -1, left).otherwise(True)


def _meet(all_lines: DataFrame, all_items: DataFrame, fits: str) -> DataFrame:
    """Pieces and runs of one hash. Where items are too many to go out to the lines, both are
    shuffled, and without the letters that `borne_out` looks at."""
    known = few(all_items)
    if known is all_items:
        return all_lines.drop("s", "i", "other").join(all_items.drop("s", "i", "other"), "h").where(fits)
    return all_lines.join(known, "h").where(fits).where(borne_out())


@F.pandas_udf(DoubleType())
def _best(item: pd.Series, line: pd.Series, inside: pd.Series, around: pd.Series) -> pd.Series:
    """The better of the item's windows in the line and the line's in the item, at the
    places where a shared piece lets them begin."""

    def one(a: str, b: str, starts: list[int], others: list[int]) -> float:
        best = windows_score(a, b, sorted(starts), THRESHOLD) if len(starts) else 0.0
        return max(best, windows_score(b, a, sorted(others), THRESHOLD)) if len(others) else best

    return pd.Series([one(*r) for r in zip(item, line, inside, around, strict=True)], dtype="float64")


def fuzzy_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, no, score) of all items (item_id, text) and all single lines of
    documents whose keys score 95 or more.

    A line that is shorter than its item has 12 characters at least; an item with a null
    text or an empty key is nowhere. Lines are keyed once and written; their runs are
    exploded once, whatever the number of items. Items go out to the lines where a count
    shows them few; otherwise both are shuffled by hash, and adaptive execution splits a
    run that very many lines share. What is shuffled further are places, not texts, of pieces
    that are borne out by what is beside them.
    """
    lines = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("no", "line"))
    lines = lines.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.col("no") + 1).alias("no"), key_of(F.col("line")).alias("k"), (F.length("line") >= LEAST_LINE).alias("long"))
    lines = settled(lines.where("k <> ''").withColumn("m", F.length("k")))
    wanted = items.where("text is not null").select(F.monotonically_increasing_id().alias("item"), "item_id", match_key(F.col("text")).alias("k")).where("k <> ''")
    wanted = settled(wanted.withColumn("m", F.length("k")))
    sizes = wanted.agg(F.sort_array(F.collect_set(piece_size(F.col("m")))).alias("q"), F.max("m").alias("longest"), F.min("m").alias("shortest")).first()
    if not sizes["q"]:
        return lines.join(wanted, F.lit(False)).select("doc_id", "item_id", "no", F.lit(0.0).alias("score"))
    # items that are the shorter ones: at most LONGEST sizes of their pieces
    own = pieces(wanted, "item").withColumnRenamed("m", "mi")
    inside = _meet(runs(lines.where(F.col("m") >= sizes["shortest"]), "row", sizes["q"]), own, "mi <= m")
    inside = inside.select("row", "item", (F.col("at") - F.col("offset")).alias("inside"), F.lit(None).cast("int").alias("around"))
    # lines that are
    short = pieces(lines.where("long").where(F.col("m") <= sizes["longest"]), "row")
    shorter = [q for q in range(1, LONGEST + 1)]
    around = _meet(short, runs(wanted, "item", shorter).withColumnRenamed("m", "mi"), "m <= mi")
    around = around.select("row", "item", F.lit(None).cast("int").alias("inside"), (F.col("at") - F.col("offset")).alias("around"))
    met = inside.unionByName(around).groupBy("row", "item").agg(F.collect_set("inside").alias("inside"), F.collect_set("around").alias("around"))
    met = few(settled(met))
    texts = lines.select("row", "doc_id", "no", F.col("k").alias("line")).join(met, "row").join(few(wanted.select("item", "item_id", F.col("k").alias("wanted"))), "item")
    scored = texts.select("doc_id", "item_id", "no", F.round(_best("wanted", "line", "inside", "around"), 4).alias("score"))
    return scored.where(F.col("score") >= THRESHOLD)
