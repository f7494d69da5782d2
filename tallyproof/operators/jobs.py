"""Job postings: cleaning, duplicates, filters, ledger and ranking (from a
specification; nothing to compare with exists)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyproof.functions.fuzzy import ratio
from tallyproof.sources.files import settled


def plain(html: Column) -> Column:
    """Without tags and common entities, white space collapsed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def remote(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low == "", "unknown").when(F.contains(low, F.lit("hybrid")), "hybrid").when(F.contains(low, F.lit("remote")), "yes").otherwise("no")


def dedupe_key(company: Column, title: Column) -> Column:
    clean = F.regexp_replace(F.lower(title), r"\([^)]*\)|[^a-z0-9 ]", " ")
    return F.concat(F.trim(F.lower(company)), F.lit("|"), F.trim(F.regexp_replace(clean, " +", " ")))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def token_ratio(a: str, b: str) -> float:
    """Likeness of two keys with their words in alphabetical order, 0 to 100."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def near_candidates(strings: DataFrame, least: float = 92.0) -> DataFrame:
    """(co, a, b), a before b: pairs of strings `strings`(co, s) of one company that may
    have a likeness of `least`, all that do among them.

    Such strings are few letters apart, and each letter put in or taken out costs a
    string three of its runs of three letters at most. So of the runs of either one,
    ordered by how rare they are in the company, one among the first three times as many
    as there may be such letters, and one more, is among those of the other. Only these
    are posted: what all titles of a company share, like its own name, is at the end of
    that order and brings nobody together. Lengths must fit as well.
    """
    off = 1 - least / 100
    if not 0 <= off <= 0.12:
        raise ValueError("a likeness of 88 to 100 is needed: below, alike strings may share no run of three letters")
    n = F.length("s")
    letters = F.floor(2 * off * n / (1 - off) + 1e-9).cast("int")
    runs = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col("s"), i, F.lit(3)))
    # shorter ones leave no room for another letter, so they are like nothing else
    each = strings.where(n > 2).select("co", "s", n.alias("n"), (3 * letters + 1).alias("most"), F.explode(runs).alias("gram"))
    # a run that comes again in a string counts as another one, with a number
    grams = each.groupBy("co", "s", "n", "most", "gram").agg(F.count("*").cast("int").alias("times"))
    grams = grams.select("co", "s", "n", "most", "gram", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nr"))
    common = grams.groupBy("co", "gram", "nr").agg(F.count("*").alias("held"))
    ranked = grams.join(common, ["co", "gram", "nr"])
    rarest = Window.partitionBy("co", "s").orderBy("held", "gram", "nr")
    posted = settled(ranked.withColumn("place", F.row_number().over(rarest)).where("place <= most").select("co", "s", "n", "gram", "nr"))
    one, two = posted.withColumnsRenamed({"s": "a", "n": "na"}), posted.withColumnsRenamed({"s": "b", "n": "nb"})
    fits = 2 * F.least("na", "nb") + 1e-9 >= (1 - off) * (F.col("na") + F.col("nb"))
    return one.join(two, ["co", "gram", "nr"]).where((F.col("a") < F.col("b")) & fits).select("co", "a", "b").distinct()


def smallest_reached(links: DataFrame) -> DataFrame:
    """(key, of): for each end of `links`(a, b) the smallest key that chains of links lead
    to. Links are turned into stars round by round: each node's larger neighbours are
    linked to the smallest around it, then its smaller ones; rounds grow with the logarithm
    of the longest chain, and no round has more links than were given and ends together."""
    star = settled(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        both = star.unionByName(star.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).withColumnsRenamed({"hi": "u", "lo": "v"})
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small, "hi")
        down = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(small.select("hi", F.col("m").alias("lo"))).distinct()
        again = settled(down)
        if not again.exceptAll(star).limit(1).count() and not star.exceptAll(again).limit(1).count():
            return again.select(F.col("hi").alias("key"), F.col("lo").alias("of")).unionByName(again.select(F.col("lo").alias("key"), F.col("lo").alias("of")).distinct())
        star = again


def near_keys(jobs: DataFrame, least: float = 92.0) -> DataFrame:
    """(key, of): each distinct key of `jobs`(company, key) and the smallest key that
    chains of likenesses of `least` or more lead to, within one company.

    Keys of the same words are alike at once; others meet by `near_candidates`, and
    what meets is scored, each pair of strings once.
    """
    keys = settled(jobs.select(F.trim(F.lower("company")).alias("co"), "key").where("key is not null").distinct().withColumn("s", sorted_tokens(F.replace("key", F.lit("|"), F.lit(" ")))))
    strings = keys.groupBy("co", "s").agg(F.min("key").alias("first"))
    pairs = near_candidates(strings.select("co", "s"), least)
    alike = pairs.where(_ratio("a", "b") >= least)
    first = lambda side: strings.select("co", F.col("s").alias(side), F.col("first").alias(f"key_{side}"))
    links = alike.join(first("a"), ["co", "a"]).join(first("b"), ["co", "b"]).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    same = keys.join(strings, ["co", "s"]).where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    reached = smallest_reached(links.unionByName(same))
    return keys.select("key").distinct().join(reached, "key", "left").select("key", F.coalesce("of", "key").alias("of"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def near_duplicates(jobs: DataFrame, fields: list[str], least: float = 92.0) -> DataFrame:
    """`duplicates`, with keys that are nearly alike counted as one."""
    of = near_keys(jobs, least)
    return duplicates(jobs.join(of, "key").withColumnRenamed("key", "__own").withColumnRenamed("of", "key"), fields).drop("key").withColumnRenamed("__own", "key")


def duplicates(jobs: DataFrame, fields: list[str]) -> DataFrame:
    """`jobs(job_id, key, ...)` with duplicate_of: the fullest row of a key stays,
    ties go to the smallest id."""
    full = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    best = jobs.groupBy("key").agg(F.max(F.struct(full.alias("n"), (-F.col("job_id")).alias("m"))).alias("best"))
    winner = -F.col("best.m")
    return jobs.join(best, "key").withColumn("duplicate_of", F.when(F.col("job_id") != winner, winner)).drop("best")


def ledger(jobs: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Exactly one bucket for each row: the first rule (bucket, rule, condition)
    that applies, else shown."""
    bucket = rule = None
    for b, r, condition in rules:
        c = F.coalesce(condition, F.lit(False))
        bucket = F.when(c, b) if bucket is None else bucket.when(c, b)
        rule = F.when(c, r) if rule is None else rule.when(c, r)
    return jobs.withColumn("bucket", F.lit("shown") if bucket is None else bucket.otherwise("shown")).withColumn("rule", F.lit(None).cast("string") if rule is None else rule)


def unscored(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs whose cached score is missing or of another profile."""
    return pairs.join(scores.select("job_id", "person_id", "profile_hash"), ["job_id", "person_id", "profile_hash"], "left_anti")


def ranked(scores: DataFrame, threshold: int) -> DataFrame:
    nr = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("score"), "job_id"))
    return scores.where(F.col("score") >= threshold).withColumn("position", nr)


def rejects(ledger_rows: DataFrame) -> DataFrame:
    return ledger_rows.where("rule is not null").groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")
