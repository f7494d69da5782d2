"""Answers to closed questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.schema import DECLINE, QUESTIONS


def domain(spark: SparkSession) -> DataFrame:
    """(question, option, multi); every question may be declined."""
    rows = [(q, o, multi) for q, options, multi in QUESTIONS for o in (*options, DECLINE)]
    return spark.createDataFrame(rows, "question string, option string, multi boolean")


def violations(answers: DataFrame, offered: DataFrame, who: str = "person_id") -> DataFrame:
    """(who, question, reason) for answers (who, question, option) that break the
    rules: unknown_question, several_answers, unknown_option."""
    asked = offered.groupBy("question").agg(F.first("multi").alias("multi"))
    given = answers.groupBy(who, "question").agg(F.count("*").alias("n")).join(asked, "question", "left")
    bad = F.when(F.col("multi").isNull(), "unknown_question").when(~F.col("multi") & (F.col("n") > 1), "several_answers")
    first = given.select(who, "question", bad.alias("reason")).where("reason is not null")
    odd = answers.join(asked, "question", "left_semi").join(offered.select("question", "option").distinct(), ["question", "option"], "left_anti")
    return first.unionByName(odd.select(who, "question", F.lit("unknown_option").alias("reason")).distinct())


def states(people: DataFrame, answers: DataFrame, who: str = "person_id") -> DataFrame:
    """never_asked, declined (every answer declines) or answered."""
    seen = answers.groupBy(who).agg(F.bool_and(F.col("option") == DECLINE).alias("declined"))
    state = F.when(F.col("declined").isNull(), "never_asked").when(F.col("declined"), "declined").otherwise("answered")
    return people.select(who).join(seen, who, "left").select(who, state.alias("state"))
