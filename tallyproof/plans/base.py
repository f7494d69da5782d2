"""What the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyproof.sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, on all cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Lines of documents, for use in a WITH: dl(doc_id, no, text).
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
DL = rf"""
dl0 AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{BREAK}') AS p FROM documents),
dl1 AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM dl0),
dl AS (SELECT doc_id, CAST(unnest(generate_series(1, len(p))) AS INT) AS no, unnest(p) AS text FROM dl1 WHERE len(p) > 0)
"""
#: Of those: zone by place, first line header, last line footer.
DZ = DL + """,
dz AS (SELECT d.source, l.doc_id, l.no, l.text,
              CASE WHEN l.no = 1 THEN 'header' WHEN l.no = max(l.no) OVER (PARTITION BY l.doc_id) THEN 'footer' ELSE 'body' END AS zone
       FROM dl l JOIN documents d USING (doc_id))
"""
