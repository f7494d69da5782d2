"""The whole way from files to judged claims and coverage, for a batch of files."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.functions import values
from tallyproof.operators import claims as K, coverage as C, layout as O, lines as L, tree, verify as V, views
from tallyproof.sources import docx, files, pdf


class EchoProvider:
    """Claims every line word for word; needs no model."""

    def propose(self, messages: list[str]) -> tuple[str, bool]:
        body = messages[0].split("<lines>\n", 1)[1].rsplit("\n</lines>", 1)[0]
        spans = []
        for row in body.split("\n"):
            no, _, text = row.partition(": ")
            if text.strip():
                spans.append({"text": text, "source_lines": [int(no)]})
        return json.dumps({"contact": {}, "other_sections": [{"heading": "", "lines": spans, "source_lines": []}]}), False


K.register("echo", EchoProvider)


def extract(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, lines, dropped) of the text, Markdown, DOCX and PDF files under a path;
    files that are refused keep their row and its code. Blocks of PDFs are put in
    reading order, with zones by their place on the page."""
    found = files.settled(files.classify(files.scan(spark, path, recursive)).withColumn("sha", files.content_key(F.col("content"))))
    good = found.where("reject_code is null")
    text = files.plain_blocks(good.where("kind in ('txt', 'md')").dropDuplicates(["sha"])).select("sha", "seq", "page", "column", "zone", "text", F.lit(False).alias("is_bullet"))
    word = files.settled(docx.docx_blocks(good.where("kind = 'docx'").dropDuplicates(["sha"])))
    length = F.sum(F.coalesce(F.length("text"), F.lit(0)))
    refused = F.when(F.bool_or(F.col("error").isNotNull()), "corrupt_file").when(length < files.MIN_CHARS, "empty_document")
    held = word.groupBy("sha").agg(refused.alias("late"), F.lit(True).alias("read"))
    docs = good.where("kind = 'docx'").select("sha").distinct().join(held, "sha", "left")
    late = docs.select("sha", F.when(F.col("read").isNull(), "empty_document").otherwise(F.col("late")).alias("late")).where("late is not null")
    drawn = files.settled(pdf.pdf_blocks(good.where("kind = 'pdf'").dropDuplicates(["sha"])))
    late = late.unionByName(pdf.verdicts(drawn).where("code is not null").select("sha", F.col("code").alias("late")))
    found = found.join(late, "sha", "left").withColumn("reject_code", F.coalesce("reject_code", "late")).drop("late")
    word = word.join(late, "sha", "left_anti").select("sha", "seq", "page", F.lit(None).cast("int").alias("column"), "zone", "text", "is_bullet")
    placed = O.reading_order(drawn.where("text is not null").join(late, "sha", "left_anti").drop("pages", "error"), "sha")
    zone = values.zone(F.col("y0"), F.col("y1"), F.col("page_height"))
    placed = placed.select("sha", F.col("position").alias("seq"), "page", F.col("column").cast("int").alias("column"), zone.alias("zone"), "text", F.lit(False).alias("is_bullet"))
    lines, dropped = L.to_lines(files.settled(text.unionByName(word).unionByName(placed)), doc="sha")
    return files.settled(found.drop("content")), files.settled(lines), dropped


def structure(lines: DataFrame, provider: str | None = "echo", model: str | None = None) -> DataFrame:
    """(sha, json, status, attempts, error); providers are made where they run, one for
    each partition."""
    name, of = K.resolved(provider, model)  # an unknown name fails here and not in every task
    factory = K.PROVIDERS[name]
    made = (lambda _: factory(model=of)) if "model" in inspect.signature(factory).parameters else (lambda _: factory())
    return files.settled(K.structured(K.prompts(lines, "sha"), made, "sha", each=False))


def verify(parsed: DataFrame, lines: DataFrame, dropped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(judged claims with the labels of links, coverage report). Roles at another
    company are promoted as payloads are taken apart; plain fields count as
    represented on the lines that bear them out, and are flagged where none does."""
    parts = files.settled(tree.taken_apart(parsed.where("status = 'ok'"), "sha"))
    made, fields = tree.claims(parts, "sha"), tree.fields(parts, "sha")
    labels = tree.labelled(made, lines, "sha").select("sha", "claim_id", "label")
    judged = files.settled(V.verify(made, lines, ["sha", "claim_id"], "sha").join(labels, ["sha", "claim_id"], "left"))
    unsourced, borne = V.bare_fields(fields, lines, "sha")
    states = C.line_states(lines, C.claimed_lines(parts, "sha"), C.represented_lines(judged, "sha").unionByName(borne), dropped, "sha")
    return judged, C.report(states, V.flags(judged, "sha").unionByName(unsourced), "sha")


def parse_many(spark: SparkSession, path: str, provider: str | None = "echo", model: str | None = None, out: str | None = None) -> DataFrame:
    """A row for each file in order of its name: percentages or what went wrong. With
    `out`, lines, claims and reports are kept there, a folder for each content key."""
    found, lines, dropped = extract(spark, path)
    parsed = structure(lines, provider, model)
    judged, report = verify(parsed, lines, dropped)
    if out:
        for name, table in (("lines", lines), ("claims", judged), ("reports", report)):
            files.save_keyed(table, f"{out}/{name}")
    failed = found.where("reject_code is not null").select("sha", F.col("reject_code").alias("failure"))
    failed = failed.unionByName(parsed.where("status <> 'ok'").select("sha", F.col("status").alias("failure"))).dropDuplicates(["sha"])
    targets = found.select("name", "sha", F.col("name").alias("input_ord"))
    return views.batch_table(targets, report.select("sha", "coverage_pct", "represented_pct"), failed, "sha").select("name", "coverage_pct", "represented_pct", "failure")


STEPS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extract": lambda spark, path: extract(spark, path)[1].select("sha", "no", "text").orderBy("sha", "no"),
    "structure": lambda spark, path: structure(extract(spark, path)[1]),
    "verify": lambda spark, path: verify(structure(lines := extract(spark, path)[1]), lines)[1].select("sha", "coverage_pct", "represented_pct"),
    "all": parse_many,
}
