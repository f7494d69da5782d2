"""Whether claims are borne out by the lines they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.functions.fuzzy import MIN_EXACT, MIN_PARTIAL, claim_score
from tallyproof.functions.text import contains_word, folded_ascii

# Fixed value: the score that verifies.
THRESHOLD = 95.0


def cited_text(claims: DataFrame, lines: DataFrame, keys: list[str], doc: str = "doc_id") -> DataFrame:
    """`claims` with n_cited, n_missing, the cited lines joined by spaces, and (if a cited
    line was joined of halves) the same with the halves apart. `keys` name a claim: rows
    that share them count as one.

    A claim's own columns ride along with the first line that it cites, so that claims
    needn't be joined to their lines a second time, nor are repeated for each of them.
    """
    others = [c for c in claims.columns if c not in keys]
    place = claims.select(*{doc, *keys}, F.struct(*others).alias("__own"), F.posexplode_outer("source_lines").alias("pos", "no"))
    cited = place.withColumn("__own", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("__own")))
    halves = F.when(F.size("unjoined") > 0, F.array_join("unjoined", " "))
    shown = lines.select(doc, "no", F.col("text").alias("line"), (halves if "unjoined" in lines.columns else F.lit(None).cast("string")).alias("halves"))
    rows = cited.join(shown, [doc, "no"], "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("line", F.lit("")).alias("line"), F.coalesce("halves", "line", F.lit("")).alias("apart"))))
    out = rows.groupBy(*keys).agg(
        F.first("__own", ignorenulls=True).alias("__own"), F.count("pos").alias("n_cited"), F.count(F.when(F.col("pos").isNotNull() & F.col("line").isNull(), 1)).alias("n_missing"),
        F.count("halves").alias("n_halved"), parts.alias("parts"),
    )
    return out.select(
        *keys, *(F.col("__own").getField(c).alias(c) for c in others), "n_cited", "n_missing",
        F.when(F.col("n_cited") > 0, F.array_join(F.transform("parts", lambda p: p["line"]), " ")).alias("joined"),
        F.when(F.col("n_halved") > 0, F.array_join(F.transform("parts", lambda p: p["apart"]), " ")).alias("apart"),
    )


def _hopeless(k: Column, text: Column, floor: float) -> Column:
    """Whether no likeness of two keys can be above `floor`, which is about the threshold.

    Strings that alike differ in at most a twentieth of their letters together, which is
    less than a ninth of the shorter one's: of one more pieces of it than that, one stands
    whole in the longer one. A short claim that the text doesn't contain is only measured
    against the whole text, whose length must then be about the same.
    """
    m = F.least(F.char_length(k), F.char_length(text))
    shorter, longer = F.when(F.char_length(k) <= F.char_length(text), k).otherwise(text), F.when(F.char_length(k) <= F.char_length(text), text).otherwise(k)
    n = F.floor(m / 9).cast("int") + 1
    size = F.floor(m / n).cast("int")
    shared = F.exists(F.sequence(F.lit(0), n - 1), lambda j: F.contains(longer, F.substring(shorter, j * size + 1, size)))
    length = (F.char_length(k) < MIN_PARTIAL) & (200.0 * m <= floor * (F.char_length(k) + F.char_length(text)))
    return length | ~shared


def _verbatim(claim: Column, text: Column) -> Column:
    """Whether a claim stands in a text as it is, between spaces or ends. Then its key stands
    so in the text's key, whatever letters it has: keys are made character by character, and
    of runs that a space ends. Four ASCII letters or digits, which keys keep, make it long enough."""
    space = F.lit(" ")
    inside = F.contains(F.concat(space, text, space), F.concat(space, claim, space))
    return F.coalesce(inside, F.lit(False)) & F.regexp_like(claim, F.lit(rf"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){{{MIN_EXACT}}}"))


def score(claims: DataFrame, lines: DataFrame, keys: list[str], text_col: str = "text", doc: str = "doc_id", floor: float = 0.0) -> DataFrame:
    """`claims` with `score` (0 to 100) and `n_missing`.

    One pass over claims joined to what they cite. A claim that stands in them as it is, and ASCII text that, in either form, contains the claim
    word for word scores 100 with built-in functions; where a `floor` says that only a
    verdict is wanted, ASCII text that can't reach it is told by built-in functions too.
    Only what is left reaches the similarity UDF, which gets nulls for all other rows.
    The figure is the best of containment, whole-string ratio, and (for claims long
    enough) partial ratio, also below the threshold, unless there is a floor: then it is
    0 below that.
    """
    claim = F.coalesce(F.col(text_col), F.lit(""))
    void = (F.col("n_cited") == 0) | (F.col("n_missing") > 0)
    # most claims are told here, before any key is made
    told = F.when(void, 0.0).when(_verbatim(claim, F.col("joined")) | _verbatim(claim, F.col("apart")), 100.0)
    rows = cited_text(claims, lines, keys, doc).withColumn("__told", told)
    plain = lambda c: F.when(F.col("__told").isNull() & (F.octet_length(c) == F.char_length(c)), folded_ascii(c))
    rows = rows.withColumn("__k", plain(claim)).withColumn("__k1", plain(F.col("joined"))).withColumn("__k2", plain(F.col("apart")))
    k, k1, k2 = F.col("__k"), F.col("__k1"), F.col("__k2")
    known = F.when(F.col("__told").isNotNull(), F.col("__told")).when((F.char_length(k) >= MIN_EXACT) & (contains_word(k1, k) | contains_word(k2, k)), 100.0)
    if floor >= THRESHOLD - 1e-3:
        known = known.when(k.isNotNull() & k1.isNotNull() & _hopeless(k, k1, floor) & (F.col("apart").isNull() | _hopeless(k, k2, floor)), 0.0)
    rows = rows.withColumn("__known", known)
    pending = F.col("__known").isNull()
    asked = [F.when(pending, c) for c in (claim, F.col("joined"), F.col("apart"))]
    return rows.withColumn("score", F.coalesce("__known", claim_score(*asked, F.lit(floor)))).drop("__known", "__told", "__k", "__k1", "__k2", "joined", "apart", "n_cited")


def verify(claims: DataFrame, lines: DataFrame, keys: list[str] | None = None, doc: str = "doc_id", verdicts_only: bool = False) -> DataFrame:
    """`claims` with score, verified, flag and reason; verdicts that came along are
    thrown away. With `verdicts_only`, scores that don't verify are 0, not worked out."""
    keys = keys or [doc, "claim_id"]
    judged = score(claims.drop("verified", "flag"), lines, keys, doc=doc, floor=THRESHOLD - 1e-6 if verdicts_only else 0.0)
    ok = F.col("score") >= THRESHOLD
    reason = F.when(~ok, F.when(F.col("n_missing") > 0, "source_line_out_of_range").otherwise("hallucinated_span"))
    return judged.withColumn("verified", ok).withColumn("flag", F.when(ok, "ok").otherwise("hallucinated")).withColumn("reason", reason).drop("n_missing")


def flags(judged: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, no, reason), one for each line that a failed claim cites, line 0 for
    one that cites none; duplicates stay."""
    failed = judged.where(~F.col("verified"))
    return failed.select(doc, F.explode_outer("source_lines").alias("no"), "reason").withColumn("no", F.coalesce("no", F.lit(0)))


def _asked(fields: DataFrame, doc: str) -> DataFrame:
    """What plain fields (doc, object_path, field, value, source_lines) ask: whether their
    object's lines bear them out, as a block and each by itself (`cited`)."""
    long_ = fields.where((F.length(F.trim("value")) >= MIN_EXACT) & (F.size("source_lines") > 0)).select(doc, "object_path", "field", F.col("value").alias("text"), "source_lines")
    block = long_.select(F.lit("block").alias("asks"), "*", F.lit(None).cast("int").alias("cited"))
    each = long_.select(F.lit("line").alias("asks"), doc, "object_path", "field", "text", F.explode(F.array_distinct("source_lines")).alias("cited"))
    return block.unionByName(each.withColumn("source_lines", F.array("cited")))


def judge(claims: DataFrame | None, fields: DataFrame, lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All verdicts of documents in one relation, scored in one pass: (asks, doc, claim_id,
    object_path, field, cited, source_lines, verified, reason). `asks` is claim, block (a
    plain field by its object's lines) or line (by one of them)."""
    asked = _asked(fields, doc)
    if claims is not None:
        own = claims.select(F.lit("claim").alias("asks"), doc, "claim_id", "text", "source_lines")
        asked = own.unionByName(asked, allowMissingColumns=True)
    else:
        asked = asked.withColumn("claim_id", F.lit(None).cast("long"))
    keys = ["asks", doc, "claim_id", "object_path", "field", "cited"]
    judged = score(asked, lines, keys, doc=doc, floor=THRESHOLD - 1e-6)
    ok = F.col("score") >= THRESHOLD
    said = F.when(F.col("asks") == "block", F.concat(F.lit("unsourced_"), F.col("field"))).when(F.col("n_missing") > 0, "source_line_out_of_range").otherwise("hallucinated_span")
    return judged.select(*keys, "source_lines", ok.alias("verified"), F.when(~ok & (F.col("asks") != "line"), said).alias("reason"))


def marks(judged: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, no, claimed, represented, reasons): what the verdicts of `judge` say of each
    line, by one grouping; line 0 for failed claims that cite none."""
    asks, ok = F.col("asks"), F.col("verified")
    about = (
        F.when((asks == "claim") & (F.size("source_lines") > 0), F.col("source_lines"))
        .when((asks == "claim") & ~ok, F.array(F.lit(0)))
        .when((asks == "block") & ~ok, F.slice("source_lines", 1, 1))
        .when((asks == "line") & ok, F.array("cited"))
    )
    claims_it = (asks == "line") | ((asks == "claim") & (F.size("source_lines") > 0))
    rows = judged.select(doc, F.explode(about).alias("no"), claims_it.alias("claimed"), (claims_it & ok).alias("represented"), "reason")
    rows = rows.withColumn("no", F.coalesce("no", F.lit(0)))
    return rows.groupBy(doc, "no").agg(F.bool_or("claimed").alias("claimed"), F.bool_or("represented").alias("represented"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def bare_fields(fields: DataFrame, lines: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Plain fields (doc, object_path, field, value, source_lines) against their
    object's lines: flags (doc, no, reason) for those that the whole block doesn't
    bear out, and (doc, no) of single lines that bear one out. Who wants both settles
    `judge` and reads it twice; each alone scores nothing but its own rows."""
    judged = judge(None, fields, lines, doc)
    unsourced = judged.where((F.col("asks") == "block") & ~F.col("verified")).select(doc, F.element_at("source_lines", 1).alias("no"), "reason")
    return unsourced, judged.where((F.col("asks") == "line") & F.col("verified")).select(doc, F.col("cited").alias("no")).distinct()
