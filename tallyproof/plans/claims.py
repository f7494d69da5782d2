"""Queries on claims, coverage and their views."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyproof.functions import text as T
from tallyproof.operators import claims as K, coverage as C, spans, tree, verify as V, views
from tallyproof.plans.base import DL, documents, query, table
from tallyproof.plans.lines import KEY, document_lines
from tallyproof.sources.files import settled

#: The key of a text, the test for one in another between word boundaries, and (for text that isn't in the other word for
#: word) whether a likeness of 95 is out of the question: it leaves room for m / 10 changed letters, so that one of more pieces of the
#: shorter string than that would stand whole in the other.
_WORDS_IN = r"({k1} LIKE '%' || replace(replace(replace({k}, '\', '\\'), '%', '\%'), '_', '\_') || '%' ESCAPE '\' AND regexp_matches({k1}, '(^|[^\pL\pM\pN_])' || regexp_escape({k}) || '($|[^\pL\pM\pN_])'))"


def _judged(rows: str, keys: str) -> str:
    """CTEs that judge `rows`(keys, text, joined, apart, missing, n_cited): containment by regular expression, short strings by their longest
    common subsequence, worked out row by row; long ones by changed letters and by pieces. What can't be decided is null, and would show."""
    inside = " OR ".join(f"coalesce({_WORDS_IN.format(k="k", k1=x)}, false)" for x in ("k1", "k2"))
    return rf"""
kd AS (SELECT *, {KEY.replace('{t}', 'trim(text)')} AS k, {KEY.replace('{t}', 'trim(joined)')} AS k1, {KEY.replace('{t}', 'trim(apart)')} AS k2 FROM {rows}),
ex AS MATERIALIZED (SELECT *, CASE WHEN n_cited = 0 OR missing > 0 OR k = '' THEN false WHEN length(k) >= 4 AND ({inside}) THEN true END AS sure FROM kd),
sh AS (SELECT DISTINCT k, k1, string_split(k, '') AS a, string_split(k1, '') AS b FROM ex WHERE sure IS NULL AND length(k) < 12 AND length(k1) BETWEEN length(k) - 2 AND length(k) + 2),
lc AS (SELECT k, k1, a, b, 0 AS i, [0 for x IN b] AS r FROM sh
  UNION ALL SELECT k, k1, a, b, i + 1, [list_max([greatest(r[h], CASE WHEN a[i + 1] = b[h] THEN 1 + CASE WHEN h > 1 THEN r[h - 1] ELSE 0 END ELSE 0 END) FOR h IN generate_series(1, j)]) FOR j IN generate_series(1, len(b))] FROM lc WHERE i < len(a)),
ls AS (SELECT k, k1, 200.0 * r[len(b)] / (len(a) + len(b)) >= 95 AS like95 FROM lc WHERE i = len(a)),
pc AS (SELECT DISTINCT k, k1, k2, least(length(k), length(k1)) AS m, CASE WHEN length(k) <= length(k1) THEN k ELSE k1 END AS s, CASE WHEN length(k) <= length(k1) THEN k1 ELSE k END AS l FROM ex WHERE sure IS NULL AND length(k) >= 12),
pp AS (SELECT k, k1, m, s, l, m // 10 + 1 AS n, unnest(generate_series(0, m // 10)) AS j FROM pc WHERE m > 0),
po AS (SELECT k, k1, bool_or(contains(l, s[1 + j * m // n : (j + 1) * m // n])) AS may FROM pp GROUP BY 1, 2),
jd AS (SELECT {keys}, ex.text, n_cited, missing, CASE WHEN sure IS NOT NULL THEN sure
    WHEN length(ex.k) < 12 THEN coalesce(ls.like95, false)
    WHEN length(ex.k) = length(ex.k1) AND 20 * len([1 FOR p IN list_zip(string_split(ex.k, ''), string_split(ex.k1, '')) IF p[1] <> p[2]]) <= length(ex.k) THEN true
    WHEN NOT coalesce(po.may, false) THEN false END AS ok
  FROM ex LEFT JOIN ls ON ls.k = ex.k AND ls.k1 = ex.k1 LEFT JOIN po ON po.k = ex.k AND po.k1 = ex.k1)
"""


#: Claims on the lines of documents: most as they are; some made up, with a letter changed, over two lines in either order, cut to three or
#: four letters, by the halves of a joined line, citing nothing or what isn't there.
_CLAIMS = DL + r""",
du AS (SELECT doc_id, no, text, CASE WHEN no % 9 = 0 THEN text[1 : length(text) // 2] || '- ' || text[length(text) // 2 + 1 :] END AS halves FROM dl),
dn AS (SELECT *, lead(text) OVER w AS nt, coalesce(lead(halves) OVER w, lead(text) OVER w) AS nh, lead(halves) OVER w AS nx FROM du WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
c0 AS (SELECT doc_id, CAST(no AS BIGINT) AS claim_id, text AS line, no, halves, nt, nh, nx, no % 10 AS r, length(text) AS n FROM dn WHERE no % 7 <> 0 AND NOT regexp_matches(text, '^\s*$')),
c1 AS (SELECT doc_id, claim_id,
    CASE WHEN r = 0 THEN 'Zq' || no || ' xw unfounded vk statement' WHEN r = 1 THEN line[1:3] WHEN r = 2 THEN line[1:4] WHEN r = 3 AND nt IS NOT NULL THEN line || ' ' || nt
      WHEN r = 5 AND (n >= 20 OR n <= 11) THEN line[1 : n // 2] || '§' || line[n // 2 + 2 :] WHEN halves IS NOT NULL THEN halves ELSE line END AS text,
    CASE WHEN r = 3 AND nt IS NOT NULL THEN [no, no + 1] WHEN r = 4 AND nt IS NOT NULL THEN [no + 1, no] WHEN r = 6 THEN [no, 100000] WHEN r = 8 THEN CAST([] AS INT[]) ELSE [no] END AS cited,
    CASE WHEN r = 3 AND nt IS NOT NULL THEN line || ' ' || nt WHEN r = 4 AND nt IS NOT NULL THEN nt || ' ' || line WHEN r = 8 THEN NULL ELSE line END AS joined,
    CASE WHEN r = 3 AND nt IS NOT NULL AND coalesce(halves, nx) IS NOT NULL THEN coalesce(halves, line) || ' ' || nh WHEN r = 4 AND nt IS NOT NULL AND coalesce(halves, nx) IS NOT NULL THEN nh || ' ' || coalesce(halves, line) WHEN r NOT IN (3, 4, 8) OR (r IN (3, 4) AND nt IS NULL) THEN halves END AS apart,
    CASE WHEN r = 6 THEN 1 ELSE 0 END AS missing FROM c0),
c2 AS (SELECT doc_id, CAST(0 AS BIGINT) AS claim_id, 'Out of range' AS text, [100000] AS cited, '' AS joined, CAST(NULL AS VARCHAR) AS apart, 1 AS missing FROM documents WHERE doc_id % 10 = 0),
claims AS (SELECT *, len(cited) AS n_cited FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2)),
""" + _judged("claims", "doc_id, claim_id, cited") + """,
judged AS (SELECT * FROM jd),
fl AS (SELECT doc_id, unnest(CASE WHEN len(cited) = 0 THEN [0] ELSE cited END) AS no, CASE WHEN missing > 0 THEN 'source_line_out_of_range' ELSE 'hallucinated_span' END AS reason FROM judged WHERE NOT ok)
"""


def claimed_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents; every ninth counts as joined of two halves."""
    half = F.floor(F.length("text") / 2).cast("int")
    halves = F.array(F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit("-")), F.substring(F.col("text"), half + 1, F.length("text")))
    return document_lines(spark, sf_dir).withColumn("unjoined", F.when(F.col("no") % 9 == 0, halves).otherwise(F.array().cast("array<string>")))


def document_claims(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, no, text = F.col("no") % 10, F.length("text"), F.col("no"), F.col("text")
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("no"))
    rows = lines.withColumn("nt", after).where((no % 7 != 0) & ~T.is_blank(text))
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substring(text, F.lit(1), half), F.lit("§"), F.substring(text, half + 2, n))
    two = F.col("nt").isNotNull()
    said = (
        F.when(r == 0, F.concat(F.lit("Zq"), no.cast("string"), F.lit(" xw unfounded vk statement")))
        .when(r == 1, F.substring("text", 1, 3))
        .when(r == 2, F.substring("text", 1, 4))
        .when((r == 3) & two, F.concat_ws(" ", "text", "nt"))
        .when((r == 5) & ((n >= 20) | (n <= 11)), changed)
        .when(F.size("unjoined") > 0, F.array_join("unjoined", " "))
        .otherwise(text)
    )
    cited = F.when((r == 3) & two, F.array(no, no + 1)).when((r == 4) & two, F.array(no + 1, no)).when(r == 6, F.array(no, F.lit(100000))).when(r == 8, F.array().cast("array<int>")).otherwise(F.array(no))
    own = rows.select("doc_id", no.cast("long").alias("claim_id"), said.alias("text"), cited.alias("source_lines"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 = 0")
    return own.unionByName(docs.select("doc_id", F.lit(0).cast("long").alias("claim_id"), F.lit("Out of range").alias("text"), F.array(F.lit(100000)).alias("source_lines")))


def judged_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = claimed_document_lines(spark, sf_dir)
    return lines, V.verify(document_claims(lines, spark, sf_dir), lines, verdicts_only=True)


@query(f"""WITH RECURSIVE {_CLAIMS} SELECT doc_id, claim_id, ok AS verified, CASE WHEN ok THEN 'ok' ELSE 'hallucinated' END AS flag,
 CASE WHEN ok THEN NULL WHEN missing > 0 THEN 'source_line_out_of_range' ELSE 'hallucinated_span' END AS reason FROM judged""")
def verify_claims(spark, sf_dir):
    return judged_claims(spark, sf_dir)[1].select("doc_id", "claim_id", "verified", "flag", "reason")


#: A plain field of each document: its first line, made up, or two words of it; its object cites up to three lines.
_FIELDS = r"""
f0 AS (SELECT doc_id, no, text FROM dl WHERE no <= 3),
f1 AS (SELECT doc_id, list(no ORDER BY no) AS cited, string_agg(text, ' ' ORDER BY no) AS joined, any_value(text) FILTER (WHERE no = 1) AS line FROM f0 GROUP BY 1),
f2 AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN line WHEN 1 THEN 'Qx' || doc_id || ' Holdings' ELSE split_part(line, ' ', 1) || ' ' || split_part(line, ' ', 2) END AS text FROM f1),
f3 AS (SELECT doc_id, 0 AS no, text, joined, cited FROM f2 WHERE length(trim(text)) >= 4 UNION ALL SELECT f2.doc_id, f0.no, f2.text, f0.text, cited FROM f2 JOIN f0 USING (doc_id) WHERE length(trim(f2.text)) >= 4),
f4 AS (SELECT *, CAST(NULL AS VARCHAR) AS apart, 0 AS missing, 1 AS n_cited FROM f3),
""" + _judged("f4", "doc_id, no").replace("\nkd AS", "\nfkd AS").replace(" FROM kd)", " FROM fkd)")
for _name in ("ex", "sh", "lc", "ls", "pc", "pp", "po", "jd"):
    _FIELDS = re.sub(rf"\b{_name}\b(?=[ .)\n])", f"f{_name}", _FIELDS)


def document_fields(lines: DataFrame) -> DataFrame:
    k, words = F.col("doc_id") % 4, F.split("text", " ")
    two = F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(" "), F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    value = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("Qx"), F.col("doc_id").cast("string"), F.lit(" Holdings"))).otherwise(two)
    cited = F.array_sort(F.collect_set("no")).alias("source_lines")
    fields = lines.where("no <= 3").withColumn("value", F.when(F.col("no") == 1, value)).groupBy("doc_id").agg(F.max("value").alias("value"), cited)
    return fields.select("doc_id", F.lit("experience.0").alias("object_path"), F.lit("company").alias("field"), "value", "source_lines")


@query(f"WITH RECURSIVE {DL}, {_FIELDS} SELECT doc_id, 1 AS no, 'unsourced_company' AS reason FROM fjd WHERE no = 0 AND NOT ok")
def bare_field_flags(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    return V.bare_fields(document_fields(lines), lines)[0]


@query(f"WITH RECURSIVE {DL}, {_FIELDS} SELECT doc_id, no FROM fjd WHERE no > 0 AND ok")
def bare_field_lines(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    return V.bare_fields(document_fields(lines), lines)[1]


_STATES = _CLAIMS + "," + _FIELDS + """,
af AS (SELECT * FROM fl UNION ALL SELECT doc_id, 1 AS no, 'unsourced_company' AS reason FROM fjd WHERE no = 0 AND NOT ok),
ci AS (SELECT doc_id, unnest(cited) AS no, ok FROM judged UNION ALL SELECT doc_id, no, true AS ok FROM fjd WHERE no > 0 AND ok),
cl AS (SELECT doc_id, no, bool_or(ok) AS represented FROM ci GROUP BY 1, 2),
st AS (SELECT l.doc_id, l.no, NOT regexp_matches(l.text, '^\\s*$') AS live, cl.no IS NOT NULL AS claimed, coalesce(cl.represented, false) AS represented FROM dl l LEFT JOIN cl ON cl.doc_id = l.doc_id AND cl.no = l.no),
ag AS (SELECT doc_id, string_agg(no || ':' || reason, ',' ORDER BY no, reason) AS flagged FROM (SELECT DISTINCT doc_id, no, reason FROM af) GROUP BY 1),
rp AS (SELECT doc_id, count(*) AS total_lines, count(*) FILTER (WHERE live) AS non_blank_lines, count(*) FILTER (WHERE live AND claimed) AS claimed_lines,
       count(*) FILTER (WHERE live AND represented) AS represented_lines,
       coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (WHERE live AND NOT claimed), '') AS unassigned,
       coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (WHERE live AND claimed AND NOT represented), '') AS claimed_not_represented FROM st GROUP BY doc_id),
rq AS (SELECT rp.*, coalesce(flagged, '') AS flagged, CAST(CASE WHEN non_blank_lines > 0 THEN round_even(100.0 * claimed_lines / non_blank_lines, 2) ELSE 100 END AS DOUBLE) AS coverage_pct,
       CAST(CASE WHEN non_blank_lines > 0 THEN round_even(100.0 * represented_lines / non_blank_lines, 2) ELSE 100 END AS DOUBLE) AS represented_pct FROM rp LEFT JOIN ag ON ag.doc_id = rp.doc_id)
"""


def document_accounts(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """All lines with what claims and plain fields together say of them; lines are split once, and each verdict is worked out once."""
    lines = settled(claimed_document_lines(spark, sf_dir)) if lines is None else lines
    judged = V.judge(document_claims(lines, spark, sf_dir), document_fields(lines), lines)
    return C.accounts(lines, V.marks(judged))


def document_report(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    return C.account_report(document_accounts(spark, sf_dir, lines))


def _listed(name: str):
    return F.array_join(F.transform(name, lambda n: n.cast("string")), ",").alias(name)


@query(f"WITH RECURSIVE {_STATES} SELECT * FROM rq")
def coverage_report(spark, sf_dir):
    report = document_report(spark, sf_dir)
    return report.select("doc_id", "total_lines", "non_blank_lines", "claimed_lines", "represented_lines", _listed("unassigned"), _listed("claimed_not_represented"), F.array_join(F.transform("flagged", lambda f: F.concat_ws(":", f["no"].cast("string"), f["reason"])), ",").alias("flagged"), "coverage_pct", "represented_pct")


@query(f"""WITH RECURSIVE {_STATES} SELECT count(*) AS n_docs, CAST(round_even(avg(coverage_pct), 4) AS DOUBLE) AS mean_coverage, min(coverage_pct) AS min_coverage,
 CAST(round_even(avg(represented_pct), 4) AS DOUBLE) AS mean_represented, min(represented_pct) AS min_represented, CAST(round_even(avg(coverage_pct - represented_pct), 4) AS DOUBLE) AS mean_gap FROM rq""")
def corpus_summary(spark, sf_dir):
    return C.summary(document_report(spark, sf_dir))


@query(f"WITH RECURSIVE {_STATES} SELECT doc_id, represented_pct FROM rq ORDER BY represented_pct, doc_id LIMIT 5")
def worst_documents(spark, sf_dir):
    return document_report(spark, sf_dir).select("doc_id", "represented_pct").orderBy("represented_pct", "doc_id").limit(5)


@query(f"""WITH RECURSIVE {_CLAIMS} SELECT doc_id, no, reason, count(*) AS n FROM fl GROUP BY 1, 2, 3""")
def claim_flags(spark, sf_dir):
    return V.flags(judged_claims(spark, sf_dir)[1]).groupBy("doc_id", "no", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_STATES}, fn AS (SELECT DISTINCT doc_id, no FROM af)
SELECT st.doc_id, st.no, CASE WHEN fn.no IS NOT NULL THEN 'flag' WHEN live AND NOT claimed THEN 'unassigned' ELSE 'claimed' END AS state
FROM st LEFT JOIN fn ON fn.doc_id = st.doc_id AND fn.no = st.no""")
def gutter(spark, sf_dir):
    return C.account_gutter(document_accounts(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLAIMS} SELECT doc_id, no, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY claim_id) AS claim_ids FROM (SELECT doc_id, claim_id, unnest(cited) AS no FROM claims) GROUP BY 1, 2")
def reverse_index(spark, sf_dir):
    lines = claimed_document_lines(spark, sf_dir)
    rows = C.reverse_index(document_claims(lines, spark, sf_dir))
    return rows.select("doc_id", "no", _listed("claim_ids"))


@query(f"WITH RECURSIVE {_STATES} SELECT st.doc_id, st.no, dl.text, CASE WHEN claimed THEN 'claimed_not_represented' ELSE 'unassigned' END AS kind FROM st JOIN dl ON dl.doc_id = st.doc_id AND dl.no = st.no WHERE live AND NOT represented")
def proof_context(spark, sf_dir):
    return document_accounts(spark, sf_dir).where(F.col("non_blank") & ~F.col("represented")).select("doc_id", "no", "text", F.when(F.col("claimed"), "claimed_not_represented").otherwise("unassigned").alias("kind"))


@query(f"""WITH RECURSIVE {_STATES} SELECT d.doc_id, r.coverage_pct, r.represented_pct, CASE WHEN r.doc_id IS NULL THEN 'empty_document' END AS failure
FROM documents d LEFT JOIN rq r ON r.doc_id = d.doc_id""")
def coverage_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("input_ord"))
    report = document_report(spark, sf_dir).select("doc_id", "coverage_pct", "represented_pct")
    failed = docs.join(report, "doc_id", "left_anti").select("doc_id", F.lit("empty_document").alias("failure"))
    return views.batch_table(docs, report, failed, "doc_id").select("doc_id", "coverage_pct", "represented_pct", "failure")


_ITEM = r"regexp_matches(d.text, '(^|[^\pL\pM\pN_])' || regexp_escape(b.text) || '($|[^\pL\pM\pN_])')"


def benchmark_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, text, item) that share the first words of the item. Text
    that holds an item between word boundaries holds its words, so none is missed;
    an equi-join on three words, or on all words of an item of one or two. Only
    items without words, if there are any, meet all documents."""
    word = r"(?U)\w+"
    items = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.col("text").alias("item"), F.regexp_extract_all("text", F.lit(word), 0).alias("w"))
    sizes = sorted(r[0] for r in items.select(F.least(F.size("w"), F.lit(3))).distinct().collect())
    items = items.withColumn("gram", F.xxhash64(F.array_join(F.slice("w", 1, 3), " "))).withColumn("bare", F.size("w") == 0).drop("w")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = F.regexp_extract_all("text", F.lit(word), 0)
    grams = docs.select("doc_id", w.alias("w"))
    # neighbours by arrays_zip: one pass over the words, no index lookups
    runs = []
    for n in (n for n in sizes if n):
        zipped = F.arrays_zip(*(F.slice("w", i + 1, F.greatest(F.size("w") - n + 1, F.lit(0))).alias("abc"[i]) for i in range(n)))
        runs.append(F.transform(zipped, lambda z: F.xxhash64(F.concat_ws(" ", *(z[c] for c in "abc"[:n])))))  # noqa: B023
    grams = grams.select("doc_id", F.explode(F.array_distinct(F.concat(*runs) if runs else F.array().cast("array<bigint>"))).alias("gram"))
    hits = grams.join(items.where("not bare"), "gram").select("doc_id", "item_id", "item").distinct()
    found = hits.join(docs, "doc_id")
    if 0 in sizes:
        found = found.unionByName(docs.crossJoin(items.where("bare").select("item_id", "item")).select(found.columns))
    return found


@query(f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE {_ITEM}")
def span_exact_containment(spark, sf_dir):
    return benchmark_candidates(spark, sf_dir).where(T.contains_word(F.col("text"), F.col("item"))).select("doc_id", "item_id")


@query()
def span_fuzzy(spark, sf_dir):
    """Benchmark items against the single lines of all documents."""
    return spans.fuzzy_spans(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'invalid' WHEN event_id % 5 = 0 THEN 'k_missing' ELSE 'ok' END AS verdict,
 CASE WHEN event_id % 9 = 0 OR event_id % 5 = 0 THEN NULL ELSE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) END AS k FROM events""")
def json_validate(spark, sf_dir):
    """Every ninth payload is cut short, every fifth other lacks its key."""
    n = F.col("event_id")
    raw = F.when(n % 9 == 0, F.substring("props", 1, 3)).when(n % 5 == 0, F.replace("props", F.lit('"k"'), F.lit('"j"'))).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("v", F.try_parse_json("raw"))
    k = F.try_variant_get("v", "$.k", "int")
    return rows.select("event_id", F.when(F.col("v").isNull(), "invalid").when(k.isNull(), "k_missing").otherwise("ok").alias("verdict"), k.alias("k"))


class _Scripted:
    """Fails as often as the document's number says, then answers."""

    def __init__(self, number: int):
        self.left, self.number = number % 5, number

    def propose(self, messages: list[str]) -> tuple[str, bool]:
        if self.number % 11 == 0:
            return '{"spans": [', True
        if self.left:
            self.left -= 1
            return ("" if self.left % 2 else "nonsense"), False
        return f"```json\n{json.dumps(_answer(self.number))}\n```", False


def _answer(number: int) -> dict:
    """A tree of claims: of the role below the first, every other one is at another company."""
    span = lambda text, *no: {"text": text, "source_lines": list(no)}
    role = lambda company, bullet, *below: {"company": company, "title": "T", "start": {"raw": ""}, "end": {"raw": ""}, "bullets": [span(bullet, 1)], "sub_roles": list(below), "source_lines": [1, 2]}
    return {
        "contact": {"name": span(f"N{number}", 1), "links": [span(f"github.com/u{number}", 1), span("my portfolio", 1)], "source_lines": [1]},
        "experience": [role("Acme", "b", role("ACME " if number % 2 else "Other", "c", role("Third", "d")))],
        "skills": [{"name": "Python", "category": "language", "source": "skills_section", "evidence": span("e", 1, 2), "source_lines": [2]}],
        "other_sections": [{"heading": "H", "lines": [span("o", 3)], "source_lines": [3]}],
    }


@query(f"""WITH {DL} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'response_truncated' WHEN doc_id % 5 <= 2 THEN 'ok' ELSE 'validation_failed' END AS status,
 CASE WHEN doc_id % 11 = 0 THEN 1 WHEN doc_id % 5 <= 2 THEN CAST(doc_id % 5 + 1 AS INT) ELSE 3 END AS attempts FROM (SELECT DISTINCT doc_id FROM dl)""")
def structuring_retry(spark, sf_dir):
    asked = K.prompts(document_lines(spark, sf_dir), ahead="")
    return K.structured(asked, _Scripted).select("doc_id", "status", "attempts")


_ANSWERED = f"""{DL}, an AS (SELECT doc_id, doc_id % 2 = 1 AS same FROM (SELECT DISTINCT doc_id FROM dl) WHERE doc_id % 11 <> 0 AND doc_id % 5 <= 2)"""


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.taken_apart(K.structured(K.prompts(document_lines(spark, sf_dir), ahead=""), _Scripted).where("status = 'ok'"))


def _cited():
    return F.array_join(F.transform("source_lines", lambda n: n.cast("string")), ",").alias("cited")


@query(f"""WITH {_ANSWERED}, sp AS (SELECT doc_id, unnest([
  {{'path': 'contact.name', 'text': 'N' || doc_id, 'cited': '1'}}, {{'path': 'contact.links.0', 'text': 'github.com/u' || doc_id, 'cited': '1'}}, {{'path': 'contact.links.1', 'text': 'my portfolio', 'cited': '1'}},
  {{'path': 'experience.0.bullets.0', 'text': 'b', 'cited': '1'}}, {{'path': CASE WHEN same THEN 'experience.0.sub_roles.0.bullets.0' ELSE 'experience.1.bullets.0' END, 'text': 'c', 'cited': '1'}},
  {{'path': CASE WHEN same THEN 'experience.1.bullets.0' ELSE 'experience.2.bullets.0' END, 'text': 'd', 'cited': '1'}},
  {{'path': 'skills.0.evidence', 'text': 'e', 'cited': '1,2'}}, {{'path': 'other_sections.0.lines.0', 'text': 'o', 'cited': '3'}}]) AS s FROM an)
SELECT doc_id, s.path AS path, s.text AS text, s.cited AS cited FROM sp""")
def structured_spans(spark, sf_dir):
    return tree.claims(answered(spark, sf_dir)).select("doc_id", "path", "text", _cited())


@query(f"""WITH {_ANSWERED}, sp AS (SELECT doc_id, unnest([
  {{'path': 'experience.0', 'field': 'company', 'v': 'Acme', 'cited': '1,2'}}, {{'path': 'experience.0', 'field': 'title', 'v': 'T', 'cited': '1,2'}},
  {{'path': CASE WHEN same THEN 'experience.0.sub_roles.0' ELSE 'experience.1' END, 'field': 'company', 'v': CASE WHEN same THEN 'ACME ' ELSE 'Other' END, 'cited': '1,2'}}, {{'path': CASE WHEN same THEN 'experience.0.sub_roles.0' ELSE 'experience.1' END, 'field': 'title', 'v': 'T', 'cited': '1,2'}},
  {{'path': CASE WHEN same THEN 'experience.1' ELSE 'experience.2' END, 'field': 'company', 'v': 'Third', 'cited': '1,2'}}, {{'path': CASE WHEN same THEN 'experience.1' ELSE 'experience.2' END, 'field': 'title', 'v': 'T', 'cited': '1,2'}},
  {{'path': 'skills.0', 'field': 'name', 'v': 'Python', 'cited': '2'}}]) AS s FROM an)
SELECT doc_id, s.path AS object_path, s.field AS field, s.v AS value, s.cited AS cited FROM sp""")
def structured_fields(spark, sf_dir):
    return tree.fields(answered(spark, sf_dir)).select("doc_id", "object_path", "field", "value", _cited())


@query(f"""WITH {_ANSWERED} SELECT doc_id, path, label FROM an, (VALUES ('contact.links.0', 'GitHub'), ('contact.links.1', 'Portfolio')) v(path, label)""")
def structured_links(spark, sf_dir):
    """Both links name their service themselves."""
    parts = settled(answered(spark, sf_dir))
    return tree.labelled(tree.claims(parts), document_lines(spark, sf_dir)).select("doc_id", "path", "label")


def _hostile(number: int) -> str:
    """Answers that some readers break on."""
    claim = lambda text, *no: json.dumps({"contact": {"name": {"text": text, "source_lines": list(no)}}})
    role: dict = {}
    for _ in range(50):
        role = {"company": "A", "title": "T", "start": {"raw": ""}, "end": {"raw": ""}, "bullets": [{"text": "b", "source_lines": [1]}], "sub_roles": [role] if role else [], "source_lines": [1]}
    return [
        claim("plain", 1), "[" * 20_000, claim("far", 10**12), claim("half \ud800 pair", 1), '{"contact": {}, "more": NaN}', json.dumps({"contact": {}, "experience": [role]}),
        '{"contact": {"source_lines": [' + "9" * 5_000 + "]}}", claim("below", -(10**30), 1), '{"contact": {}, "more": 1e999}', '{"a":' * 5_000 + "1" + "}" * 5_000,
    ][number % 10]


class _Hostile:
    def __init__(self, number: int):
        self.number = number

    def propose(self, messages: list[str]) -> tuple[str, bool]:
        return _hostile(self.number), False


@query(f"""WITH {DL}, n AS (SELECT doc_id, max(no) AS lines, doc_id % 10 AS r FROM dl GROUP BY 1)
SELECT doc_id, CASE WHEN r IN (1, 4, 6, 8, 9) THEN 'validation_failed' ELSE 'ok' END AS status, CASE WHEN r IN (1, 4, 6, 8, 9) THEN 3 ELSE 1 END AS attempts,
 CASE WHEN r IN (1, 4, 6, 8, 9) THEN 0 WHEN r = 5 THEN 50 ELSE 1 END AS n_spans, CASE WHEN r IN (2, 7) THEN 1 ELSE 0 END AS n_flagged, CASE WHEN r = 3 THEN 1 ELSE 0 END AS n_replaced
FROM n WHERE lines >= 1""")
def hostile_answers(spark, sf_dir):
    """Answers of any content: each is judged by itself, the documents beside it stay."""
    lines = settled(document_lines(spark, sf_dir))
    got = settled(K.structured(K.prompts(lines, ahead=""), _Hostile))
    spans = settled(tree.claims(tree.taken_apart(got.where("status = 'ok'"))))
    missing = spans.select("doc_id", "claim_id", F.explode("source_lines").alias("no")).join(lines, ["doc_id", "no"], "left_anti").select("doc_id", "claim_id").distinct().withColumn("beyond", F.lit(1))
    counts = spans.join(missing, ["doc_id", "claim_id"], "left").groupBy("doc_id").agg(
        F.count("*").alias("n_spans"), F.count("beyond").alias("n_flagged"), F.count_if(F.contains("text", F.lit("\ufffd"))).alias("n_replaced")
    )
    return got.select("doc_id", "status", "attempts").join(counts, "doc_id", "left").na.fill(0, ["n_spans", "n_flagged", "n_replaced"])


#: Payloads that are sound or not, by the rest of a key, and what is wrong with each.
_PAYLOADS = (
    (_answer(1), ""), ({}, "contact: missing"), ([], "an object is needed"), ({"contact": {"emails": "x"}}, "contact.emails: a list is needed"),
    ({"contact": {}, "summary": {"text": "t", "source_lines": ["1"]}}, "summary.source_lines: a list of numbers is needed"),
    ({"contact": {}, "experience": [{**_answer(1)["experience"][0], "sub_roles": [{"company": "A"}]}]}, "experience.0.sub_roles.0.title: missing"),
    ({"contact": {}, "other_sections": [{"heading": 3, "source_lines": []}]}, "other_sections.0.heading: text is needed"),
    ({"contact": {"name_confidence": "sure"}}, "contact.name_confidence: not one of high, low"), ({"contact": {}, "more": 1, "experience": []}, ""),
)


@query(f"""SELECT c_custkey, CASE c_custkey % {len(_PAYLOADS)} {" ".join(f"WHEN {k} THEN '{why}'" for k, (_, why) in enumerate(_PAYLOADS))} END AS problem FROM customer""")
def payload_problems(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(json.dumps(p)) for p, _ in _PAYLOADS)), (F.col("c_custkey") % len(_PAYLOADS) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", tree.problem_in(raw).alias("problem"))


@query(f"""WITH RECURSIVE {_STATES}, p AS (SELECT doc_id, CASE WHEN claim_id % 3 = 0 THEN 'other_sections.' || claim_id ELSE 'experience.' || claim_id % 2 || '.' || claim_id END AS path FROM claims),
q AS (SELECT doc_id, count(DISTINCT CASE WHEN path LIKE 'experience.%' THEN split_part(path, '.', 2) END) AS roles, bool_or(path LIKE 'other_sections.%') AS other FROM p GROUP BY 1)
SELECT q.doc_id FROM q JOIN rq ON rq.doc_id = q.doc_id WHERE rq.coverage_pct = 100 AND (roles >= 2 OR other)""")
def usable_parses(spark, sf_dir):
    n = F.col("claim_id").cast("string")
    path = F.when(F.col("claim_id") % 3 == 0, F.concat(F.lit("other_sections."), n)).otherwise(F.concat(F.lit("experience."), (F.col("claim_id") % 2).cast("string"), F.lit("."), n))
    lines = settled(claimed_document_lines(spark, sf_dir))
    return K.usable(document_claims(lines, spark, sf_dir).withColumn("path", path), document_report(spark, sf_dir, lines))


@query(f"""WITH RECURSIVE {_STATES} SELECT doc_id, coverage_pct, CAST(CASE WHEN non_blank_lines > 0 THEN 0 ELSE 100 END AS DOUBLE) AS represented_pct FROM (
 SELECT doc_id, count(*) FILTER (WHERE live) AS non_blank_lines, CAST(CASE WHEN count(*) FILTER (WHERE live) > 0 THEN round_even(100.0 * count(*) FILTER (WHERE live AND j.no IS NOT NULL) / count(*) FILTER (WHERE live), 2) ELSE 100 END AS DOUBLE) AS coverage_pct
 FROM st LEFT JOIN (SELECT DISTINCT doc_id, unnest(cited) AS no FROM judged) j USING (doc_id, no) GROUP BY 1)""")
def spans_deleted(spark, sf_dir):
    """All claims lose their text: coverage stays, nothing is represented."""
    lines = claimed_document_lines(spark, sf_dir)
    emptied = K.without_spans(document_claims(lines, spark, sf_dir).withColumn("path", F.lit("x")))
    judged = V.verify(emptied, lines)
    return C.report(C.line_states(lines, C.claimed_lines(judged), C.represented_lines(judged))).select("doc_id", "coverage_pct", "represented_pct")
