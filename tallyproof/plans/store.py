"""Queries on roles, edits, answers, views and jobs. Orders stand for parsed
documents, customers for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyproof.functions.values import stamp
from tallyproof.operators import jobs as J, overrides as O, roles as R, survey, views
from tallyproof.plans.base import query, table

_ROLES = """
roles AS (SELECT p_partkey AS role_id, CASE WHEN p_partkey < 16 THEN NULL ELSE p_partkey // 4 END AS parent_id, CAST(CASE WHEN p_partkey < 16 THEN p_partkey ELSE p_partkey % 4 END AS INT) AS ord, p_brand AS company, p_name AS title FROM part),
walk AS (SELECT role_id, parent_id, company, title, 0 AS depth, lpad(CAST(ord AS VARCHAR), 6, '0') AS path, CAST(ord AS VARCHAR) AS places, true AS foreigner FROM roles WHERE parent_id IS NULL
  UNION ALL SELECT r.role_id, r.parent_id, r.company, r.title, w.depth + 1, w.path || '.' || lpad(CAST(r.ord AS VARCHAR), 6, '0'), w.places || '.sub_roles.' || r.ord, lower(r.company) <> lower(w.company) FROM roles r JOIN walk w ON r.parent_id = w.role_id)
"""


def part_roles(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.lit(0).alias("doc_id"), k.alias("role_id"), F.when(k >= 16, F.floor(k / 4)).alias("parent_role_id"), F.when(k < 16, k).otherwise(k % 4).cast("int").alias("ord"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"))


@query(f"WITH RECURSIVE {_ROLES} SELECT role_id, CAST(depth AS INT) AS depth, 'experience.' || places AS parse_path, CAST(row_number() OVER (ORDER BY path) AS INT) AS position FROM walk")
def role_flatten(spark, sf_dir):
    return R.flatten(part_roles(spark, sf_dir)).select("role_id", "depth", "parse_path", "position")


@query(f"""WITH RECURSIVE {_ROLES}, n AS (SELECT *, CASE WHEN NOT foreigner THEN parent_id END AS new_parent FROM walk)
SELECT role_id, new_parent, CAST(row_number() OVER (PARTITION BY new_parent ORDER BY path) - 1 AS INT) AS new_ord FROM n""")
def role_promotion(spark, sf_dir):
    return R.promote(part_roles(spark, sf_dir)).select("role_id", F.col("new_parent"), "new_ord")


_EDITS = """
vals AS (SELECT o_orderkey AS sha, 'personal.name' AS path, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'experience.0.title', o_orderstatus FROM orders),
edits AS (SELECT o_orderkey AS sha, CASE o_orderkey % 3 WHEN 0 THEN 'personal.name' WHEN 1 THEN 'experience.0.title' ELSE 'summary.text' END AS path, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'edited ' || o_orderkey END AS value FROM orders WHERE o_orderkey % 2 = 0)
"""


def parsed_values(spark, sf_dir):
    """(sha, path, value): two fields of each parse."""
    fields = F.create_map(F.lit("personal.name"), "o_orderpriority", F.lit("experience.0.title"), "o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.explode(fields).alias("path", "value"))


def stored_edits(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, "personal.name").when(k % 3 == 1, "experience.0.title").otherwise("summary.text")
    return table(spark, sf_dir, "orders").where(k % 2 == 0).select(k.alias("sha"), path.alias("path"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("edited "), k.cast("string"))).alias("value"))


@query(f"WITH {_EDITS} SELECT v.sha, v.path, CASE WHEN e.sha IS NOT NULL THEN e.value ELSE v.value END AS value, e.sha IS NOT NULL AS edited FROM vals v LEFT JOIN edits e ON e.sha = v.sha AND e.path = v.path")
def override_patch(spark, sf_dir):
    return O.patch(parsed_values(spark, sf_dir), stored_edits(spark, sf_dir), ["sha", "path"])


@query(f"WITH {_EDITS} SELECT e.sha, e.path FROM edits e WHERE EXISTS (SELECT 1 FROM vals v WHERE v.sha = e.sha AND v.path = e.path)")
def edit_allow_list(spark, sf_dir):
    return O.allowed_edits(stored_edits(spark, sf_dir), parsed_values(spark, sf_dir), ["sha", "path"]).select("sha", "path")


@query(f"""WITH {_EDITS}, nxt AS (SELECT sha - 1 AS sha, path, value FROM vals WHERE sha > 0)
SELECT e.sha + 1 AS sha, e.path, e.value FROM edits e JOIN nxt n ON n.sha = e.sha AND n.path = e.path LEFT JOIN vals v ON v.sha = e.sha AND v.path = e.path WHERE v.value IS NOT DISTINCT FROM n.value""")
def carry_forward(spark, sf_dir):
    """Each parse is followed by the one with the next number."""
    parsed = parsed_values(spark, sf_dir)
    following = parsed.where("sha > 0").withColumn("sha", F.col("sha") - 1)
    kept = O.carry(stored_edits(spark, sf_dir), following, parsed, following, ["sha", "path"])
    return kept.select((F.col("sha") + 1).alias("sha"), "path", "value")


@query("""SELECT o.o_orderkey AS sha FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey * 3 = o.o_orderkey)
 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1)""")
def orphaned_parses(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"))
    active = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("sha"))
    edited = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("sha"))
    return O.orphans(stored, active, edited)


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nr FROM s) SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM n WHERE nr = 1""")
def newest_parse(spark, sf_dir):
    parses = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("sha"), "o_orderdate")
    there = O.servable(parses, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha")))
    return O.latest(there, ["o_custkey"], ["o_orderdate", "sha"]).select("o_custkey", F.col("sha").alias("o_orderkey"), stamp(F.col("o_orderdate")).alias("stamp"))


@query("""WITH n AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nr FROM events) SELECT user_id, event_type, event_id, value FROM n WHERE nr = 1""")
def last_writer_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "event_id", "value")
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return O.upsert(old, new, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id", "value")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY lower(c_mktsegment || c_nationkey), c_custkey) AS INT) AS position FROM customer")
def people_order(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))).alias("name"))
    return O.positions(people, ["name", "c_custkey"]).select("c_custkey", "position")


@query("""WITH r AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 2 END AS asked, CASE WHEN o_orderkey % 3 = 1 THEN o_custkey * 2 END AS active FROM orders)
SELECT request_id, CASE WHEN asked IS NOT NULL THEN a.c_custkey ELSE b.c_custkey END AS person_id, CASE WHEN asked IS NOT NULL AND a.c_custkey IS NULL THEN 'unknown_person' WHEN coalesce(a.c_custkey, b.c_custkey) IS NULL THEN 'no_person' END AS error
FROM r LEFT JOIN customer a ON a.c_custkey = r.asked LEFT JOIN customer b ON b.c_custkey = r.active""")
def person_ladder(spark, sf_dir):
    k, twice = F.col("o_orderkey"), F.col("o_custkey") * 2
    asked = table(spark, sf_dir, "orders").select(k.alias("request_id"), F.when(k % 3 == 0, twice).alias("asked"), F.when(k % 3 == 1, twice).alias("active"))
    return O.resolve_person(asked, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id")))


@query("""SELECT c_custkey AS person_id, CASE WHEN c_custkey % 4 IN (0, 1) THEN c_name ELSE '' END AS display_name, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS active_sha, CASE WHEN c_custkey % 4 IN (0, 2) THEN 1 ELSE 0 END AS n_answers FROM customer""")
def profile_load(spark, sf_dir):
    """Whole profiles, profiles without answers, old files of answers alone, and broken ones."""
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    whole = F.format_string('{"version": 1, "display_name": "%s", "active_sha": "%d", "eeo": {"answers": {"gender": ["Male"]}}}', name, "c_nationkey")
    content = F.when(k == 0, whole).when(k == 1, F.format_string('{"version": 1, "display_name": "%s"}', name)).when(k == 2, '{"answers": {"gender": ["Male"]}}').otherwise('{"display_name": "x')
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), content.alias("content"))
    return O.profile_rows(rows).drop("answered")


_ANSWERS = """
a AS (SELECT event_id % 5000 AS person_id, CASE event_type WHEN 'error' THEN 'nonsense' WHEN 'click' THEN 'gender' WHEN 'view' THEN 'sexual_orientation' ELSE 'veteran' END AS question,
  CASE WHEN event_id % 13 = 0 THEN 'Perhaps' WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'Gay' ELSE 'Queer' END WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'Male' ELSE 'Prefer not to say' END ELSE 'Yes' END AS option FROM events)
"""


def survey_answers(spark, sf_dir):
    kind, n = F.col("event_type"), F.col("event_id")
    question = F.when(kind == "error", "nonsense").when(kind == "click", "gender").when(kind == "view", "sexual_orientation").otherwise("veteran")
    option = F.when(n % 13 == 0, "Perhaps").when(kind == "view", F.when(n % 2 == 0, "Gay").otherwise("Queer")).when(kind == "click", F.when(n % 2 == 0, "Male").otherwise("Prefer not to say")).otherwise("Yes")
    return table(spark, sf_dir, "events").select((n % 5000).alias("person_id"), question.alias("question"), option.alias("option"))


@query(f"""WITH {_ANSWERS}, g AS (SELECT person_id, question, count(*) AS n FROM a GROUP BY 1, 2)
SELECT person_id, question, CASE WHEN question = 'nonsense' THEN 'unknown_question' ELSE 'several_answers' END AS reason FROM g WHERE question = 'nonsense' OR (n > 1 AND question <> 'sexual_orientation')
UNION ALL SELECT DISTINCT person_id, question, 'unknown_option' FROM a WHERE question <> 'nonsense' AND option = 'Perhaps'""")
def answer_domain(spark, sf_dir):
    return survey.violations(survey_answers(spark, sf_dir), survey.domain(spark))


@query(f"""WITH {_ANSWERS}, s AS (SELECT person_id, bool_and(option = 'Prefer not to say') AS declined FROM a GROUP BY 1)
SELECT c_custkey AS person_id, CASE WHEN declined IS NULL THEN 'never_asked' WHEN declined THEN 'declined' ELSE 'answered' END AS state FROM customer LEFT JOIN s ON s.person_id = c_custkey""")
def survey_states(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"))
    return survey.states(people, survey_answers(spark, sf_dir).where("question <> ''"))


@query("""SELECT l_returnflag, l_linestatus AS category, min(l_orderkey * 10 + l_linenumber) AS first_at, count(*) AS n, md5(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_orderkey * 10 + l_linenumber, l_partkey)) AS values_md5
FROM lineitem GROUP BY 1, 2""")
def first_seen_groups(spark, sf_dir):
    """Small groups per document in use; here two flags make them large."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").alias("name"))
    out = views.first_seen_groups(rows, ["l_returnflag"], "category", "name", "at")
    return out.select("l_returnflag", "category", "first_at", F.size("values").cast("long").alias("n"), F.md5(F.array_join(F.transform("values", lambda v: v.cast("string")), ",")).alias("values_md5"))


@query("""SELECT l_returnflag, l_linestatus AS category, min(l_orderkey * 10 + l_linenumber) OVER g AS first_at,
 CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) AS BIGINT) AS position, l_partkey AS name FROM lineitem WINDOW g AS (PARTITION BY l_returnflag, l_linestatus)""")
def ordered_groups(spark, sf_dir):
    """Groups that hold a good part of the table each, as rows with their places."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").alias("name"))
    return views.ordered_groups(rows, ["l_returnflag"], "category", "name", "at").withColumn("position", F.col("position").cast("long"))


@query("SELECT p_brand, p_type AS category, string_agg(p_name, '|' ORDER BY p_partkey) AS names FROM part GROUP BY 1, 2")
def alphabetical_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("category"), F.col("p_partkey").alias("at"), F.col("p_name").alias("name"))
    out = views.alphabetical_groups(rows, ["p_brand"], "category", "name", "at")
    return out.select("p_brand", "category", F.array_join("values", "|").alias("names"))


@query("""SELECT o_orderkey AS doc_id, 1 AS section_ord, 'Contact' AS section, 0 AS item_ord, 0 AS row_ord, 'Name' AS label, o_orderpriority AS value, '1' AS lines, CASE WHEN o_orderkey % 6 = 0 THEN 'hallucinated' ELSE 'ok' END AS flag FROM orders
UNION ALL SELECT l_orderkey, 2, 'Experience', l_linenumber, CAST(l_partkey AS INT), '', l_returnflag || l_linestatus, CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_linenumber + 1 AS VARCHAR), 'ok' FROM lineitem WHERE l_linestatus <> 'O' OR l_returnflag <> 'N'
""")
def proof_sheet(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_orderkey"))
    items = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    nothing = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
    n = F.col("l_linenumber")
    return views.proof_sheet([
        views.section(orders, 1, "Contact", F.lit(0), F.lit("Name"), F.col("o_orderpriority"), F.array(F.lit(1)), F.when(F.col("o_orderkey") % 6 == 0, "hallucinated").otherwise("ok")),
        views.section(items, 2, "Experience", n, F.lit(""), F.when(nothing, "").otherwise(F.concat("l_returnflag", "l_linestatus")), F.array(n, n + 1), F.lit("ok"), F.col("l_partkey").cast("int")),
    ])


@query(f"""WITH {_EDITS}, p AS (SELECT v.sha, v.path, coalesce(e.value, v.value) AS value, e.sha IS NOT NULL AS edited FROM vals v LEFT JOIN edits e ON e.sha = v.sha AND e.path = v.path)
SELECT sha, max(value) FILTER (WHERE path = 'personal.name') AS name, max(value) FILTER (WHERE path = 'experience.0.title') AS title, count(*) FILTER (WHERE edited) AS n_edited FROM p GROUP BY sha""")
def profile_view(spark, sf_dir):
    rows = O.patch(parsed_values(spark, sf_dir), stored_edits(spark, sf_dir), ["sha", "path"])
    at = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    return rows.groupBy("sha").agg(at("personal.name").alias("name"), at("experience.0.title").alias("title"), F.count(F.when(F.col("edited"), 1)).alias("n_edited"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT coalesce(u.user_id, v.user_id) AS user_id, u.user_id IS NOT NULL AND v.user_id IS NOT NULL AS in_both, v.user_id IS NULL AS only_first FROM u FULL JOIN v ON u.user_id = v.user_id""")
def set_operations(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    a, b = (events.where(F.col("event_type") == t).select("user_id").distinct() for t in ("click", "purchase"))
    both, first = a.intersect(b).withColumn("in_both", F.lit(True)), a.exceptAll(b).withColumn("only_first", F.lit(True))
    rows = a.union(b).distinct().join(both, "user_id", "left").join(first, "user_id", "left")
    return rows.select("user_id", F.coalesce("in_both", F.lit(False)).alias("in_both"), F.coalesce("only_first", F.lit(False)).alias("only_first"))


@query("""WITH a AS (SELECT l_orderkey AS o, CASE WHEN l_linenumber % 5 > 0 THEN CAST(l_quantity AS INT) % 7 END AS i, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
b AS (SELECT l_orderkey AS o, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_quantity AS INT) % 7 END AS i, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
SELECT a.o AS l_orderkey, CAST(sum(a.n) AS BIGINT) AS n_owned, CAST(sum(greatest(a.n - coalesce(b.n, 0), 0)) AS BIGINT) AS n_outside FROM a LEFT JOIN b ON a.o = b.o AND a.i IS NOT DISTINCT FROM b.i GROUP BY 1""")
def subset_test(spark, sf_dir):
    """Items of an order, repeated and null ones among them, against those that it may have."""
    rows, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    item = lambda k: F.when(n % k > 0, F.col("l_quantity").cast("int") % 7).alias("item")
    owned, allowed = rows.where("l_returnflag <> 'N'").select("l_orderkey", item(5)), rows.where(n % 2 == 1).select("l_orderkey", item(3))
    return O.uncontained(owned, allowed, ["l_orderkey"], ["item"])


_JOBS = """
j0 AS (SELECT event_id AS job_id, 'Company ' || user_id AS company, upper(event_type) || ' (m/f) Role-' || (event_id % 3) AS title, CASE WHEN event_id % 4 > 0 THEN value END AS salary, CASE event_id % 4 WHEN 0 THEN 'Remote EU' WHEN 1 THEN 'Hybrid, Berlin' WHEN 2 THEN 'Paris' END AS place FROM events),
j1 AS (SELECT *, trim(lower(company)) || '|' || trim(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)|[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS key, (salary IS NOT NULL)::INT + (place IS NOT NULL)::INT AS full_ FROM j0),
j2 AS (SELECT *, first_value(job_id) OVER (PARTITION BY key ORDER BY full_ DESC, job_id) AS winner FROM j1)
"""


def event_jobs(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        n.alias("job_id"), F.concat(F.lit("Company "), F.col("user_id").cast("string")).alias("company"), F.concat(F.upper("event_type"), F.lit(" (m/f) Role-"), (n % 3).cast("string")).alias("title"),
        F.when(n % 4 > 0, F.col("value")).alias("salary"), F.when(n % 4 == 0, "Remote EU").when(n % 4 == 1, "Hybrid, Berlin").when(n % 4 == 2, "Paris").alias("place"))
    return rows.withColumn("key", J.dedupe_key(F.col("company"), F.col("title")))


@query(f"WITH {_JOBS} SELECT job_id, key, CASE WHEN job_id <> winner THEN winner END AS duplicate_of FROM j2")
def job_duplicates(spark, sf_dir):
    return J.duplicates(event_jobs(spark, sf_dir), ["salary", "place"]).select("job_id", "key", "duplicate_of")


#: Titles of few firms, with words in another order, a plural, or a wrong letter; near ones have a likeness of 92 or more with their words sorted.
_PART_JOBS = """
pj AS (SELECT p_partkey AS job_id, 'Firm ' || p_partkey % 6 AS company, ['Senior', 'Lead', 'Junior', 'Principal'][1 + p_partkey // 6 % 4] AS w, ['platform engineer', 'data analyst', 'harbour pilot'][1 + p_partkey // 24 % 3] AS t, p_partkey // 72 % 4 AS v, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS salary FROM part),
pk AS (SELECT job_id, company, salary, lower(company) || '|' || lower(CASE v WHEN 0 THEN w || ' ' || t WHEN 1 THEN t || ' ' || w WHEN 2 THEN w || ' ' || t || 's' ELSE replace(w || ' ' || t, 'a', 'o') END) AS key FROM pj),
ps AS (SELECT company, key, list_sort(string_split(string_agg(DISTINCT replace(key, '|', ' '), ''), ' ')) AS words FROM pk GROUP BY 1, 2),
pt AS (SELECT company, key, string_split(array_to_string(words, ' '), '') AS c FROM ps),
pp AS (SELECT a.key AS x, b.key AS y, a.c AS a, b.c AS b FROM pt a JOIN pt b ON a.company = b.company AND a.key < b.key),
lc AS (SELECT x, y, a, b, 0 AS i, [0 FOR q IN b] AS r FROM pp
  UNION ALL SELECT x, y, a, b, i + 1, [list_max([greatest(r[h], CASE WHEN a[i + 1] = b[h] THEN 1 + CASE WHEN h > 1 THEN r[h - 1] ELSE 0 END ELSE 0 END) FOR h IN generate_series(1, j)]) FOR j IN generate_series(1, len(b))] FROM lc WHERE i < len(a)),
nk AS (SELECT x, y FROM lc WHERE i = len(a) AND 200.0 * r[len(b)] / (len(a) + len(b)) >= 92),
nb AS (SELECT x, y FROM nk UNION ALL SELECT y, x FROM nk),
rk AS (SELECT key AS x, key AS y FROM pt UNION SELECT rk.x, nb.y FROM rk JOIN nb ON rk.y = nb.x),
ok AS (SELECT x AS key, min(y) AS of FROM rk GROUP BY 1),
nw AS (SELECT job_id, pk.key, first_value(job_id) OVER (PARTITION BY of ORDER BY salary IS NULL, job_id) AS winner FROM pk JOIN ok ON ok.key = pk.key)
"""


@query(f"WITH RECURSIVE {_PART_JOBS} SELECT job_id, key, CASE WHEN job_id <> winner THEN winner END AS duplicate_of FROM nw")
def job_near_duplicates(spark, sf_dir):
    k = F.col("p_partkey")
    word, rest, v = F.element_at(F.array(*map(F.lit, ("Senior", "Lead", "Junior", "Principal"))), (F.floor(k / 6) % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("platform engineer", "data analyst", "harbour pilot"))), (F.floor(k / 24) % 3 + 1).cast("int")), F.floor(k / 72) % 4
    plain = F.concat_ws(" ", word, rest)
    title = F.when(v == 0, plain).when(v == 1, F.concat_ws(" ", rest, word)).when(v == 2, F.concat(plain, F.lit("s"))).otherwise(F.translate(plain, "a", "o"))
    rows = table(spark, sf_dir, "part").select(k.alias("job_id"), F.concat(F.lit("Firm "), (k % 6).cast("string")).alias("company"), title.alias("title"), F.when(k % 5 > 0, F.col("p_retailprice")).alias("salary"))
    rows = rows.withColumn("key", J.dedupe_key(F.col("company"), F.col("title")))
    return J.near_duplicates(rows, ["salary"]).select("job_id", "key", "duplicate_of")


_LEDGER = _JOBS + """,
j3 AS (SELECT *, CASE WHEN job_id <> winner THEN 'filtered_global' WHEN salary < 5 THEN 'filtered_global' WHEN coalesce(lower(place), '') NOT LIKE '%remote%' AND user_ % 2 = 0 THEN 'filtered_person' ELSE 'shown' END AS bucket,
  CASE WHEN job_id <> winner THEN 'duplicate' WHEN salary < 5 THEN 'low salary' WHEN coalesce(lower(place), '') NOT LIKE '%remote%' AND user_ % 2 = 0 THEN 'not remote' END AS rule FROM (SELECT *, job_id % 7 AS user_ FROM j2))
"""


def job_ledger_rows(spark, sf_dir):
    rows = J.duplicates(event_jobs(spark, sf_dir), ["salary", "place"])
    rules = [
        ("filtered_global", "duplicate", F.col("duplicate_of").isNotNull()),
        ("filtered_global", "low salary", F.col("salary") < 5),
        ("filtered_person", "not remote", (J.remote(F.col("place")) != "yes") & (F.col("job_id") % 7 % 2 == 0)),
    ]
    return J.ledger(rows, rules)


@query(f"WITH {_LEDGER} SELECT job_id, bucket, rule FROM j3")
def job_ledger(spark, sf_dir):
    return job_ledger_rows(spark, sf_dir).select("job_id", "bucket", "rule")


@query(f"WITH {_LEDGER} SELECT rule, count(*) AS n FROM j3 WHERE rule IS NOT NULL GROUP BY rule")
def job_rejects(spark, sf_dir):
    return J.rejects(job_ledger_rows(spark, sf_dir))


@query("""WITH s AS (SELECT event_id AS job_id, user_id AS person_id, CAST(floor(value * 7) AS INT) % 101 AS score FROM events)
SELECT job_id, person_id, score, CAST(row_number() OVER (PARTITION BY person_id ORDER BY score DESC, job_id) AS INT) AS position FROM s WHERE score >= 60""")
def job_ranking(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("person_id"), (F.floor(F.col("value") * 7).cast("int") % 101).alias("score"))
    return J.ranked(scores, 60)


@query("""SELECT e.event_id AS job_id, e.user_id AS person_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id = e.event_id AND s.event_id % 3 = 0 AND s.event_id % 2 = 0)""")
def job_unscored(spark, sf_dir):
    """A third of the pairs have a score; half of those are of an older profile."""
    n = F.col("job_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("person_id"), F.lit("new").alias("profile_hash"))
    scores = pairs.where(n % 3 == 0).withColumn("profile_hash", F.when(n % 2 == 0, "new").otherwise("old"))
    return J.unscored(pairs, scores).select("job_id", "person_id")


@query(r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM s""")
def job_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(J.plain(F.col("html"))).alias("text_md5"))
