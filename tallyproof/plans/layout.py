"""Queries on page geometry, glyphs, recognised words and files.

The tables have no pages, so boxes are derived from keys by plain arithmetic,
the same in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.functions import values
from tallyproof.operators import geometry as G, glyphs, layout
from tallyproof.plans.base import DL, query, table
from tallyproof.sources import files

#: Boxes of lineitems: an order is a page of 595 x 842 points.
_BOX = """
b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_partkey, l_quantity,
  CAST((l_partkey * 37 + l_linenumber * 11) % 500 AS DOUBLE) AS x0, CAST((l_suppkey * 53 + l_linenumber * 97) % 780 AS DOUBLE) AS y0,
  CAST((l_partkey * 37 + l_linenumber * 11) % 500 + 30 + l_quantity AS DOUBLE) AS x1, CAST((l_suppkey * 53 + l_linenumber * 97) % 780 + 12 AS DOUBLE) AS y1 FROM lineitem)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 500
    y = (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 97) % 780
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), "l_partkey", "l_quantity",
        x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 30 + F.col("l_quantity")).cast("double").alias("x1"), (y + 12).cast("double").alias("y1"))


@query(f"""WITH {_BOX} SELECT page, zone, count(*) AS n FROM (SELECT page, CASE WHEN y0 < 0.07 * 842 THEN 'header' WHEN y1 > 0.93 * 842 THEN 'footer' ELSE 'body' END AS zone FROM b) GROUP BY 1, 2""")
def zone_tags(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("page", values.zone(F.col("y0"), F.col("y1"), F.lit(842.0)).alias("zone")).agg(F.count("*").alias("n"))


@query(f"""WITH {_BOX} SELECT page, id, l_partkey, CAST(row_number() OVER (PARTITION BY page ORDER BY round_even(y0 / 2, 0), x0, id, l_partkey) AS INT) AS position FROM b""")
def reading_order(spark, sf_dir):
    """Single-column pages: rows two points high, then left edges."""
    from pyspark.sql import Window

    rows = boxes(spark, sf_dir)
    order = [F.bround(F.col("y0") / layout.ROW), F.col("x0"), F.col("id"), F.col("l_partkey")]
    return rows.select("page", "id", "l_partkey", F.row_number().over(Window.partitionBy("page").orderBy(*order)).alias("position"))


@query("""WITH b AS (SELECT p_size AS page, p_partkey AS seq, p_size % 3 AS kind, CASE WHEN p_size % 3 = 0 THEN 45.0 WHEN p_partkey % 2 = 0 THEN 45.0 ELSE 265.0 END AS x0,
  CASE WHEN p_size % 3 = 0 THEN 550.0 WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 3 = 1 THEN 200.0 ELSE 145.0 END ELSE 550.0 END AS x1, (p_partkey * 13) % 800 AS y0 FROM part),
c AS (SELECT *, min(x0) OVER p AS l, max(x0) OVER p AS r, count(*) OVER p AS n FROM b WINDOW p AS (PARTITION BY page)),
s AS (SELECT page, x0, (max(y0 + 18) - min(y0)) / 842.0 AS span FROM b GROUP BY 1, 2),
v AS (SELECT page, bool_and(span >= 0.5) AS tall FROM s GROUP BY page)
SELECT page, seq, CASE WHEN kind = 0 OR l = r OR n < 4 OR NOT tall THEN NULL WHEN x0 = 45 THEN 1 ELSE 0 END AS col FROM c JOIN v USING (page)""")
def column_detection(spark, sf_dir):
    """Pages of one column, or of a narrow one on the left, which is read last."""
    k, odd = F.col("p_size") % 3, F.col("p_partkey") % 2 == 0
    rows = table(spark, sf_dir, "part").select(
        F.lit(0).alias("doc_id"), F.col("p_size").alias("page"), F.col("p_partkey").alias("seq"), F.when((k == 0) | odd, 45.0).otherwise(265.0).alias("x0"), ((F.col("p_partkey") * 13) % 800).cast("double").alias("y0"),
        F.when((k == 0) | ~odd, 550.0).when(k == 1, 200.0).otherwise(145.0).alias("x1"), ((F.col("p_partkey") * 13) % 800 + 18).cast("double").alias("y1"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    return layout.detect_columns(rows).select("page", "seq", F.col("column").alias("col"))


@query(f"""WITH {_BOX}, t AS (SELECT page, id, x0 - 20 AS x0, y0 - 20 AS y0, x1 + 60 AS x1, y1 + 90 AS y1 FROM b WHERE id = 1 AND l_partkey % 3 > 0)
SELECT b.page, b.id, b.l_partkey, bool_or(t.page IS NOT NULL) AS from_table FROM b LEFT JOIN t ON t.page = b.page AND b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1 GROUP BY 1, 2, 3""")
def table_overlap(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    tables = rows.where(F.col("id") == 1).select(
        "page", F.col("l_partkey").alias("id"), (F.col("x0") - 20).alias("x0"), (F.col("y0") - 20).alias("y0"), (F.col("x1") + 60).alias("x1"), (F.col("y1") + 90).alias("y1"), F.lit(3).alias("n_rows"), (F.col("l_partkey") % 3 * 2).alias("n_cols"))
    named = rows.withColumn("id", F.struct("id", "l_partkey"))
    return G.in_table(named, tables.withColumn("id", F.struct(F.lit(0).alias("id"), F.col("id").alias("l_partkey"))), ["page"]).select("page", "id.id", "id.l_partkey", "from_table").groupBy("page", "id", "l_partkey").agg(F.bool_or("from_table").alias("from_table"))


@query(f"""WITH {_BOX}, d AS (SELECT page, id, l_partkey, x0, y0, x1, y1 FROM b WHERE l_partkey % 2 = 0 AND x1 - x0 >= 40 AND y1 - y0 > 0 AND y1 - y0 <= 20),
t AS (SELECT page, x0, y0, x1, y1 FROM b WHERE l_partkey % 2 = 1)
SELECT page, count(*) AS bars FROM d WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page = d.page AND d.x0 < t.x1 AND t.x0 < d.x1 AND d.y0 < t.y1 AND t.y0 < d.y1) GROUP BY page HAVING count(*) >= 3""")
def skill_bars(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("id", F.struct("id", "l_partkey"))
    even = F.col("l_partkey") % 2 == 0
    return G.skill_bars(rows.where(even).withColumn("filled", F.lit(True)), rows.where(~even), ["page"])


@query("""SELECT l_orderkey, CAST(max(l_quantity) AS DOUBLE) AS max_font_size, coalesce(bool_and(CASE WHEN l_linenumber % 5 > 0 THEN
 abs((c >> 16) % 256 - 255) <= 8 AND abs((c >> 8) % 256 - 255) <= 8 AND abs(c % 256 - 255) <= 8 END), true) AS hidden
FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 16777215 - (l_partkey % 9) * 65793 ELSE (l_orderkey * 7919 + l_linenumber) % 16777216 END AS c FROM lineitem) GROUP BY l_orderkey""")
def hidden_text(spark, sf_dir):
    c = F.when(F.col("l_orderkey") % 3 == 0, 16777215 - F.col("l_partkey") % 9 * 65793).otherwise((F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 16777216)
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", c.alias("color"), F.col("l_quantity").alias("size"), F.when(F.col("l_linenumber") % 5 > 0, "x").otherwise(" ").alias("run_text"))
    blocks = runs.select("l_orderkey").distinct()
    return G.decorated(blocks, runs, ["l_orderkey"]).select("l_orderkey", "max_font_size", F.col("hidden_text").alias("hidden"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag || l_linestatus AS t, l_quantity * 2 AS conf, l_partkey % 2000 AS px, l_suppkey % 3000 AS py FROM lineitem)
SELECT l_orderkey, string_agg(t, ' ' ORDER BY l_linenumber, l_partkey, t) AS text, min(px) * (72.0::DOUBLE / 300) AS x0, min(py) * (72.0::DOUBLE / 300) AS y0, max(px + 50) * (72.0::DOUBLE / 300) AS x1, max(py + 20) * (72.0::DOUBLE / 300) AS y1
FROM w WHERE conf >= 30 GROUP BY l_orderkey""")
def recognised_lines(spark, sf_dir):
    x, y = F.col("l_partkey") % 2000, F.col("l_suppkey") % 3000
    words = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey").alias("word_no"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_quantity") * 2).alias("confidence"),
        x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 20).alias("y1"))
    return G.hull(words, ["l_orderkey"])


_GLYPHS = """
g AS (SELECT p_partkey, CAST(unnest(generate_series(1, length(p_name))) AS INT) AS ord, p_name FROM part),
h AS (SELECT p_partkey, ord, substr(p_name, ord, 1) AS ch, 10.0 * ord + CASE WHEN ord > strpos(p_name, ' ') THEN 8.0 ELSE 0.0 END AS x0 FROM g),
i AS (SELECT *, x0 + 8.0 AS x1 FROM h WHERE ch <> ' ')
"""


def part_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of part names, ten points apart, eight more behind the first space."""
    chars = table(spark, sf_dir, "part").select("p_partkey", F.instr("p_name", " ").alias("gap"), F.posexplode(F.split("p_name", "")).alias("ord", "ch")).withColumn("ord", F.col("ord") + 1)
    x = 10.0 * F.col("ord") + F.when(F.col("ord") > F.col("gap"), 8.0).otherwise(0.0)
    return chars.select("p_partkey", "ord", "ch", x.alias("x0"), (x + 8.0).alias("x1")).where("ch <> ' '")


@query(f"""WITH {_GLYPHS}, d AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY p_partkey ORDER BY ord) AS gap FROM i),
m AS (SELECT p_partkey, list_sort(list(gap))[1 + CAST(floor(len(list(gap)) / 2.0) AS INT)] AS mid FROM d WHERE gap > 0 GROUP BY 1)
SELECT d.p_partkey, string_agg(CASE WHEN gap > 2 * mid THEN ' ' ELSE '' END || ch, '' ORDER BY ord) AS text FROM d LEFT JOIN m USING (p_partkey) GROUP BY 1""")
def gap_rebuild(spark, sf_dir):
    return glyphs.join_letterspaced(part_glyphs(spark, sf_dir), ["p_partkey"])


@query(f"""WITH {_GLYPHS}, d AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY p_partkey ORDER BY ord) AS gap FROM i), m AS (SELECT p_partkey, greatest(0.3, 0.5 * max(gap)) AS least FROM d GROUP BY 1)
SELECT d.p_partkey, string_agg(CASE WHEN gap >= least THEN ' ' ELSE '' END || ch, '' ORDER BY ord) AS text FROM d JOIN m USING (p_partkey) GROUP BY 1""")
def run_on_rebuild(spark, sf_dir):
    return glyphs.split_run_on(part_glyphs(spark, sf_dir), ["p_partkey"])


_VISIBLE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"""WITH g AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '{_VISIBLE}', '', 'g')) AS v, length(regexp_replace(regexp_replace(coalesce(text, ''), '{_VISIBLE}', '', 'g'), '[\\pL\\pN]', '', 'g')) AS o FROM documents)
SELECT doc_id, CASE WHEN doc_id % 13 = 0 AND v < 50 THEN 'corrupt_file' WHEN v = 0 OR (doc_id % 4 = 0 AND v / greatest(doc_id % 9, 1) < 100) THEN 'scanned_no_text_layer'
 WHEN v < 50 THEN 'empty_document' WHEN o / v > 0.30 THEN 'garbled_text' END AS code FROM g""")
def text_guard(spark, sf_dir):
    """Every 13th document counts as repaired, every fourth as having images."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", G.visible_count(text).alias("v"), G.odd_count(text).alias("o"))
    d = F.col("doc_id")
    return rows.select("doc_id", G.text_guard(d % 9, d % 4 == 0, d % 13 == 0, F.col("v"), F.col("o")).alias("code"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'corrupt_file' WHEN o_orderkey % 11 = 0 THEN 'password_protected' WHEN o_custkey % 20 > 15 THEN 'file_too_large' WHEN o_custkey % 20 = 0 THEN 'corrupt_file' END AS code,
 least(420000.0, 30000.0 + 2600.0 * o_totalprice / 1024.0) AS upload_ms FROM orders""")
def open_guard(spark, sf_dir):
    k, pages = F.col("o_orderkey"), F.col("o_custkey") % 20
    return table(spark, sf_dir, "orders").select("o_orderkey", G.open_guard(k % 17 != 0, k % 11 == 0, pages).alias("code"), values.upload_ms(F.col("o_totalprice")).alias("upload_ms"))


_HEADS = ("", "255044462d", "d0cf11e0", "7b5c72746631", "504b0304", "ff")


@query(f"""WITH {DL}, v AS (SELECT doc_id, sum(length(trim(text))) AS n FROM dl GROUP BY 1)
SELECT CASE d.doc_id % 6 WHEN 1 THEN 'pdf' WHEN 0 THEN CASE WHEN coalesce(v.n, 0) < 50 THEN 'empty_document' WHEN d.doc_id % 5 = 0 THEN 'md' ELSE 'txt' END ELSE 'unsupported_format' END AS verdict, count(*) AS n
FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY 1""")
def format_tally(spark, sf_dir):
    """Texts as files, most with the first bytes of another format in front."""
    d = F.col("doc_id")
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (d % 6).cast("int") + 1))
    name = F.concat(F.lit("f"), F.when(d % 5 == 0, ".MD").otherwise(".txt"))
    rows = table(spark, sf_dir, "documents").select(name.alias("name"), F.concat(head, F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    return files.tally(files.classify(rows)).select("verdict", "n")


@query("SELECT sha256(coalesce(text, '')) AS sha, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedupe_by_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", files.content_key(F.coalesce("text", F.lit("")).cast("binary")).alias("sha"))
    return rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_parses(spark, sf_dir):
    return files.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {DL} SELECT doc_id, no, text FROM dl")
def stream_equals_batch(spark, sf_dir):
    """Documents taken in as a stream of files; the same lines as `lines_explode`."""
    import uuid

    from tallyproof.sources.files import shared_folder
    from tallyproof.streaming.ingest import ingest_lines

    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    ingest_lines(spark, f"{sf_dir}/documents.parque[t]", schema, f"{work}/lines", f"{work}/progress")
    return spark.read.parquet(f"{work}/lines").select("doc_id", "no", "text")


@query("""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark, sf_dir):
    from tallyproof.streaming.ingest import windowed_counts

    rows = windowed_counts(table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)")))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))
