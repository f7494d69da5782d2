import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyproof.operators import geometry as G, glyphs, layout

BLOCKS = "doc_id int, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double"


def column_of(x0, x1, n, start=0):
    return [(x0, 70.0 + 24 * i, x1, 88.0 + 24 * i) for i in range(n)]


def columns(*groups, height=842.0):
    boxes = [b for g in groups for b in g]
    page = pd.DataFrame(boxes, columns=["x0", "y0", "x1", "y1"]).assign(page_width=595.0, page_height=height)
    return page.assign(col=layout.page_columns(page))


def test_two_columns():
    got = columns(column_of(45, 200, 28), column_of(265, 550, 28))
    assert set(got["col"]) == {0, 1}
    # a narrow column on the left is read last
    assert got["col"].iloc[0] == 1 if (200 - 45) / 595 < 0.3 else 0


def test_no_columns():
    assert columns(column_of(45, 255, 28), column_of(265, 550, 28))["col"].isna().all()
    assert columns(column_of(45, 200, 3), column_of(265, 550, 3))["col"].isna().all()
    assert columns(column_of(45, 550, 28))["col"].isna().all()


def test_three_columns():
    got = columns(column_of(40, 180, 20), column_of(240, 380, 20), column_of(450, 555, 20))
    assert set(got["col"]) == {0, 1, 2}


def test_cluster_ties_and_limits():
    assert layout.cluster(np.array([1.0, 1.0]), 2) is None
    assert layout.cluster(np.array([1.0, 2.0]), 3) is None
    assert layout.cluster(np.array([9.0, 1.0, 8.0, 2.0]), 2).tolist() == [1, 0, 1, 0]


def test_reading_order(spark):
    rows = [(1, p, s, x, y, x + 10, y + 10, t, 595.0, 842.0) for p, s, x, y, t in [(2, 0, 0.0, 0.0, "c"), (1, 1, 50.0, 10.4, "b"), (1, 2, 10.0, 10.0, "a")]]
    got = layout.reading_order(spark.createDataFrame(rows, BLOCKS)).orderBy("position").collect()
    assert [r["text"] for r in got] == ["a", "b", "c"]
    flat = [(1, 1, s, 0.0, float(-s), 0.0, 0.0, t, 0.0, 0.0) for s, t in enumerate("xyz")]
    got = layout.reading_order(spark.createDataFrame(flat, BLOCKS)).orderBy("position").collect()
    assert [r["text"] for r in got] == ["x", "y", "z"]


def glyph_rows(spark, words, step=2.0, gap=6.0):
    rows, x = [], 0.0
    for w in words:
        for c in w:
            rows.append((1, len(rows), c, x, x + 5))
            x += 5 + step
        x += gap - step
    return spark.createDataFrame(rows, "line int, ord int, ch string, x0 double, x1 double")


def test_glyphs(spark):
    assert glyphs.join_letterspaced(glyph_rows(spark, ["WORK", "HISTORY"]), ["line"]).first()["text"] == "WORK HISTORY"
    assert glyphs.split_run_on(glyph_rows(spark, ["one", "two"], 0.1, 1.0), ["line"]).first()["text"] == "one two"
    assert glyphs.split_run_on(glyph_rows(spark, ["word"], 0.0, 0.0), ["line"]).first()["text"] == "word"
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 4.0],)], "v array<double>")
    assert df.select(glyphs.upper_median(F.col("v"))).first()[0] == 3.0


def test_overlap_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [(1, i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(0, 400, (n, 4)))]
    a, b = make(60), make(50)
    schema = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    got = {(r["lid"], r["rid"]) for r in G.overlap_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["page"]).collect()}
    want = {(i, j) for _, i, x0, y0, x1, y1 in a for _, j, u0, v0, u1, v1 in b if x0 < u1 and u0 < x1 and y0 < v1 and v0 < y1}
    assert got == want


def test_guards(spark):
    df = spark.createDataFrame([(1, True, True, 40, 0), (1, False, False, 0, 0), (2, True, False, 150, 0), (2, False, False, 82, 0), (1, False, False, 40, 0), (1, False, False, 100, 40)], "p int, im boolean, rep boolean, v int, o int")
    got = [r[0] for r in df.select(G.text_guard(*(F.col(c) for c in ("p", "im", "rep", "v", "o")))).collect()]
    assert got == ["corrupt_file", "scanned_no_text_layer", "scanned_no_text_layer", None, "empty_document", "garbled_text"]
