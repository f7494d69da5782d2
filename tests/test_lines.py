import itertools

from pyspark.sql import functions as F

from tallyproof.operators import lines as L

SCHEMA = "doc_id int, seq int, page int, column int, zone string, text string"


def to_lines(spark, blocks):
    rows = [(1, i, page, column, zone, text) for i, (page, column, zone, text) in enumerate(blocks)]
    lines, dropped = L.to_lines(spark.createDataFrame(rows, SCHEMA))
    return [(r["no"], r["text"], r["unjoined"]) for r in lines.orderBy("no").collect()], [(r["no"], r["text"], r["reason"]) for r in dropped.orderBy(F.desc("no")).collect()]


def body(*texts):
    return [(1, None, "body", t) for t in texts]


def test_hyphens(spark):
    got, _ = to_lines(spark, body("the company's top-\nrequested feature"))
    assert got == [(1, "the company's top-requested feature", ["the company's top-", "requested feature"])]
    assert [t for _, t, _ in to_lines(spark, body("Senior Engineer-\nAcme Corp"))[0]] == ["Senior Engineer-", "Acme Corp"]
    assert len(to_lines(spark, body("张伟-\n软件"))[0]) == 2
    assert [t for _, t, _ in to_lines(spark, body("a-\nb-\nc"))[0]] == ["a-b-", "c"]
    assert [t for _, t, _ in to_lines(spark, body("a-\nb-\nc-\nd-\ne"))[0]] == ["a-b-", "c-d-", "e"]


def greedy(texts):
    out, i = [], 0
    while i < len(texts):
        if i + 1 < len(texts) and texts[i].endswith("-") and len(texts[i]) > 1 and texts[i + 1][:1].islower():
            out.append(texts[i] + texts[i + 1])
            i += 2
        else:
            out.append(texts[i])
            i += 1
    return out


def test_hyphens_against_a_loop(spark):
    cases = list(itertools.product(["a-", "b", "C-", "D"], repeat=5))
    rows = [(d, k, 1, None, "latin", t) for d, c in enumerate(cases) for k, t in enumerate(c)]
    df = spark.createDataFrame(rows, "doc int, seq int, page int, column int, script string, text string")
    got = L.join_hyphens(df, ["doc"], ["seq"]).orderBy("doc", "seq").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("l")).collect()
    assert all([x["text"] for x in r["l"]] == greedy(cases[r["doc"]]) for r in got)


def test_page_breaks(spark):
    got, _ = to_lines(spark, [(1, None, "body", "built a pipeline that"), (2, None, "body", "handles orders")])
    assert [t for _, t, _ in got] == ["built a pipeline that handles orders"]
    assert len(to_lines(spark, [(1, None, "body", "the regression suite"), (2, None, "body", "EDUCATION")])[0]) == 2


def test_furniture(spark):
    rows = [(p, None, z, t) for p in (1, 2, 3) for z, t in (("body", f"Text of page {p}."), ("footer", f"Page {p} of 3"))]
    got, dropped = to_lines(spark, rows)
    assert [d[2] for d in dropped] == ["repeated_page_footer"] * 3 and [d[0] for d in dropped] == [-1, -2, -3]
    rows = [(p, None, z, t) for p in (1, 2) for z, t in (("header", "CONFIDENTIAL"), ("body", f"Text {p}."))]
    assert [d[2] for d in to_lines(spark, rows)[1]] == ["repeated_on_every_page"] * 2
    got, dropped = to_lines(spark, [(1, None, "header", "jane@example.com"), (1, None, "body", "Text.")])
    assert not dropped and got[0][1] == "jane@example.com"


def test_numbering_and_line_breaks(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, None), (4, "x\x0by z")], "doc_id int, text string")
    got = {}
    for r in L.text_lines(df).collect():
        got.setdefault(r["doc_id"], []).append((r["no"], r["text"]))
    want = {i: list(enumerate(t.splitlines(), 1)) for i, t in ((1, "a\r\nb\n\nc\n"), (4, "x\x0by z"))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_furniture_query_reads_texts_once(spark, tmp_path):
    import __spark_entry__

    rows = [(1, "a", "Head 1\nx\nfoot\n"), (2, "a", "Head 2\n\nfoot"), (3, "a", "foot"), (4, "a", "own\nbody\nbody\nfoot"), (5, "a", ""), (6, "b", "alone\r\nfoot"), (7, None, "Head 3"), (8, "c", None), (9, "d", "\n\n")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()["furniture"](spark, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
    got = {(r["doc_id"], r["no"]): r["reason"] for r in out.collect()}
    every, footer = "repeated_on_every_page", "repeated_page_footer"
    assert got == {
        (1, 1): footer, (1, 2): None, (1, 3): every, (2, 1): footer, (2, 2): None, (2, 3): every, (3, 1): every, (4, 1): None, (4, 2): None, (4, 3): None, (4, 4): every,
        (6, 1): None, (6, 2): None, (7, 1): None, (9, 1): None, (9, 2): None,
    }
