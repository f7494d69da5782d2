"""Stages keep columns of any name, with ids that repeat and without."""

import pytest

import corpus_pipeline as cp

EXTRA = ("__row", "row", "id", "size", "tie", "Text", "DOC_ID", "nr", "kept", "taken", "also_5_")
SOURCE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("again", [False, True], ids=["ids once", "ids repeat"])
@pytest.mark.parametrize("name,stage", cp.STAGES[:4], ids=lambda v: v if isinstance(v, str) else "")
def test_columns_of_any_name(spark, name, stage, again):
    base = spark.read.parquet(f"{SOURCE}/documents.parquet").orderBy("doc_id").limit(40).select(*cp.COLUMNS).collect()
    rows = [(*r, *(1000 * (j + 1) + k for j in range(len(EXTRA)))) for k, r in enumerate(base)]
    if again:
        rows += [(None, *rows[3][1:]), (rows[5][0], *rows[6][1:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in EXTRA)
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SOURCE)
    assert out.columns == docs.columns
    known = {(r[0], r[3], *r[5:]) for r in rows}
    got = [tuple(r) for r in out.collect()]
    assert got and {(r[0], r[3], *r[5:]) for r in got} <= known
    if name == "pii":
        assert len(got) == len(rows)
