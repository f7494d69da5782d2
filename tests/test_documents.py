import json

import pytest
from pyspark.sql import functions as F

from tallyproof.__main__ import main
from tallyproof.operators import claims as K
from tallyproof.plans import documents as D
from tallyproof.sources import files

from tests.test_store import DOC, zipped

LONG_DOC = DOC.replace("Heading", "A heading that is long enough for a document to count as one")

TEXT = "Jane Morgan\n\nBuilt a high-\nthroughput pipeline for orders.\n- Ran it for years and years\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.txt").write_text(TEXT)  # the same content again
    (tmp_path / "c.rtf").write_bytes(b"{\\rtf1 hello")
    (tmp_path / "d.txt").write_text("short")
    (tmp_path / "e.docx").write_bytes(zipped(word__document_xml=LONG_DOC))
    (tmp_path / "f.docx").write_bytes(zipped(word__document_xml=DOC))
    return str(tmp_path)


def test_extract(spark, folder):
    found, lines, dropped = D.extract(spark, folder)
    assert {r["name"]: r["reject_code"] for r in found.collect()} == {"a.txt": None, "b.txt": None, "c.rtf": "unsupported_format", "d.txt": "empty_document", "e.docx": None, "f.docx": "empty_document"}
    sha = {r["name"]: r["sha"] for r in found.collect()}
    rows = {(r["sha"], r["no"]): (r["text"], r["is_bullet"]) for r in lines.collect()}
    assert rows[sha["a.txt"], 1] == ("Jane Morgan", False) and rows[sha["a.txt"], 2] == ("", False)
    assert rows[sha["a.txt"], 3][0] == "Built a high-throughput pipeline for orders." and rows[sha["a.txt"], 4] == ("Ran it for years and years", True)
    assert [t for (s, _), (t, _) in sorted(rows.items()) if s == sha["e.docx"]] == ["A heading that is long enough for a document to count as one", "In a box", "kept end", "Skill", "Years"]
    assert dropped.count() == 0


def test_batch(spark, folder):
    got = [(r["name"], r["coverage_pct"], r["represented_pct"], r["failure"]) for r in D.parse_many(spark, folder).collect()]
    assert got == [("a.txt", 100.0, 100.0, None), ("b.txt", 100.0, 100.0, None), ("c.rtf", None, None, "unsupported_format"), ("d.txt", None, None, "empty_document"), ("e.docx", 100.0, 100.0, None), ("f.docx", None, None, "empty_document")]


class Nested:
    """Claims with a role at another company, plain fields of which one is made up, and a link."""

    def propose(self, messages):
        span = lambda text, *no: {"text": text, "source_lines": list(no)}
        role = lambda company, title, bullet, *below: {"company": company, "title": title, "start": {"raw": ""}, "end": {"raw": ""}, "bullets": [bullet], "sub_roles": list(below), "source_lines": bullet["source_lines"]}
        inner = role("Northern Lights", "Ran it for years", span("Ran it for years and years", 4))
        outer = role("Jane Morgan", "Builder of orders", span("Built a high-throughput pipeline for orders.", 3), inner)
        return json.dumps({"contact": {"name": span("Jane Morgan", 1), "links": [span("github.com/jane", 1)], "source_lines": [1]}, "experience": [outer]}), False


def test_nested_claims(spark, folder, tmp_path):
    K.register("nested", Nested)
    _, lines, dropped = D.extract(spark, folder)
    parsed = D.structure(lines, "nested")
    judged, report = D.verify(parsed, lines, dropped)
    sha = lines.where("text = 'Jane Morgan'").first()["sha"]
    own = {r["path"]: (r["flag"], r["label"]) for r in judged.where(F.col("sha") == sha).collect()}
    assert own == {"contact.name": ("ok", None), "contact.links.0": ("hallucinated", "GitHub"), "experience.0.bullets.0": ("ok", None), "experience.1.bullets.0": ("ok", None)}
    r = report.where(F.col("sha") == sha).first()
    assert (r["coverage_pct"], r["represented_pct"]) == (100.0, 100.0)
    assert [tuple(f) for f in r["flagged"]] == [(1, "hallucinated_span"), (3, "unsourced_company"), (3, "unsourced_title"), (4, "unsourced_company")]
    D.parse_many(spark, folder, "nested", out=str(tmp_path / "kept")).collect()
    kept = files.load_keyed(spark, str(tmp_path / "kept/claims"), sha)
    assert kept.count() == 4


def test_failing_provider(spark, folder):
    K.register("mute", lambda: K.TableProvider([]))
    got = {r["name"]: r["failure"] for r in D.parse_many(spark, folder, "mute").collect()}
    assert got["a.txt"] == got["e.docx"] == "validation_failed"
    with pytest.raises(K.ProviderError):
        D.structure(D.extract(spark, folder)[1], "nobody")


def test_command(spark, folder, capsys):
    assert main([]) == main(["nope", folder]) == main(["all", folder + "/none"]) == 2
    capsys.readouterr()
    assert main(["all", folder]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [r["name"] for r in rows] == ["a.txt", "b.txt", "c.rtf", "d.txt", "e.docx", "f.docx"]
