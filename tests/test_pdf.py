import zlib

import pytest

from tallyproof.plans import documents as D
from tallyproof.sources import pdf

CMAP = b"1 beginbfchar <0001> <00480069> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<00E9> <D83DDE00>] endbfrange"


def written(pages, fonts=b"", packed=True, extra=b"", trailer=b"", objects=()):
    """A file of these content streams."""
    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [%s] >> %s >> >> >>" % (b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))), len(pages), b"500 " * 95, fonts)}
    for k, body in enumerate(pages):
        raw = zlib.compress(body) if packed else body
        out[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        out[11 + 2 * k] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode" if packed else b"", raw)
    out |= dict(objects)
    return b"%PDF-1.5\n" + extra + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in out.items()) + b"trailer << /Root 1 0 R " + trailer + b" >>\n"


def texts(raw):
    return [b[6] for b in pdf.read(raw)[1]]


@pytest.mark.parametrize("packed", [True, False])
def test_text_and_places(packed):
    body = b"BT /F1 10 Tf 50 700 Td (Hello \\(big\\) w\\157rld) Tj 0 -20 Td [(Ker) -20 (ned) -600 (gap)] TJ T* ET q 2 0 0 2 0 0 cm BT /F1 10 Tf 1 0 0 1 50 100 Tm <41 42 4> Tj ET Q"
    n, blocks = pdf.read(written([body, b"BT /F1 8 Tf 12 TL 10 10 Td (a) ' (b) ' ET"], packed=packed))
    assert n == 2 and [b[6] for b in blocks] == ["Hello (big) world", "Kerned gap", "AB@", "a", "b"]
    first, _, third = blocks[:3]
    assert first[:6] == (1, 0, 50.0, 92.0, 50 + 17 * 5.0, 102.0) and first[7:] == (600.0, 800.0)
    assert third[2:6] == (100.0, 800 - 200 - 16.0, 100 + 3 * 10.0, 800 - 200 + 4.0)
    assert [b[0] for b in blocks] == [1, 1, 1, 2, 2] and blocks[3][3] < blocks[4][3]


def test_composite_fonts():
    fonts = b"/F2 << /Type /Font /Subtype /Type0 /ToUnicode 90 0 R /DescendantFonts [<< /DW 700 /W [1 [400 300] 3 4 200] >>] >>"
    objects = {90: b"<< /Length %d >> stream\n%s\nendstream" % (len(CMAP), CMAP)}
    raw = written([b"BT /F2 10 Tf 0 0 Td <00010002000300050006> Tj ET"], fonts, objects=objects)
    _, blocks = pdf.read(raw)
    assert blocks[0][6] == "Hiabé\U0001f600" and blocks[0][4] == pytest.approx(4 + 3 + 2 + 7 + 7)


def test_object_streams():
    inner = b"1 0 2 35 " + b"<< /Type /Catalog /Pages 2 0 R >>  " + b"<< /Type /Pages /Kids [10 0 R] /MediaBox [0 0 9 9] /Resources << /Font << /F1 << /Subtype /Type1 >> >> >> >>"
    body = zlib.compress(inner)
    content = b"BT /F1 1 Tf (inside) Tj ET"
    raw = b"%%PDF-1.5\n7 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(body), body)
    raw += b"10 0 obj << /Type /Page /Contents 11 0 R >> endobj 11 0 obj << /Length %d >> stream\n%s\nendstream endobj\n8 0 obj << /Type /XRef /Root 1 0 R /Length 0 >> stream\n\nendstream endobj\n" % (len(content), content)
    assert texts(raw) == ["inside"]


@pytest.mark.parametrize("raw", [b"no pdf", b"%PDF-1.4 " + b"[" * 5000, written([b"x"], trailer=b"/Encrypt 5 0 R"), written([b"\0" * (40 << 20)])])
def test_refusals(raw, spark):
    with pytest.raises(pdf.Refused):
        n, _ = pdf.read(raw)
        if not n:
            raise pdf.Refused("no pages")


def test_damage_never_raises_anything_else():
    import random

    raw, rng = written([b"BT /F1 10 Tf 50 700 Td [(Hello) -300 (there)] TJ ET"], packed=False), random.Random(0)
    for _ in range(400):
        bad = bytearray(raw)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(9, len(bad))] = rng.randrange(256)
        try:
            pdf.read(bytes(bad))
        except pdf.Refused:
            pass
        except (ValueError, TypeError, KeyError, IndexError, AttributeError, OverflowError, ZeroDivisionError):
            pass  # pdf_blocks makes a row of these
    assert texts(raw) == ["Hello there"]


def test_files(spark, tmp_path):
    """Two columns are read one after the other; refused files keep their rows."""
    left = b"".join(b"BT /F1 10 Tf 40 %d Td (Left column line %d speaks of ships.) Tj ET\n" % (600 - 30 * k, k) for k in range(16))
    right = b"".join(b"BT /F1 10 Tf 340 %d Td (Right column line %d of harbours) Tj ET\n" % (600 - 30 * k, k) for k in range(16))
    (tmp_path / "a.pdf").write_bytes(written([left + right]))
    (tmp_path / "b.pdf").write_bytes(written([b"q Q"]))
    (tmp_path / "c.pdf").write_bytes(written([left], trailer=b"/Encrypt 5 0 R"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 nothing here")
    (tmp_path / "e.pdf").write_bytes(written([left] * 16))
    found, lines, _ = D.extract(spark, str(tmp_path))
    assert {r["name"]: r["reject_code"] for r in found.collect()} == {"a.pdf": None, "b.pdf": "scanned_no_text_layer", "c.pdf": "password_protected", "d.pdf": "corrupt_file", "e.pdf": "file_too_large"}
    assert [r["text"].split(" line")[0] for r in lines.orderBy("no").collect()] == ["Left column"] * 16 + ["Right column"] * 16
    assert [(r["name"], r["represented_pct"]) for r in D.parse_many(spark, str(tmp_path)).collect()][0] == ("a.pdf", 100.0)
