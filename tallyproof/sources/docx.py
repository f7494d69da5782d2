"""DOCX: the XML read in document order with the standard library."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Elements that never become content.
SKIPPED = frozenset(("del", "delText", "commentReference", "commentRangeStart", "commentRangeEnd", "footnoteReference", "endnoteReference", "proofErr", "bookmarkStart", "bookmarkEnd"))
#: Bytes that the parts of one file may inflate to.
MAX_INFLATED = 100 << 20
_BREAKS = {"tab": "\t", "br": "\n", "cr": "\n"}


def _events(node: ElementTree.Element, table: bool, bullet: bool) -> Iterator[tuple[str, str, bool, bool]]:
    """("text", characters, ..) and ("end", "", table, bullet) where a block ends."""
    name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
    if name in SKIPPED:
        return
    if name == "t":
        yield "text", node.text or "", table, bullet
    elif name in _BREAKS:
        yield "text", _BREAKS[name], table, bullet
    elif name == "AlternateContent":  # the same content twice: the modern form, or else the old one
        forms = {c.tag.rpartition("}")[2]: c for c in reversed(list(node))}
        for child in forms.get("Choice", forms.get("Fallback", ())):
            yield from _events(child, table, bullet)
    elif name in ("p", "tbl"):
        inner_table = table or name == "tbl"
        inner_bullet = node.find(f".//{_W}numPr") is not None if name == "p" else bullet
        yield "end", "", table, bullet
        for child in node:
            yield from _events(child, inner_table, inner_bullet)
        yield "end", "", inner_table, inner_bullet
    else:
        for child in node:
            yield from _events(child, table, bullet)


def part_blocks(xml: bytes) -> list[tuple[str, bool, bool]]:
    """(text, from_table, is_bullet) of one part."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    out, held = [], []
    for kind, text, table, bullet in [*_events(root, False, False), ("end", "", False, False)]:
        if kind == "text":
            held.append(text)
        else:
            if joined := "".join(held).strip():
                out.append((joined, table, bullet))
            held = []
    return out


def blocks(content: bytes) -> list[tuple[int, str, str, bool, bool]] | None:
    """(seq, zone, text, from_table, is_bullet): headers, body, footers; None for a
    file that isn't a readable DOCX, or whose parts inflate to more than MAX_INFLATED."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return None
    with archive:
        names = archive.namelist()
        if "word/document.xml" not in names:
            return None
        if sum(i.file_size for i in archive.infolist() if i.filename.startswith("word/")) > MAX_INFLATED:
            return None
        parts = [("header", n) for n in sorted(set(names)) if n.startswith("word/header")] + [("body", "word/document.xml")] + [("footer", n) for n in sorted(set(names)) if n.startswith("word/footer")]
        try:
            rows = [(zone, *b) for zone, n in parts for b in part_blocks(archive.read(n))]
        except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, EOFError):
            return None
    return [(k, *r) for k, r in enumerate(rows)]


def docx_blocks(files: DataFrame) -> DataFrame:
    """(sha, seq, page, zone, text, from_table, is_bullet, error) of (sha, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sha, content in zip(batch["sha"], batch["content"], strict=True):
                got = blocks(content)
                rows += [(sha, None, 1, None, None, None, None, "corrupt_file")] if got is None else [(sha, k, 1, zone, text, table, bullet, None) for k, zone, text, table, bullet in got]
            yield pd.DataFrame(rows, columns=["sha", "seq", "page", "zone", "text", "from_table", "is_bullet", "error"]).astype({"seq": "Int32"})

    return files.select("sha", "content").mapInPandas(run, "sha string, seq int, page int, zone string, text string, from_table boolean, is_bullet boolean, error string")
