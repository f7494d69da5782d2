"""PDF: text with its place on the page, read with the standard library.

Covers files with a text layer: Flate streams, object streams, nested page trees,
inherited resources, simple and composite fonts with ToUnicode maps. Pictures,
encryption and other filters are not read; `pdf_blocks` takes another reader where one
is at hand, and refusals come as codes, not as errors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that one stream, and all streams of a file together, may inflate to.
MAX_STREAM, MAX_INFLATED = 32 << 20, 200 << 20
#: How deep objects may nest.
MAX_DEPTH = 60


class Name(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


class Operator(str):
    pass


class Refused(Exception):
    """A file that can't be read, with the code it is refused with."""


_TOKEN = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*(?:(<<|>>|\[|\])|/([^\x00\t\n\f\r ()<>\[\]{}/%]*)|(\()|<([0-9A-Fa-f\s]*)>|([+-]?(?:\d+\.?\d*|\.\d+))(?![^\x00\t\n\f\r ()<>\[\]{}/%])|([^\x00\t\n\f\r ()<>\[\]{}/%]+)|([{}]))")
_REF = re.compile(rb"[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_WORDS = {b"true": True, b"false": False, b"null": None}


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose opening bracket lies before `at`."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            m = re.compile(rb"[0-7]{1,3}|\r\n|.", re.S).match(data, at + 1)
            if not m:
                break
            e = m.group()
            out += bytes([int(e, 8) & 255]) if e[:1].isdigit() and e[0] < 56 else b"" if e in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(e, e)
            at = m.end()
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def values(data: bytes, at: int = 0, single: bool = False) -> Iterator[tuple[object, int]]:
    """Objects and operators one after the other, each with the place behind it."""
    held: list[tuple[str, list]] = []
    while m := _TOKEN.match(data, at):
        at = m.end()
        mark, name, bracket, digits, number, word, _ = m.groups()
        if mark in (b"<<", b"["):
            held.append((mark.decode(), []))
            if len(held) > MAX_DEPTH:
                raise Refused("corrupt_file")
            continue
        if mark:
            if not held:
                continue
            kind, items = held.pop()
            value: object = items if kind == "[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, str)}
        elif name is not None:
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x.group(1), 16)]), name).decode("latin-1"))
        elif bracket:
            value, at = _string(data, at)
        elif digits is not None:
            clean = re.sub(rb"\s", b"", digits)
            value = bytes.fromhex((clean + b"0" * (len(clean) % 2)).decode())
        elif number is not None:
            ref = _REF.match(data, at) if number.isdigit() else None
            value, at = (Ref(int(number)), ref.end()) if ref else (float(number) if b"." in number else int(number), at)
        elif word in _WORDS:
            value = _WORDS[word]
        else:
            value = Operator((word or m.group(7)).decode("latin-1"))
        if held:
            held[-1][1].append(value)
        else:
            yield value, at
            if single:
                return


class File:
    """The objects of a file; the last of each number counts."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Refused("corrupt_file")
        self.data, self.inflated = data, 0
        self.places = {int(m.group(1)): m.end() for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+\d+\s+obj\b", data)}
        self.kept: dict[int, object] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"\btrailer\b", data):
            found = next(values(data, m.end(), True), (None, 0))[0]
            self.trailer |= found if isinstance(found, dict) else {}
        for number in list(self.places):
            value = self.object(number)
            if isinstance(value, Stream) and value.head.get("Type") == "XRef":
                self.trailer = value.head | self.trailer
        if "Encrypt" in self.trailer:
            raise Refused("password_protected")
        for number in list(self.places):
            value = self.object(number)
            if isinstance(value, Stream) and value.head.get("Type") == "ObjStm":
                self._unpack(value)

    def object(self, number: int) -> object:
        if number not in self.kept and number in self.places:
            self.kept[number] = None  # an object that leads back to itself
            value, end = next(values(self.data, self.places[number], True), (None, 0))
            start = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, end) if isinstance(value, dict) else None
            if start:
                size = self.of(value.get("Length"))
                stop = start.end() + size if isinstance(size, int) and self.data[start.end() + size :].lstrip(b"\r\n \t")[:9] == b"endstream" else self.data.find(b"endstream", start.end())
                value = Stream(value, self.data[start.end() : stop if stop >= 0 else len(self.data)])
            self.kept[number] = value
        return self.kept.get(number)

    def of(self, value: object) -> object:
        for _ in range(MAX_DEPTH):
            if not isinstance(value, Ref):
                break
            value = self.object(value.number)
        return value

    def bytes_of(self, stream: Stream) -> bytes:
        filters = self.of(stream.head.get("Filter")) or []
        raw = stream.raw
        for name in [filters] if isinstance(filters, str) else filters:
            if self.of(name) not in ("FlateDecode", "Fl"):
                return b""  # a picture, or a filter that isn't read
            unpacker = zlib.decompressobj()
            try:
                raw = unpacker.decompress(raw, MAX_STREAM)
            except zlib.error:
                return b""
            self.inflated += len(raw)
            if unpacker.unconsumed_tail or self.inflated > MAX_INFLATED:
                raise Refused("file_too_large")
        return raw

    def _unpack(self, stream: Stream) -> None:
        body, first = self.bytes_of(stream), self.of(stream.head.get("First"))
        if not isinstance(first, int):
            return
        heads = [v for v, _ in values(body[:first]) if isinstance(v, int)]
        for number, at in zip(heads[::2], heads[1::2], strict=False):
            if number not in self.places:
                self.kept.setdefault(number, next(values(body, first + at, True), (None, 0))[0])

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        root = self.of(self.trailer.get("Root"))
        top = root.get("Pages") if isinstance(root, dict) else None
        out, todo, seen = [], [(top, {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.of(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref.number in seen):
                continue
            seen |= {ref.number} if isinstance(ref, Ref) else set()
            own = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            kids = self.of(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, own) for k in reversed(kids)]
            else:
                out.append(own | node)
        return out


class Font:
    """How the bytes of a string become letters and widths (thousandths of the size)."""

    def __init__(self, file: File, font: dict):
        self.two = file.of(font.get("Subtype")) == "Type0"
        self.letters: dict[int, str] = {}
        self.width: dict[int, float] = {}
        self.usual = 500.0
        unicode_map = file.of(font.get("ToUnicode"))
        if isinstance(unicode_map, Stream):
            self._map(file.bytes_of(unicode_map))
        encoding = file.of(font.get("Encoding"))
        if isinstance(encoding, dict):
            code = 0
            for item in file.of(encoding.get("Differences")) or []:
                if isinstance(item, int):
                    code = item
                elif isinstance(item, str):
                    m = re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", item)
                    if m or len(item) == 1:
                        self.letters.setdefault(code, chr(int(m.group(1), 16)) if m else item)
                    code += 1
        if self.two:
            below = file.of((file.of(font.get("DescendantFonts")) or [None])[0])
            below = below if isinstance(below, dict) else {}
            dw = file.of(below.get("DW"))
            self.usual = float(dw) if isinstance(dw, (int, float)) else 1000.0
            items = [file.of(x) for x in file.of(below.get("W")) or []]
            while len(items) >= 2:
                if isinstance(items[1], list):
                    self.width |= {items[0] + k: float(w) for k, w in enumerate(map(file.of, items[1])) if isinstance(w, (int, float))}
                    items = items[2:]
                else:
                    self.width |= {c: float(items[2]) for c in range(items[0], min(items[1], items[0] + 65_536) + 1)} if len(items) > 2 else {}
                    items = items[3:]
        else:
            first, widths = file.of(font.get("FirstChar")), file.of(font.get("Widths"))
            if isinstance(first, int) and isinstance(widths, list):
                self.width = {first + k: float(w) for k, w in enumerate(map(file.of, widths)) if isinstance(w, (int, float))}

    def _map(self, body: bytes) -> None:
        held: list = []
        text = lambda b: b.decode("utf-16-be", "replace") if isinstance(b, bytes) else ""
        number = lambda b: int.from_bytes(b, "big")
        for value, _ in values(body):
            if not isinstance(value, Operator):
                held.append(value)
                continue
            if value == "endbfchar":
                self.letters |= {number(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes)}
            elif value == "endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        many = range(number(a), min(number(b), number(a) + 65_535) + 1)
                        start = text(c)
                        self.letters |= {n: text(c[k]) for k, n in enumerate(many) if k < len(c)} if isinstance(c, list) else {n: start[:-1] + chr(ord(start[-1]) + k) for k, n in enumerate(many) if start and ord(start[-1]) + k < 0x110000}
            held = []

    def read(self, raw: bytes) -> list[tuple[str, float, bool]]:
        """(letters, width, whether it is the single-byte space)."""
        codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2)] if self.two else list(raw)
        plain = lambda c: "" if self.two else bytes([c]).decode("cp1252", "ignore")
        return [(self.letters.get(c) or plain(c), self.width.get(c, self.usual), c == 32 and not self.two) for c in codes]


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def runs(file: File, page: dict) -> list[tuple[float, float, float, float, str]]:
    """(x, end, baseline, size, text) of what a page shows, in the order of its content."""
    contents = file.of(page.get("Contents"))
    parts = [file.of(p) for p in contents] if isinstance(contents, list) else [contents]
    resources = file.of(page.get("Resources"))
    fonts: dict[str, Font] = {}
    declared = file.of(resources.get("Font")) if isinstance(resources, dict) else None
    for name, font in (declared if isinstance(declared, dict) else {}).items():
        if isinstance(font := file.of(font), dict):
            fonts[name] = Font(file, font)
    out: list[tuple[float, float, float, float, str]] = []
    space, stack = _ONE, []
    line = at = _ONE
    state = {"font": None, "size": 1.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}

    def show(raw: object) -> None:
        nonlocal at
        if not isinstance(raw, bytes) or state["font"] is None:
            return
        text, moved, wide = [], 0.0, state["Tz"] / 100
        for letters, width, blank in state["font"].read(raw):
            text.append(letters)
            moved += (width / 1000 * state["size"] + state["Tc"] + (state["Tw"] if blank else 0)) * wide
        start = _times((1, 0, 0, 1, 0, state["Ts"]), _times(at, space))
        at = _times((1, 0, 0, 1, moved, 0), at)
        end = _times(at, space)
        size = state["size"] * (start[2] ** 2 + start[3] ** 2) ** 0.5
        if "".join(text):
            out.append((start[4], end[4], start[5], size or 1.0, "".join(text)))

    def step(x: float, y: float) -> None:
        nonlocal line, at
        line = at = _times((1, 0, 0, 1, x, y), line)

    held: list = []
    for value, _ in values(b"\n".join(file.bytes_of(p) for p in parts if isinstance(p, Stream))):
        if not isinstance(value, Operator):
            held.append(value)
            continue
        n = [v for v in held if isinstance(v, (int, float)) and not isinstance(v, bool)]
        if value == "q":
            stack.append(space)
        elif value == "Q" and stack:
            space = stack.pop()
        elif value == "cm" and len(n) == 6:
            space = _times(tuple(n), space)
        elif value == "BT":
            line = at = _ONE
        elif value == "Tf" and held and n:
            state |= {"font": fonts.get(held[0]) if isinstance(held[0], str) else None, "size": float(n[-1])}
        elif value in ("Tc", "Tw", "Tz", "TL", "Ts") and n:
            state[value] = float(n[0])
        elif value in ("Td", "TD") and len(n) == 2:
            if value == "TD":
                state["TL"] = -n[1]
            step(*n)
        elif value == "Tm" and len(n) == 6:
            line = at = tuple(map(float, n))
        elif value == "T*":
            step(0, -state["TL"])
        elif value == "Tj" and held:
            show(held[-1])
        elif value in ("'", '"') and held:
            if value == '"' and len(n) >= 2:
                state |= {"Tw": float(n[0]), "Tc": float(n[1])}
            step(0, -state["TL"])
            show(held[-1])
        elif value == "TJ" and held and isinstance(held[-1], list):
            for item in held[-1]:
                if isinstance(item, (int, float)):
                    at = _times((1, 0, 0, 1, -item / 1000 * state["size"] * state["Tz"] / 100, 0), at)
                else:
                    show(item)
        held = []
    return out


Block = tuple[int, int, float, float, float, float, str, float, float]


def read(content: bytes) -> tuple[int, list[Block]]:
    """Number of pages, and (page, seq, x0, y0, x1, y1, text, page width, page height),
    y counted from the top. Runs on one baseline that follow each other closely are
    one block, with a space where a gap is wide enough for one."""
    file = File(content)
    pages = file.pages()
    blocks: list[Block] = []
    for nr, page in enumerate(pages, 1):
        box = [v for v in map(file.of, file.of(page.get("MediaBox")) or []) if isinstance(v, (int, float))]
        left, low, right, high = box if len(box) == 4 else (0, 0, 612, 792)
        rows: list[list] = []
        for x, end, y, size, text in runs(file, page):
            last = rows[-1] if rows else None
            if last and abs(last[2] - y) <= 0.3 * size and -0.5 * size <= x - last[1] <= 1.5 * size:
                gap = x - last[1] > 0.2 * size and not last[4].endswith(" ") and not text.startswith(" ")
                last[1], last[3], last[4] = max(last[1], end), max(last[3], size), last[4] + " " * gap + text
            else:
                rows.append([x, end, y, size, text])
        for x, end, y, size, text in rows:
            if text.strip():
                blocks.append((nr, len(blocks), x - left, high - y - 0.8 * size, end - left, high - y + 0.2 * size, text, float(right - left), float(high - low)))
    return len(pages), blocks


Reader = Callable[[bytes], tuple[int, list[Block]]]
SCHEMA = "sha string, seq int, page int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double, pages int, error string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def pdf_blocks(files: DataFrame, reader: Reader = read) -> DataFrame:
    """The blocks of (sha, content), page by page. A file that can't be read, is locked or
    has no text has one row with its code in `error` (or no text), so that none is lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sha, content in zip(batch["sha"], batch["content"], strict=True):
                try:
                    pages, found = reader(bytes(content))
                    rows += [(sha, seq, page, *box, text, width, height, pages, None) for page, seq, *box, text, width, height in found]
                    if not found:
                        rows.append((sha, None, None, *[None] * 7, pages, None))
                except Refused as e:
                    rows.append((sha, None, None, *[None] * 7, None, str(e)))
                except Exception:  # a damaged file is a row, not the end of the job
                    rows.append((sha, None, None, *[None] * 7, None, "corrupt_file"))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"seq": "Int32", "page": "Int32", "pages": "Int32"})

    return files.select("sha", "content").mapInPandas(run, SCHEMA)


def verdicts(blocks: DataFrame) -> DataFrame:
    """(sha, code): the code that a file is refused with, by how it opened and by its
    text layer, or null. Pictures aren't seen: a file without text counts as scanned."""
    from tallyproof.operators import geometry as G

    text = F.coalesce("text", F.lit(""))
    of = blocks.groupBy("sha").agg(F.max("error").alias("error"), F.max("pages").alias("pages"), F.sum(G.visible_count(text)).alias("visible"), F.sum(G.odd_count(text)).alias("odd"))
    opened = G.open_guard(F.col("error").isNull() | (F.col("error") == "password_protected"), F.col("error").eqNullSafe("password_protected"), F.col("pages"))
    held = G.text_guard(F.col("pages"), F.lit(False), F.lit(False), F.col("visible"), F.col("odd"))
    return of.select("sha", F.coalesce(F.when(F.col("error") == "file_too_large", F.col("error")), opened, held).alias("code"))
