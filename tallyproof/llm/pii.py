"""Personal data by weak supervision.

Exact rules find the base spans, which always stay. Beside them, looser patterns
propose candidates; regex, gazetteer, context, shape and boundary labellers vote
on each candidate (base spans included), expectation-maximisation over the vote
patterns of each kind estimates how reliable each labeller is, and the
posteriors train a linear classifier on hashed features of the span, its
neighbours and the votes. Candidates that the classifier accepts, and that touch
no base span, are added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import arrow_limits, buffers, written
from tallyproof.llm.weak import fit_linear, reliabilities

KINDS = ("email", "ip", "card", "phone")
DIMS = 1 << 12
LABELLERS = 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AFTER_LOCAL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """From @ to @: the local part is the longest run before it that no earlier
    match holds. Linear also where no domain follows."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _AFTER_LOCAL.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Dotted runs of digits, four parts at a time; linear in the run."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    out += [(1, a, b) for a, b in ips(text)]
    out += [(2, a, b) for a, b in cards(text)]
    if "+" in text:
        out += [(3, a, b) for a, b in phones(text)]
    return out


# ---- candidates and labellers

_LOOSE = (
    re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}){1,5}", re.I),
    re.compile(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b|\b(?:[0-9a-f]{1,4}:){4,7}[0-9a-f]{1,4}\b", re.I),
    re.compile(r"\b[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{3,7}\b|\b3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5}\b"),
    re.compile(r"(?:\+|\b00)?[0-9]{0,3}[ .-]?(?:\([0-9]{2,4}\)|\b[0-9]{2,4})[ ./-][0-9]{3,4}[ .-][0-9]{3,4}\b"),
)
_STRICT = (
    re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)*(?:\.| ?[\[(]dot[\])] ?)[A-Za-z]{2,12}", re.I),
    re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}|(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", re.I),
    re.compile(r"[0-9]{4}([ -]?)(?:[0-9]{4}\1){2}[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5}"),
    re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
)
@dataclass(frozen=True)
class Gazetteer:
    """What the gazetteer labeller knows; give another to add to it.

    `endings`: endings of domains beside the country codes, which are all pairs of
    letters. `issuers`: ranges (low, high) of the openings of card numbers, compared
    over as many digits as `low` has. `unassigned`: openings of international
    telephone numbers that no country or zone holds.
    """

    # The original generic endings and the older sponsored ones.
    endings: frozenset[str] = frozenset("com org net edu gov mil int arpa info biz name pro aero coop museum mobi jobs travel asia cat tel post app dev".split())
    # Ranges of issuer numbers of the large card networks.
    issuers: tuple[tuple[str, str], ...] = (("2221", "2720"), ("300", "305"), ("34", "34"), ("3528", "3589"), ("36", "39"), ("4", "4"), ("50", "59"), ("6011", "6011"), ("62", "62"), ("63", "69"), ("81", "81"))
    # Spare codes of the international numbering plan.
    unassigned: tuple[str, ...] = ("0", "210", "214", "215", "217", "219", "28", "384", "83", "89", "999")

    def ending(self, word: str) -> bool:
        return word in self.endings or (len(word) == 2 and word.isalpha())

    def issuer(self, digits: str) -> bool:
        return any(low <= digits[: len(low)] <= high for low, high in self.issuers)

    def country(self, digits: str) -> bool:
        return not digits.startswith(self.unassigned)


GAZETTEER = Gazetteer()
_CUES = (
    re.compile(r"e-?mail|contact|write|mail|courriel|correo|kontakt|reach|@", re.I),
    re.compile(r"\bip\b|address|server|host|client|login|adresse", re.I),
    re.compile(r"card|visa|master|credit|amex|carte|karte|tarjeta|payment", re.I),
    re.compile(r"phone|call|tel|mobile|cell|fax|dial|telefon|tél|numéro|número", re.I),
)
_COUNTER_CUES = re.compile(r"version|licen[sc]e|isbn|issn|order|page|chapter|section|serial|invoice|§|\bv\.?$|\bno\.?$|#$|€|\$|id[:= ]*$", re.I)


@dataclass
class Candidate:
    kind: int
    start: int
    end: int
    base: bool
    votes: str = ""
    at: list[int] = field(default_factory=list)


def _vote(flag: bool | None) -> str:
    return "0" if flag is None else "+" if flag else "-"


def _label(text: str, c: Candidate, known_values: Gazetteer) -> None:
    span, left, right = text[c.start : c.end], text[max(0, c.start - 40) : c.start], text[c.end : c.end + 12]
    digits = _digits(span)
    regex = bool(_STRICT[c.kind].fullmatch(span)) and (c.kind != 2 or luhn(digits))
    if c.kind == 0:
        known = known_values.ending(re.split(r"[^A-Za-z]+", span[-80:].lower().rstrip(")]"))[-1]) or None
        shape = len(span) <= 80
    elif c.kind == 1:
        known = None if ":" in span else not span.startswith("0.")
        shape = True if ":" in span else None if len(set(span.split("."))) < 2 else True
    elif c.kind == 2:
        known = known_values.issuer(digits)
        shape = len(set(digits)) > 3 and 13 <= len(digits) <= 19
    else:
        known = known_values.country(digits.removeprefix("00") if span.startswith("00") else digits) if span.startswith(("+", "00")) else None
        shape = 9 <= len(digits) <= 15 and len(set(digits)) > 2
    cue = True if _CUES[c.kind].search(left) else False if _COUNTER_CUES.search(left) else None
    near = (left[-1:] or " ") + (right[:1] or " ")
    boundary = not (near[0].isalnum() or near[0] in "_/=-" or near[1].isalnum() or near[1] in "_/=")
    c.votes = "".join(map(_vote, (regex, known, cue, shape, boundary)))
    form = re.sub(r"([a9])\1+", r"\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", span)))
    words = re.findall(r"[^\W\d_]+", left.lower())
    names = [f"k{c.kind}", *(f"k{c.kind}v{j}{v}" for j, v in enumerate(c.votes)), f"k{c.kind}f{form}", f"k{c.kind}n{len(digits)}", f"k{c.kind}l{min(len(span) // 4, 12)}", f"w{words[-1] if words else ''}", f"b{near}"]
    c.at = sorted({zlib.crc32(n.encode()) % DIMS for n in names})


_WRITTEN_AT = re.compile(r"@|[\[(]at[\])]", re.I)


class _Taken:
    """Stretches of a text that don't overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Takes the stretch, if it touches none that is taken."""
        k = bisect_left(self.starts, b)
        if k and self.ends[k - 1] > a:
            return False
        self.starts.insert(k, a)
        self.ends.insert(k, b)
        return True


def candidates(text: str, base: list[tuple[int, int, int]], gazetteer: Gazetteer = GAZETTEER) -> list[Candidate]:
    """Base spans, and loose matches that touch none of them; earlier kinds first.

    A loose address has at most 64 letters before the at-sign (the longest that mail
    allows) and five labels behind the first; what is longer is found by the base
    rule, if it is written with a plain at-sign.
    """
    out = [Candidate(k, a, b, True) for k, a, b in base]
    taken = _Taken([(a, b) for _, a, b in base])
    for kind, pattern in enumerate(_LOOSE):
        if kind == 0 and not _WRITTEN_AT.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            while a < b and text[a] in " .-":
                a += 1
            if kind == 2 and not luhn(_digits(m.group())):  # a number that fails its checksum is none
                continue
            if kind == 1 and ":" not in m.group() and any(int(v) > 255 for v in m.group().split(".")):
                continue
            if taken.add(a, b):
                out.append(Candidate(kind, a, b, False))
    for c in out:
        _label(text, c, gazetteer)
    return out


_NEEDLES = np.zeros(256, bool)
_NEEDLES[48:58] = True
_NEEDLES[ord("@")] = True


def _maybe(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Rows that can hold anything: a digit, an @, or a written-out at-sign."""
    total = np.concatenate([[0], np.cumsum(_NEEDLES[data], dtype=np.int64)])
    found = total[offsets[1:]] > total[offsets[:-1]]
    import pyarrow.compute as pc

    for needle in ("[at]", "(at)"):
        found |= pc.fill_null(pc.match_substring(texts, needle, ignore_case=True), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(found)


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("at", pa.list_(pa.int32()))]))
SPAN = "array<struct<kind: int, start: bigint, end: bigint, base: boolean, votes: string, at: array<int>>>"


def _scan(gazetteer: Gazetteer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            spans: list[list] = [[]] * batch.num_rows
            for row in _maybe(*buffers(texts), texts).tolist():
                text = texts[row].as_py()
                spans[row] = [c.__dict__ for c in candidates(text, base_spans(text), gazetteer)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], ["id", "spans"])

    return run


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteer: Gazetteer = GAZETTEER) -> DataFrame:
    """(id, spans): the labelled candidates of each row."""
    arrow_limits(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan(gazetteer), f"id {kind}, spans {SPAN}")


@dataclass
class Model:
    posterior: dict[tuple[int, str], float]
    table: dict[int, np.ndarray]
    weights: np.ndarray

    def score(self, at: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[at].sum() + self.weights[-1], -50, 50))))


def fit(scanned: DataFrame, sample_rows: int = 20_000) -> Model:
    """Reliabilities from the vote patterns of all candidates (at most 4 x 3 ** 5
    counts reach the driver); the classifier from at most `sample_rows` candidates."""
    each = scanned.select(F.explode("spans").alias("s")).select("s.*")
    seen = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    posterior: dict[tuple[int, str], float] = {}
    table = {}
    for kind in range(len(KINDS)):
        own = sorted((r["votes"], r["n"]) for r in seen if r["kind"] == kind)
        post, table[kind], _ = reliabilities([p for p, _ in own], [n for _, n in own], start=(0.85, 0.85), strength=(20.0, 20.0))
        posterior |= {(kind, p): float(v) for (p, _), v in zip(own, post, strict=True)}
    total = max(1, sum(r["n"] for r in seen))
    least = int(min(1.0, sample_rows / total) * 1_000_000) + 1
    chosen = each.where(F.pmod(F.xxhash64("start", "end", "at", F.lit(5)), F.lit(1_000_000)) < least).groupBy("kind", "votes", "at", "base").agg(F.count("*").alias("n"))
    drawn = chosen.orderBy(F.xxhash64("kind", "votes", "at", "base"), "kind", "votes", "at", "base").limit(2 * sample_rows).collect()
    drawn.sort(key=lambda r: (r["kind"], r["votes"], r["at"], r["base"]))
    target = [max(posterior[r["kind"], r["votes"]], 0.99 if r["base"] else 0.0) for r in drawn]
    weights = fit_linear([r["at"] for r in drawn], [[1.0] * len(r["at"]) for r in drawn], target, [float(r["n"]) for r in drawn], DIMS)
    return Model(posterior, table, weights)


def _final(spans: list[dict], model: Model, threshold: float) -> list[tuple[int, int, int]]:
    return sorted((s["kind"], s["start"], s["end"]) for s in spans if s["base"] or model.score(s["at"]) >= threshold)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, gazetteer: Gazetteer = GAZETTEER) -> DataFrame:
    """A row for each row: id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (base and added ones, kind:start:end in code points, by kind
    and start), n_added.

    A null or empty text has none. Null and repeated ids and repeated rows pass
    through. An empty table gives an empty one; other columns are not looked at.
    """
    scanned = written(scan(df, id_col, text_col, gazetteer), "spans")
    model = fit(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, text, added = [], [], [], []
            for spans in batch.column("spans").to_pylist():
                base = sorted((s["kind"], s["start"], s["end"]) for s in spans if s["base"])
                every = _final(spans, model, threshold)
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                text.append(joined(every))
                added.append(len(every) - len(base))
            by = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *by, pa.array(sha, pa.string()), pa.array(text, pa.string()), pa.array(added, pa.int64())], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = df.schema[id_col].dataType.simpleString()
    out = scanned.mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in angle brackets; overlapping ones together."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = 0.5, gazetteer: Gazetteer = GAZETTEER) -> DataFrame:
    """The rows of `df` with personal data replaced; `length_col`, where the table
    has it, gets the new length of the texts that changed. Null and empty texts stay,
    null and repeated ids and repeated rows pass through, and an empty table gives an
    empty one.

    Candidates are found once for the fit and again here: they depend on the text
    alone, and finding them costs less than writing all texts beside them or joining
    them back to the texts.
    """
    model = fit(written(scan(df.select(F.lit(0).alias("row"), F.col(text_col).alias("text")), "row", "text", gazetteer).where(F.size("spans") > 0), "spans"))
    at = df.columns.index(text_col)
    size = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            new: dict[int, str] = {}
            for row in _maybe(*buffers(texts), texts).tolist():
                text = texts[row].as_py()
                found = [c.__dict__ for c in candidates(text, base_spans(text), gazetteer)]
                if found and (spans := _final(found, model, threshold)):
                    new[row] = redacted(text, spans)
            if new:
                columns = list(batch.columns)
                plain = texts.to_pylist()
                columns[at] = pa.array([new.get(k, v) for k, v in enumerate(plain)], texts.type)
                if size is not None:
                    old = columns[size].to_pylist()
                    columns[size] = pa.array([len(new[k]) if k in new else v for k, v in enumerate(old)], columns[size].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return df.mapInArrow(run, df.schema)
