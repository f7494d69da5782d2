"""The tree that claims come in: its shape, checks, and how it is taken apart.

A payload nests contact, roles within roles, education, projects, skills and more;
wherever a node has `text` and `source_lines` it is a claim on those lines. Nesting
goes deeper than column functions can follow (MAX_DEPTH levels), so a tree is walked in
one pass over its JSON; everything after that is tables. An answer may be anything at
all: what can't be read says why, and ends nothing but itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyproof.functions.links import link_label
from tallyproof.operators.verify import cited_text
from tallyproof.schema import CHECKED_FIELDS, SKILL_CATEGORIES

#: Kinds of nodes. A field's type is a kind, text, int, bool, lines or a choice (a|b); `?` lets it be absent or
#: null, and a list in brackets may be absent.
# Names of fields and choices.
SHAPE: dict[str, dict[str, str]] = {
    "span": {"text": "text", "source_lines": "lines"},
    "date": {"raw": "text", "year": "int?", "month": "int?", "precision": "day|month|year|season|unknown?", "is_present": "bool?"},
    "phone": {"raw": "text", "e164": "text?", "source_lines": "lines?"},
    "contact": {"name": "span?", "name_confidence": "high|low?", "emails": "[span]", "phones": "[phone]", "links": "[span]", "location": "span?", "source_lines": "lines?"},
    "role": {"company": "text", "title": "text", "location": "text?", "start": "date", "end": "date", "employment_type": "full_time|contract|internship|freelance|unknown?", "bullets": "[span]", "sub_roles": "[role]", "source_lines": "lines"},
    "grade": {"raw": "text", "scale": "4.0|10|percent|uk_class|unknown?"},
    "education": {"institution": "text", "degree": "text?", "field": "text?", "location": "text?", "start": "date?", "end": "date?", "gpa": "grade?", "details": "[span]", "source_lines": "lines"},
    "skill": {"name": "text", "category": "|".join(SKILL_CATEGORIES), "source": "skills_section|inferred_from_experience|inferred_from_project", "evidence": "span?", "source_lines": "lines"},
    "project": {"name": "text", "description": "span?", "bullets": "[span]", "technologies": "[text]", "url": "text?", "start": "date?", "end": "date?", "source_lines": "lines"},
    "other": {"heading": "text", "lines": "[span]", "source_lines": "lines"},
    "payload": {"language": "text?", "contact": "contact", "summary": "span?", "experience": "[role]", "education": "[education]", "skills": "[skill]", "projects": "[project]", "certifications": "[span]", "publications": "[span]", "awards": "[span]", "languages": "[span]", "other_sections": "[other]"},
}
#: Levels of brackets up to which an answer is read, and the largest number that a line can have.
MAX_DEPTH, MAX_LINE = 400, (1 << 31) - 1
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{}]', re.S)
_LONE = re.compile("[\ud800-\udfff]")
_PLAIN = {"text": str, "int": int, "bool": bool}


def _too_deep(text: str) -> bool:
    """Whether brackets outside strings nest deeper than MAX_DEPTH."""
    level = 0
    for m in _BRACKETS.finditer(text):
        if m[0] in ("[", "{"):
            level += 1
            if level > MAX_DEPTH:
                return True
        elif m[0] in ("]", "}"):
            level -= 1
    return False


def _no_number(name: str) -> float:
    raise ValueError(f"{name} is no number of JSON")


def read(text: str) -> object:
    """The value of a JSON text. ValueError, and nothing else, for one that isn't sound:
    broken, deeper than MAX_DEPTH, with NaN or infinity, or with numbers of thousands of digits."""
    if _too_deep(text):
        raise ValueError(f"nested more than {MAX_DEPTH} levels deep")
    return json.loads(text, parse_constant=_no_number)


def sound(text: str) -> str:
    """Halves of surrogate pairs that stand alone become U+FFFD."""
    return text if text.isascii() else _LONE.sub("\ufffd", text)


def written_out(payload: object) -> str:
    """A payload as JSON that any reader takes; ValueError where a number has no form in it."""
    return sound(json.dumps(payload, ensure_ascii=False, allow_nan=False))


def _number(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def problem(payload: object) -> str:
    """What is wrong with a payload and where, or nothing. Fields beyond the shape are
    let pass. Depth is bounded by memory alone."""
    todo: list[tuple[object, str, str]] = [(payload, "payload", "")]
    while todo:
        value, kind, at = todo.pop()
        where = f"{at}: " if at else ""
        if kind.startswith("["):
            if not isinstance(value, list):
                return f"{where}a list is needed"
            todo += [(v, kind[1:-1], f"{at}.{k}") for k, v in reversed(list(enumerate(value)))]
        elif kind in SHAPE:
            if not isinstance(value, dict):
                return f"{where}an object is needed"
            inner = []
            for name, own in SHAPE[kind].items():
                below = f"{at}.{name}" if at else name
                missing = value.get(name) is None
                if missing and not own.endswith("?") and not (own.startswith("[") and name not in value):
                    return f"{below}: missing"
                if not missing:
                    inner.append((value[name], own.removesuffix("?"), below))
            todo += reversed(inner)
        elif kind == "lines":
            if not isinstance(value, list) or not all(map(_number, value)):
                return f"{where}a list of numbers is needed"
        elif kind in _PLAIN:
            if not isinstance(value, _PLAIN[kind]) or (kind == "int" and not _number(value)):
                return f"{where}{kind} is needed"
        elif value not in kind.split("|"):
            return f"{where}not one of {kind.replace('|', ', ')}"
    return ""


@F.pandas_udf(StringType())
def problem_in(payload: pd.Series) -> pd.Series:
    """`problem` of payloads in JSON; text that is none says so."""

    def one(text: str) -> str:
        try:
            return sound(problem(read(text)))
        except ValueError:
            return "no JSON"

    return payload.map(one, na_action="ignore")


def json_schema() -> dict:
    """The shape as a JSON schema."""

    def of(kind: str) -> dict:
        if kind.endswith("?"):
            return {"anyOf": [of(kind[:-1]), {"type": "null"}]}
        if kind.startswith("["):
            return {"type": "array", "items": of(kind[1:-1])}
        if kind in SHAPE:
            return {"$ref": f"#/$defs/{kind}"}
        if kind == "lines":
            return {"type": "array", "items": {"type": "integer"}}
        return {"type": {"text": "string", "int": "integer", "bool": "boolean"}[kind]} if kind in _PLAIN else {"enum": kind.split("|")}

    made = {kind: {"type": "object", "properties": {n: of(t) for n, t in fields.items()}, "required": [n for n, t in fields.items() if t[-1] not in "?]"]} for kind, fields in SHAPE.items()}
    return {"$ref": "#/$defs/payload", "$defs": made}


def _company(role: dict) -> str:
    return str(role.get("company") or "").strip().casefold()


def _roles(value: object) -> list[dict]:
    return [r for r in value if isinstance(r, dict)] if isinstance(value, list) else []


def promoted(roles: object) -> list[dict]:
    """Roles nested under one at another company go to the top level, in document order.
    What is no role is left out."""
    top: list[dict] = []
    todo: list[tuple[dict, dict | None]] = [(r, None) for r in reversed(_roles(roles))]
    while todo:
        role, above = todo.pop()
        own = {**role, "sub_roles": []}
        (top if above is None or _company(above) != _company(role) else above["sub_roles"]).append(own)
        todo += [(s, own) for s in reversed(_roles(role.get("sub_roles")))]
    return top


def _lines(cited: list) -> list[int]:
    """Numbers of lines as whole numbers of 32 bits. One beyond stays a line that no
    document has, and so does what is no number."""
    return [max(-MAX_LINE, min(MAX_LINE, n)) if _number(n) else -1 for n in cited]


def nodes(payload: dict) -> Iterator[tuple[str, str, str | None, str | None, list[int]]]:
    """(what, path, field, text, source_lines): a `span` for each claim, a `field` for
    each plain field that is held against its object's lines, an `object` for all
    other nodes that cite lines."""
    todo: list[tuple[str, object]] = [("", {**payload, "experience": promoted(payload.get("experience"))})]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            cited = node.get("source_lines")
            if isinstance(cited, list):
                cited = _lines(cited)
                if isinstance(node.get("text"), str):
                    yield "span", path, None, sound(node["text"]), cited
                    continue
                yield "object", path, None, None, cited
                yield from (("field", path, f, sound(node[f]), cited) for f in CHECKED_FIELDS if isinstance(node.get(f), str))
            inner = node.items()
        elif isinstance(node, list):
            inner = enumerate(node)
        else:
            continue
        todo += [(sound(f"{path}.{k}" if path else str(k)), v) for k, v in reversed(list(inner)) if isinstance(v, (dict, list))]


def taken_apart(parsed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, what, path, field, text, source_lines) of the payloads in `parsed`(doc, json).
    A payload that is null, can't be read or is no object gives no rows (`problem_in` says
    why); a line number beyond 32 bits becomes the largest one, which no document has."""

    def opened(text: str | None) -> dict:
        try:
            payload = read(text) if isinstance(text, str) else None
        except ValueError:
            return {}
        return payload if isinstance(payload, dict) else {}

    # rows by the hundred: a worker never holds the nodes of thousands of answers
    shape = "array<struct<what: string, path: string, field: string, text: string, source_lines: array<int>>>"
    walked = F.udf(lambda text: list(nodes(opened(text))), shape, useArrow=False).asNondeterministic()
    return parsed.select(doc, walked("json").alias("__nodes")).select(doc, F.explode("__nodes").alias("__node")).select(doc, "__node.*")


def claims(parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, claim_id, path, kind, text, source_lines) of what was taken apart."""
    return parts.where("what = 'span'").select(doc, F.xxhash64("path").alias("claim_id"), "path", F.lit("span").alias("kind"), "text", "source_lines")


def fields(parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, object_path, field, value, source_lines) of plain fields."""
    return parts.where("what = 'field'").select(doc, F.col("path").alias("object_path"), "field", F.col("text").alias("value"), "source_lines")


def is_link(path: Column) -> Column:
    return F.regexp_like(path, F.lit(r"^contact\.links\.\d+$"))


def labelled(made: DataFrame, lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The claims that are links, with the service that text or cited lines name."""
    links = made.where(is_link(F.col("path")))
    beside = cited_text(links, lines, [doc, "claim_id"], doc).select(doc, "claim_id", F.col("joined").alias("beside"))
    return links.join(beside, [doc, "claim_id"], "left").withColumn("label", link_label(F.col("text"), F.col("beside"))).drop("beside")
