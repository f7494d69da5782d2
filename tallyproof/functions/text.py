"""Text: display form, matching key, predicates. Built-in functions, but for
Unicode decomposition, case folding and mojibake, which Spark doesn't have and
which go through Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code-point classes and patterns that results depend on (Java syntax).
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}\x{2060}]"
SOFT_HYPHEN = "­"
SPACES = r"[ \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"
BULLET = r"(?U)^[•·◦▪‣∙⁃▸►−*‐\-–—]+\s+"
CONTACT = r"(?iU)^\s*(?:[^@\s]+@[^@\s]+\.\w+|\+?[\d()][\d\s()./-]{6,}|(?:https?://|www\.)\S+|(?:linkedin|github|gitlab|twitter|x)\.com/\S+)"
RTL = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
LINE_BREAK = r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?"
FOLD_FROM = "‘’‚‛“”„–—‒−― "
FOLD_TO = "''''\"\"\"----- "

BLANK = r"^\p{IsWhite_Space}*$"

# ---- Unicode, in Arrow UDFs


#: Code pages that UTF-8 is read as by mistake, and the shortest run that is taken for such a mistake where it begins with one of the
#: frequent lead bytes (C2, C3, E2, F0). With other lead bytes, whose letters sound text has as well, and for Cyrillic, it takes four.
MISREAD = (("cp1252", 2), ("cp1251", 4), ("mac_roman", 2), ("cp437", 2), ("cp1250", 2))
_LEADS = {name: {bytes([b]).decode(name): least if b in (0xC2, 0xC3, 0xE2, 0xF0) else 4 for b in range(0xC2, 0xF5)} for name, least in MISREAD}
_MARKS = frozenset().union(*_LEADS.values())
_RUN = re.compile(r"[^\x00-\x7f]+")


def repair(text: str) -> str:
    """Undoes UTF-8 read as one of MISREAD, also twice over, in runs where that gives
    valid text; only where its marks are there. Quotes stay curled."""
    for _ in range(3):
        if text.isascii() or _MARKS.isdisjoint(text):
            return text
        was, text = text, _RUN.sub(_undo, text)
        if was == text:
            return text
    return text


def _undo(m: re.Match) -> str:
    return _known_run(m[0]) if len(m[0]) <= 16 else _sound_run(m[0])


def _sound_run(run: str) -> str:
    for name, leads in _LEADS.items():
        if len(run) < leads.get(run[0], len(run) + 1):
            continue
        raw = bytearray()
        try:
            for c in run:
                # bytes that the code page leaves open come through as control characters
                raw += bytes([ord(c)]) if 128 <= ord(c) < 160 else c.encode(name)
            return raw.decode("utf-8")
        except UnicodeError:
            continue
    return run


_known_run = lru_cache(maxsize=20_000)(_sound_run)


_DROP = re.compile("[-\U000f0000-\U000ffffd\U00100000-\U0010fffd​-‍﻿⁠­]")
_SPACE = re.compile("[ \t  -   　]+")
#: The same, but for single plain spaces, which stay as they are.
_ANY = _SPACE.pattern[1:-2]
_SPACED = re.compile(f"[{_ANY.replace(' ', '', 1)}][{_ANY}]*|[{_ANY}]{{2,}}")
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO) | {ord("…"): "..."}


class _Keys(dict):
    """What each character becomes in a key, worked out when it first comes. Decomposition
    goes by characters; only marks change places in it, and these are left out."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", _DROP.sub("", chr(code)).translate(_FOLD))
        self[code] = "".join(c for c in parts if not unicodedata.combining(c))
        return self[code]


_KEYS = _Keys()


def match_key_of(text: str) -> str:
    """The key that claims and lines are compared by; never shown."""
    if not text.isascii():
        text = _RUN.sub(_key_of_run, text)
    return _SPACED.sub(" ", text).strip().casefold()


def _run_key(run: str) -> str:
    return repair(run).translate(_KEYS)


_known_run_key = lru_cache(maxsize=20_000)(_run_key)


def _key_of_run(m: re.Match) -> str:
    """Repair and decomposition go by runs without ASCII, which come again if they are short."""
    return _known_run_key(m[0]) if len(m[0]) <= 16 else _run_key(m[0])


@F.pandas_udf(StringType())
def match_key(text: pd.Series) -> pd.Series:
    return text.map(match_key_of, na_action="ignore")


def folded_ascii(text: Column) -> Column:
    """The key of a text that is ASCII alone: `match_key` without leaving the JVM."""
    return F.lower(stripped(F.regexp_replace(text, r"[ \t]+", " ")))


@F.pandas_udf(StringType())
def mojibake(text: pd.Series) -> pd.Series:
    return text.map(repair, na_action="ignore")


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKD", t), na_action="ignore")


@F.pandas_udf(StringType())
def ascii_letters(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


# ---- display form


def _stripped(text: Column) -> Column:
    """Trims what Python's strip() trims."""
    return F.regexp_replace(text, r"^[\p{IsWhite_Space}\x1C-\x1F]+|[\p{IsWhite_Space}\x1C-\x1F]+$", "")


def stripped(text: Column) -> Column:
    return _stripped(text)


def without_marks(text: Column) -> Column:
    """Without private-use glyphs, zero-width characters and soft hyphens."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, PRIVATE_USE, ""), ZERO_WIDTH, ""), F.lit(SOFT_HYPHEN), F.lit(""))


def display(text: Column, decompose: bool = True) -> Column:
    """struct(text, is_bullet): repaired line text as it is shown. `decompose`
    False leaves out the two UDFs (for text known to be composed and sound)."""
    source = mojibake(text) if decompose else text
    glyph = F.regexp_like(source, F.lit(r"^[\p{IsWhite_Space}\x1C-\x1F]*" + PRIVATE_USE))
    plain = without_marks(source)
    plain = nfkd(plain) if decompose else plain
    marked = F.regexp_like(plain, F.lit(BULLET))
    rest = F.when(marked, F.regexp_replace(plain, BULLET, "")).otherwise(plain)
    contact = F.regexp_like(rest, F.lit(CONTACT))
    return F.struct(_stripped(F.regexp_replace(rest, SPACES, " ")).alias("text"), ((marked | glyph) & ~contact).alias("is_bullet"))


def script(text: Column) -> Column:
    """rtl or cjk by the first character of either range, else latin."""
    first = F.regexp_extract(text, f"({RTL}|{CJK})", 1)
    return F.when(first == "", "latin").when(F.regexp_like(first, F.lit(RTL)), "rtl").otherwise("cjk")


def digit_mask(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\d+", "#")


def ends_sentence(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"[.!?:;]\n?\z"))


def is_heading(text: Column) -> Column:
    """Has letters, none of them lower case, and is shorter than 40."""
    return F.regexp_like(text, F.lit(r"\p{L}")) & (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) < 40)


def is_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit(BLANK))


def contains_word(hay: Column, needle: Column) -> Column:
    """`needle` in `hay`, with no word character right before or behind it. The
    plain search comes first, so that few rows compile a pattern."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.contains(hay, needle) & F.regexp_like(hay, quoted)


def word_list(text: Column) -> Column:
    """What Python's split() gives."""
    return F.filter(F.split(text, r"[\p{IsWhite_Space}\x1C-\x1F]+"), lambda w: w != "")


def mean_word_length(text: Column) -> Column:
    words = word_list(text)
    total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return F.when(F.size(words) > 0, total / F.size(words)).otherwise(0.0)


def is_letterspaced(text: Column) -> Column:
    return (F.size(word_list(text)) >= 4) & (mean_word_length(text) <= 1.6)


def is_run_on(text: Column) -> Column:
    return mean_word_length(text) > 15


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, all else to single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_letters(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def valid_id(text: Column) -> Column:
    """Whether a text may name a person; null and empty may not."""
    return F.coalesce(F.regexp_like(text, F.lit(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z")), F.lit(False))


def without_fence(text: Column) -> Column:
    """Without a Markdown code fence around it."""
    return F.regexp_replace(_stripped(text), r"(?U)^\s*```(?:json)?\s*|\s*```\s*$", "")


def same_company(a: Column, b: Column) -> Column:
    return F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))


def spoken(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def joined_nonempty(sep: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), sep)


def numbered(no: Column, text: Column) -> Column:
    return F.concat(no.cast("string"), F.lit(": "), text)
