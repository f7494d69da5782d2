import itertools

import pytest
from pyspark.sql import functions as F

from tallyproof.functions import fuzzy, links, values
from tallyproof.functions import text as T


def column(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r["o"] for r in df.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


DISPLAY = [
    ("proﬁle workﬂow staﬀ oﬃce", "profile workflow staff office", False),
    ("Speciali­sation", "Specialisation", False),
    ("the team’s “payments” — shipped", "the team’s “payments” — shipped", False),
    (" Built the thing", "Built the thing", True),
    (" jane@example.com", "jane@example.com", False),
    (" +1 415 555 0199", "+1 415 555 0199", False),
    ("- Built the thing", "Built the thing", True),
    ("• Shipped it", "Shipped it", True),
    ("  - indented", "- indented", False),
    ("• 2016 - 2018 Acme", "2016 - 2018 Acme", False),
    ("the teamâ€™s work", "the team’s work", False),
    ("jane​.morgan﻿@x.com", "jane.morgan@x.com", False),
    ("a senior title", "a senior title", False),
    ("", "", False),
]


def test_display(spark):
    got = column(spark, [d[0] for d in DISPLAY], T.display)
    assert [(g["text"], g["is_bullet"]) for g in got] == [d[1:] for d in DISPLAY]


def test_match_key(spark):
    rows = ["the team’s “payments” — shipped", "Straße  Été", None, "wait…"]
    assert column(spark, rows, T.match_key) == ['the team\'s "payments" - shipped', "strasse ete", None, "wait..."]


def test_script(spark):
    assert column(spark, ["مرحبا", "张伟 x", "Latin", "a 张 م"], T.script) == ["rtl", "cjk", "latin", "cjk"]


def test_predicates(spark):
    rows = ["EDUCATION", "Education", "A" * 40, "12"]
    assert column(spark, rows, T.is_heading) == [True, False, False, False]
    assert column(spark, ["S U M M A R Y", "a b c", "plain words here now"], T.is_letterspaced) == [True, False, False]
    assert column(spark, ["x" * 16, "short words"], T.is_run_on) == [True, False]
    assert column(spark, ["ali", "a-b-2", "../x", "..", "", None, "Alice", "а", "a/b", "a\n"], T.valid_id) == [True, True] + [False] * 8
    assert column(spark, ["Élan Vital!", "...", "a--b"], T.slug) == ["elan-vital", "", "a-b"]
    assert column(spark, ['```json\n{"a": 1}\n```', "```x```", " plain "], T.without_fence) == ['{"a": 1}', "x", "plain"]
    assert column(spark, ["Page 2 of 3"], T.digit_mask) == ["Page # of #"]


def test_contains_word(spark):
    df = spark.createDataFrame(
        [("digital", "it"), ("Miami, FL | x", "Miami, FL"), ("javascript and typescript", "java"), ("cafés", "caf"), ("a \\E b", "\\E"), ("x.y", "x.y")], "h string, n string"
    )
    assert [r[0] for r in df.select(T.contains_word(F.col("h"), F.col("n"))).collect()] == [False, True, False, False, True, True]


def test_links(spark):
    rows = [
        ("https://github.com/a", "", "GitHub"), ("linkedin.com/in/x", "", "LinkedIn"), ("play.google.com/store", "", "Google Play"), ("scholar.google.com/c", "", "Google Scholar"),
        ("bit.ly/1", "LinkedIn: bit.ly/1", "LinkedIn"), ("bit.ly/2", "Portfolio: bit.ly/2", "Portfolio"), ("https://me.example", "", "Website"), ("bit.ly/3", None, "Link"), ("nothing", "", "Link"),
    ]
    df = spark.createDataFrame(rows, "t string, c string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", links.link_label(F.col("t"), F.col("c")).alias("got")).collect())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def brute_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    pairs = [(a, b)] + ([(b, a)] if len(a) == len(b) else [])
    return max(200.0 * lcs(s, w) / (len(s) + len(w)) for s, t in pairs for i in range(1 - len(s), len(t)) if (w := t[max(i, 0) : i + len(s)]))


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("billing", "Built the billing pipeline."), ("abc", "xbz"), ("aab", "baa"), ("q", "zzq"), ("abcabc", "cab"), ("hello", "hello")])
def test_fuzzy(a, b):
    assert fuzzy.ratio(a, b) == pytest.approx(200.0 * lcs(a, b) / (len(a) + len(b)))
    assert fuzzy.partial_ratio(a, b) == pytest.approx(brute_partial(a, b))


def test_typo():
    line = "Built and ran the billing pipeline for all of the retail clients"
    assert fuzzy.ratio(line, line.replace("billing", "bolling")) > 95 > fuzzy.ratio(line, "Worked on billing.")


def test_span_lookup_misses_nothing(spark):
    """Of items and lines of few letters, with letters taken out, put in and changed, all pairs of 95 or more."""
    import random

    from tallyproof.operators.spans import fuzzy_spans

    rnd, seen = random.Random(7), 0
    for ab in ["ab", "aeionst ", "abcdefghijklmnopqrstuvwxyzé "]:
        some = lambda n: "".join(rnd.choice(ab) for _ in range(n))  # noqa: B023, E731
        items = [some(n) for n in (1, 3, 9, 12, 20, 45, 80, 120)]
        cut = []
        for k in items * 3:
            k = list(k)
            for _ in range(rnd.randrange(len(k) // 10 + 2)):
                i = rnd.randrange(len(k) + 1)
                k[i : i + rnd.randrange(2)] = rnd.choice(["", *ab])
            k = "".join(k)
            i = rnd.choice([0, 0, rnd.randrange(len(k) + 1)])
            cut.append(rnd.choice(["", some(30)]) + k[i : i + rnd.choice([40, 200])] + rnd.choice(["", some(30), some(300)]))
        docs = list(enumerate(sorted({"", *cut})))
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in fuzzy_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
        want = {}
        for (t, x), (k, y) in itertools.product(docs, enumerate(items)):
            key, item = T.match_key_of(x), T.match_key_of(y)
            if key and item and (len(x) >= 12 or len(key) >= len(item)):
                a, b = sorted((item, key), key=len)
                pairs = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
                windows = [(u, w) for u, v in pairs for i in range(1 - len(u), len(v)) if (w := v[max(i, 0) : i + len(u)]) and 2 * len(w) * 100 >= 95 * (len(u) + len(w))]
                score = max((round(200.0 * fuzzy.common(fuzzy._masks(u), len(u), w) / (len(u) + len(w)), 4) for u, w in windows), default=0)
                if score >= 95:
                    want[t, k] = score
        assert got == want
        seen += len(want)
    assert seen > 50


def test_runs_and_pieces_of_long_lines(spark):
    """Runs of every place, also over the ends of stretches, and pieces side by side."""
    from tallyproof.operators import spans

    keys = ["x", "abcdefghi", "é" * 263 + "ab", "".join(chr(97 + i * i % 26) for i in range(1000)), "ab\ncd" * 300, "\U0001f600b" * 200]
    rows = spark.createDataFrame([(i, k, len(k)) for i, k in enumerate(keys)], "row long, k string, m int")
    hashed = {r["p"]: r["h"] for r in spark.createDataFrame([(p, len(p)) for k in keys for q in range(1, 10) for p in {k[i : i + q] for i in range(len(k) - q + 1)}], "p string, q int").select("p", F.xxhash64("q", "p").alias("h")).collect()}
    got = sorted((r["row"], r["at"], r["h"]) for r in spans.runs(rows, "row", [1, 4, 9]).collect())
    assert got == sorted((i, at, hashed[k[at : at + q]]) for i, k in enumerate(keys) for q in (1, 4, 9) for at in range(len(k) - q + 1))
    cut = {}
    for r in spans.pieces(rows, "row").collect():
        cut.setdefault(r["row"], []).append((r["offset"], r["h"]))
    for i, k in enumerate(keys):
        n = int(2 * len(k) * (1.000001 - 0.95)) + 1
        q = min(len(k) // n, 9)
        assert sorted(cut[i]) == [(j * q, hashed[k[j * q : (j + 1) * q]]) for j in range(n)]


def test_fuzzy_spans(spark):
    """Case, accents and the wording of the first words may differ; short items and lines."""
    from tallyproof.operators import spans

    long = "The quick brown fox jumps over the lazy dog near the river bank on a warm day"
    items = [(1, long), (2, "Año de ración única por la mañana en la casa azul del río"), (3, "to be"), (4, None), (5, ""), (6, "Zeta"), (6, "Zeta"), (7, "a wholly other sentence that is in no document whatever")]
    docs = [
        (1, long.upper()), (2, "first\n\nsee: " + long.replace("The quick", "A quick") + ", so"), (3, "Ano de racion unica por la manana en la casa azul del rio"), (4, "jumps over the lazy dog"), (5, "lazy dog"),
        (None, long), (6, "zeta"), (6, "zeta"), (7, "TO BE"), (8, None), (9, ""), (10, "             "), (11, "nothing of that kind here\r\nzet"),
    ]
    got = spans.fuzzy_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for (d, text), (i, item) in itertools.product(docs, items):
        for no, line in enumerate((text or "").splitlines(), 1):
            k, key = T.match_key_of(item or ""), T.match_key_of(line)
            if k and key and (len(line) >= 12 or len(key) >= len(k)) and (score := brute_partial(k, key)) >= 95:
                want.append((d, i, no, round(score, 4)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {(1, 1), (2, 1), (3, 2), (4, 1), (None, 1), (6, 6), (7, 3)} == {(r["doc_id"], r["item_id"]) for r in got}


def test_short_items(spark, tmp_path):
    """Items of no, one and two words in documents of any length."""
    from tallyproof.plans import claims

    docs = [(1, "zeta"), (2, "alpha zeta, beta"), (3, "zetas alpha beta"), (4, "alpha beta gamma delta"), (5, "a *** b"), (6, None), (7, ""), (8, "beta")]
    items = [(1, "zeta"), (2, "alpha beta"), (3, "***"), (4, "alpha beta gamma"), (5, "beta"), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, claims.span_exact_containment(spark, str(tmp_path)).collect()))
    assert got == [(1, 1), (2, 1), (2, 5), (3, 2), (3, 5), (4, 2), (4, 4), (4, 5), (5, 3), (8, 5)]


def test_values(spark):
    df = spark.createDataFrame([("Summer 2019", None, None, None), ("x", 2020, 3, None), ("x", 2020, None, None), ("now", None, None, True), (None, None, None, None)], "raw string, y int, m int, p boolean")
    got = [r[0] for r in df.select(values.when_text(*(F.col(c) for c in ("raw", "y", "m", "p")))).collect()]
    assert got == ["Summer 2019", "2020-03", "2020", "Present", ""]
    ranges = spark.createDataFrame([("2019", "2020"), ("", "2020"), ("2019", ""), ("", "")], "a string, b string")
    assert [r[0] for r in ranges.select(values.range_text(F.col("a"), F.col("b"))).collect()] == ["2019 – 2020", "2020", "2019", ""]
    nums = spark.createDataFrame([(2, 3), (0, 0), (1, 32)], "a int, b int")
    assert [r[0] for r in nums.select(values.percent(F.col("a"), F.col("b"))).collect()] == [66.67, 100.0, 3.12]
    colors = spark.createDataFrame([(0xFFFFFF,), (0xF7F7F7,), (0xF6FFFF,), (0,)], "c int")
    assert [r[0] for r in colors.select(values.near_white(F.col("c"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize("encoding", ["cp1252", "cp1251", "mac_roman", "cp437", "cp1250"])
def test_misread_text(encoding):
    """UTF-8 read as another code page, also twice over, comes back; sound text stays."""
    for text in ("Größe für Ufer — déjà vu", "Привет, мир", "naïve “quotes” and €"):
        if encoding == "cp1251" and "П" not in text:
            continue  # two Cyrillic letters alone may be sound
        try:
            once = text.encode().decode(encoding)
            assert T.repair(once) == text, once
            assert T.repair(once.encode().decode("cp1252")) == text
        except UnicodeDecodeError:
            continue  # bytes that the code page leaves open
        assert T.repair(text) == text


def test_sound_text_stays():
    for text in ("Рёв, Сыр и Россия", "√2 × 3", "Ää Öö Üü", "Ângela Ã", "São Paulo: €5", "ΓΔ"):
        assert T.repair(text) == text


def test_decomposed_display_against_python(spark):
    """The display form of all lines of the smallest tables, worked out by other means."""
    import re
    import unicodedata

    from tallyproof.plans.lines import display_decomposed, document_lines

    data = "/root/testdata/sf0.001"
    raw = {(r["doc_id"], r["no"]): r["text"] for r in document_lines(spark, data).collect()}
    got = {(r["doc_id"], r["no"]): (r["shown"], r["is_bullet"]) for r in display_decomposed(spark, data).collect()}
    assert raw.keys() == got.keys()
    for place, text in raw.items():
        fixed = T.repair(text)
        glyph = unicodedata.category(fixed.lstrip()[:1] or "x") == "Co"
        kept = unicodedata.normalize("NFKD", "".join(c for c in fixed if unicodedata.category(c) != "Co" and c not in "​‌‍﻿⁠­"))
        rest = re.sub(r"^[•·◦▪‣∙⁃▸►−*‐\-–—]+\s+", "", kept)
        contact = re.match(r"\s*(?:[^@\s]+@[^@\s]+\.\w+|\+?[\d()][\d\s()./-]{6,}|(?:https?://|www\.)\S+|(?:linkedin|github|gitlab|twitter|x)\.com/\S+)", rest, re.I)
        assert got[place] == (re.sub("[ \t  -   　]+", " ", rest).strip(), bool((rest != kept or glyph) and not contact)), text


def test_fuzzy_spans_against_all_pairs(spark):
    """Every item against every line by the plain ratio: items in capitals, with letters
    changed at either end, within longer lines, and lines within items."""
    import random

    from tallyproof.operators.spans import fuzzy_spans

    rng = random.Random(6)
    items = [" ".join("".join(rng.choices("abcdeéfgh", k=rng.randint(2, 9))) for _ in range(rng.choice((1, 2, 3, 8, 14)))) for _ in range(30)]
    lines = []
    for item in items:
        t = list(item)
        for _ in range(rng.randrange(3)):
            t[rng.choice((0, len(t) // 2, len(t) - 1))] = rng.choice("xyz")
        lines += [item.upper(), "".join(t), "before it " + "".join(t) + " and behind", item[: rng.randint(1, len(item))], item[rng.randrange(len(item)) :]]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::5])) for i in range(5)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["no"]) for r in fuzzy_spans(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = set()
    for d in range(5):
        for no, line in enumerate(lines[d::5], 1):
            for k, item in enumerate(items):
                a, b = T.match_key_of(line), T.match_key_of(item)
                if (len(line) >= 12 or len(a) >= len(b)) and round(brute_partial(a, b), 4) >= 95:
                    want.add((d, k, no))
    assert len(want) > 60 and got == want


def test_pieces_met_by_chance_go_no_further(spark):
    """A piece alone is no pair; with the one beside it whole, or one letter off on either side, it is."""
    from tallyproof.operators import spans

    k = "abcdefghijklmnopqrstuvwxyz0123456789" * 2 + "!$%&()*+,"
    table = lambda name, texts: spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], f"{name} long, k string, m int")
    own = spans.pieces(table("item", [k]), "item").withColumnRenamed("m", "mi")
    far = "=" * 90
    first, second = k[:9], k[9:18]
    lines = [
        far + first + far, far + first + second + far, far + first + second[:4] + "=" + second[4:] + far, far + first + second[:2] + second[3:] + far, far + first + "=" + second + far,
        far + second + far, far + first[:4] + "=" + first[4:] + second + far, first + second + far, second + far, far + first + second, k[1:9] + second + far, far + k[-9:] + far,
    ]
    rows = table("row", lines)
    got = {r["row"] for r in spans._meet(spans.runs(rows, "row", [9]), own, "mi <= m").collect()}
    # 81 letters are nine pieces: the last has none beside it
    assert got == {1, 2, 3, 4, 6, 7, 9, 10, 11}


def test_keys_go_by_runs():
    import random

    from tallyproof.functions import text as T

    random.seed(5)
    some = "ab \t\xa0 　ßäÄéÃ¤â€™œЃРІ​…½ﬁİ̇\x1c\n"
    for _ in range(5_000):
        t = "".join(random.choices(some, k=random.randint(0, 14))) + random.choice(["", "ä’é".encode().decode("mac_roman"), "äö".encode().decode("cp1252") * 9])
        assert T.match_key_of(t) == T._SPACE.sub(" ", T.repair(t).translate(T._KEYS)).strip().casefold()


def test_line_breaks(spark):
    from tallyproof.operators.lines import split_lines

    text = "a\r\n\r\nb\n\rc\r\rd\n\ne\x0b\nf \ng\x85h\x1ei\r\n"
    got = spark.createDataFrame([(text,)], "t string").select(split_lines(F.col("t"))).first()[0]
    assert got == ["a", "", "b", "", "c", "", "d", "", "e", "", "f", "", "g", "h", "i"]
