import random

from pyspark.sql import functions as F

from tallyproof.functions import fuzzy
from tallyproof.operators import coverage as C, verify as V
from tallyproof.schema import CLAIMS

LINES = "doc_id long, no int, text string, unjoined array<string>"


def judge(spark, lines, claims):
    rows = [(1, i, t, u) for i, (t, u) in enumerate(lines, 1)]
    made = [(1, k, f"p.{k}", "span", t, cited) for k, (t, cited) in enumerate(claims)]
    df, cl = spark.createDataFrame(rows, LINES), spark.createDataFrame(made, CLAIMS)
    judged = V.verify(cl, df)
    return df, cl, judged


def flags(spark, lines, *claims):
    lines = [x if isinstance(x, tuple) else (x, []) for x in lines]
    return [r["flag"] for r in judge(spark, lines, claims)[2].orderBy("claim_id").collect()]


def test_verdicts(spark):
    line = "Built the billing pipeline."
    assert flags(spark, [line], (line, [1]), ("Managed a team of twelve", [1]), (line, [99]), (line, []), (line, [1, 99])) == ["ok", "hallucinated", "hallucinated", "hallucinated", "hallucinated"]
    assert flags(spark, ["the team’s “payments” — shipped"], ('the team\'s "payments" - shipped', [1])) == ["ok"]
    assert flags(spark, ["first half of it", "second half"], ("first half of it second half", [1, 2]), ("second half", [1])) == ["ok", "hallucinated"]
    assert flags(spark, [("a high-throughput pipeline", ["a high-through-", "put pipeline"])], ("a high-through- put pipeline", [1])) == ["ok"]
    assert flags(spark, ["Senior Infrastructure Engineer, digital", "JavaScript and TypeScript"], ("IT", [1]), ("Java", [2])) == ["hallucinated", "hallucinated"]
    contact = "jane@x.com | 555 | Arlington, VA | link"
    assert flags(spark, [contact], ("jane@x.com", [1]), ("Arlington, VA", [1]), ("Reduced costs by forty percent", [1])) == ["ok", "ok", "hallucinated"]
    long_ = "Built and ran the billing pipeline for all of the retail clients"
    assert flags(spark, [long_], (long_.replace("billing", "bolling"), [1]), ("Worked on billing.", [1]), ("", [1])) == ["ok", "hallucinated", "hallucinated"]


def test_flags(spark):
    _, _, judged = judge(spark, [("one line of text", [])], [("invented words here", [1]), ("invented words here", [1]), ("x", [99]), ("y", [])])
    got = sorted((r["no"], r["reason"]) for r in V.flags(judged).collect())
    assert got == [(0, "hallucinated_span"), (1, "hallucinated_span"), (1, "hallucinated_span"), (99, "source_line_out_of_range")]


def test_bare_fields(spark):
    lines = spark.createDataFrame([(1, 1, "Halcyon Systems", []), (1, 2, "Engineer", []), (1, 3, "Built things", [])], LINES)
    fields = spark.createDataFrame(
        [(1, "experience.0", "company", "Northlight", [1, 2, 3]), (1, "experience.0", "title", "Engineer", [1, 2, 3]), (1, "experience.1", "company", "abc", [1])],
        "doc_id long, object_path string, field string, value string, source_lines array<int>",
    )
    bad, borne = V.bare_fields(fields, lines)
    assert [tuple(r) for r in bad.collect()] == [(1, 1, "unsourced_company")]
    assert [tuple(r) for r in borne.collect()] == [(1, 2)]


def report(spark, texts, claims, dropped=None):
    lines, cl, judged = judge(spark, [(t, []) for t in texts], claims)
    gone = spark.createDataFrame(dropped, "doc_id long, no int") if dropped else None
    states = C.line_states(lines, C.claimed_lines(judged), C.represented_lines(judged), gone)
    return C.report(states, V.flags(judged)).first(), C.gutter(states, V.flags(judged))


def test_coverage(spark):
    r, _ = report(spark, ["Name here", "", "HEADING", " "], [("Name here", [1]), ("HEADING", [3])])
    assert (r["total_lines"], r["non_blank_lines"], r["coverage_pct"], r["unassigned"]) == (4, 2, 100.0, [])
    r, _ = report(spark, ["aaaa", "bbbb", "cccc"], [("aaaa", [1]), ("cccc", [3])])
    assert (r["unassigned"], r["coverage_pct"]) == ([2], 66.67)
    r, _ = report(spark, ["aaaa", "bbbb"], [("aaaa", [1])], [(1, 2)])
    assert (r["non_blank_lines"], r["coverage_pct"]) == (1, 100.0)
    r, g = report(spark, ["aaaa", "bbbb"], [("invented thing", [1])])
    assert r["coverage_pct"] == 50.0 and r["represented_pct"] == 0.0 and [tuple(x) for x in r["flagged"]] == [(1, "hallucinated_span")]
    assert [x["state"] for x in g.orderBy("no").collect()] == ["flag", "unassigned"]


def test_mutations(spark):
    texts = [f"line number {i} of the text" for i in range(1, 9)]
    whole = [(t, [i]) for i, t in enumerate(texts, 1)]
    full, _ = report(spark, texts, whole)
    assert full["coverage_pct"] == full["represented_pct"] == 100.0
    fewer, _ = report(spark, texts, whole[:5])
    assert fewer["coverage_pct"] < 100
    emptied, _ = report(spark, texts, [("made up entirely", [i]) for i in range(1, 9)])
    assert emptied["coverage_pct"] == 100.0 and emptied["represented_pct"] == 0.0


def test_one_judged_table(spark):
    """Claims and plain fields in one relation say of each line what they say apart."""
    texts = ["Halcyon Systems", "Engineer", "", "Built things there", "nobody's line"]
    lines, cl, judged = judge(spark, [(t, []) for t in texts], [("Built things there", [4]), ("invented words here", [4, 9]), ("a claim of nothing", []), ("Halcyon", [1, 1]), (None, [2])])
    fields = spark.createDataFrame(
        [(1, "experience.0", "company", "Northlight", [1, 2]), (1, "experience.0", "title", "Engineer", [1, 2, 2]), (1, "experience.1", "company", "abc", [1]), (1, "x", "name", "Halcyon Systems", [99])],
        "doc_id long, object_path string, field string, value string, source_lines array<int>",
    )
    unsourced, borne = V.bare_fields(fields, lines)
    states = C.line_states(lines, C.claimed_lines(judged).unionByName(borne), C.represented_lines(judged).unionByName(borne))
    flagged = V.flags(judged).unionByName(unsourced)
    rows = C.accounts(lines, V.marks(V.judge(cl, fields, lines)))
    want, got = C.report(states, flagged).first().asDict(), C.account_report(rows).first().asDict()
    assert got == want and (0, "hallucinated_span") in map(tuple, got["flagged"]) and (99, "unsourced_name") in map(tuple, got["flagged"])
    by = lambda df: sorted(map(tuple, df.collect()))
    assert by(C.account_gutter(rows)) == by(C.gutter(states, flagged))
    gone = spark.createDataFrame([(1, 5)], "doc_id long, no int")
    assert C.account_report(C.accounts(lines, V.marks(V.judge(cl, fields, lines)), gone)).first()["non_blank_lines"] == 3


def test_verdicts_with_and_without_figures(spark):
    """What is told without the UDF, or from pieces that stand whole, is what the figure says."""
    rnd = random.Random(5)
    pairs = []
    for n in range(600):
        text = "".join(rnd.choice("abcde fgh") for _ in range(rnd.choice([3, 9, 11, 12, 18, 19, 20, 27, 38, 57, 120])))
        a = rnd.randrange(len(text))
        claim = list(text if n % 3 else text[a : a + rnd.randrange(1, 60)])
        for _ in range(rnd.randrange(0, 2 + len(claim) // 15)):
            i = rnd.randrange(len(claim) + 1)
            claim[i : i + rnd.randrange(2)] = rnd.choice(["", "x", "é", "ß"] if n % 2 else ["", "x"])
        pairs.append((text, "".join(claim)))
    cut = lambda i, t: [] if i % 4 else [t[: len(t) // 2] + "-", t[len(t) // 2 :]]
    lines = spark.createDataFrame([(1, i, t, cut(i, t)) for i, (t, _) in enumerate(pairs, 1)], LINES)
    pairs = [(t, " ".join(cut(i, t)) if i % 8 == 0 else c) for i, (t, c) in enumerate(pairs, 1)]
    claims = spark.createDataFrame([(1, i, f"p.{i}", "span", c, [i, 1 + i % 600] if i % 12 == 0 else [i]) for i, (_, c) in enumerate(pairs, 1)], CLAIMS)
    whole, quick = ({r["claim_id"]: r["verified"] for r in V.verify(claims, lines, verdicts_only=x).collect()} for x in (False, True))
    assert whole == quick and len(whole) == 600 and 100 < sum(whole.values()) < 550


def test_what_stands_in_its_line_is_told_before_any_key_is_made(spark, monkeypatch):
    """In any script; only the rest reaches the similarity, which says 7 here."""
    monkeypatch.setattr(V, "claim_score", lambda claim, *_: F.when(claim.isNotNull(), 7.0))
    texts = ["Größe für Ufer", "naïve — déjà vu 12", "Привет 2024 мир", "abc é", "wörd"]
    lines = spark.createDataFrame([(1, i, t, []) for i, t in enumerate(texts, 1)], LINES)
    said = [("für Ufer", [1], 100), ("déjà vu 12", [2, 1], 100), ("Привет 2024 мир", [3], 100), ("r Ufer", [1], 7), ("abc é", [4], 7), ("wörd", [5], 7), ("vu 12 Größe", [2, 1], 100), ("Größe", [9], 0)]
    claims = spark.createDataFrame([(1, i, f"p.{i}", "span", c, no) for i, (c, no, _) in enumerate(said)], CLAIMS)
    got = {r["claim_id"]: r["score"] for r in V.verify(claims, lines, verdicts_only=True).collect()}
    assert got == {i: float(s) for i, (_, _, s) in enumerate(said)}


def test_likeness_of_long_texts_takes_little(monkeypatch):
    """Letters are counted for windows that can win only, and what both begin and end with isn't compared."""
    seen = []
    monkeypatch.setattr(fuzzy, "common", lambda masks, m, b, real=fuzzy.common: seen.append(m * len(b)) or real(masks, m, b))
    text = "".join(chr(97 + i * i % 23) for i in range(1_500))
    assert round(fuzzy.ratio(text[:700] + "§" + text[701:], text), 6) == round(100 - 100 / 1_500, 6) and sum(seen) < 10
    monkeypatch.setattr(fuzzy, "_most_in_common", None)
    assert round(fuzzy.partial_ratio(text[:700] + "§" + text[701:], text, 99.9), 6) == round(100 - 100 / 1_500, 6)
