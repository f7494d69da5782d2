import io
import itertools
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyproof.operators import claims as K, jobs as J, overrides as O, roles as R, survey
from tallyproof.schema import ROLES
from tallyproof.sources import docx, files

KV = "sha string, path string, value string"


def test_patch_keeps_empty_edits(spark):
    values = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2")], KV)
    edits = spark.createDataFrame([("a", "x", "")], KV)
    got = {r["path"]: (r["value"], r["edited"]) for r in O.patch(values, edits, ["sha", "path"]).collect()}
    assert got == {"x": ("", True), "y": ("2", False)}


def test_carry(spark):
    kv = "path string, value string"
    edits = spark.createDataFrame([("summary", "kept"), ("skills.4.name", "no such place"), ("projects.1.name", "value moved on"), ("education.0.degree", "was null")], kv)
    old = spark.createDataFrame([("summary", "s"), ("projects.1.name", "Tidal map"), ("education.0.degree", None)], kv)
    new = spark.createDataFrame([("summary", "s"), ("projects.1.name", "River map"), ("education.0.degree", None)], kv)
    got = sorted(tuple(r) for r in O.carry(edits, new, old, new, ["path"]).collect())
    assert got == [("education.0.degree", "was null"), ("summary", "kept")]


def test_orphans_and_upsert(spark):
    stored = spark.createDataFrame([("a",), ("b",)], "sha string")
    named = spark.createDataFrame([("a",), (None,)], "sha string")
    assert [r["sha"] for r in O.orphans(stored, named).collect()] == ["b"]
    old = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 1, "z"), (3, 0, "w")], "k int, at int, v string")
    assert {r["k"]: r["v"] for r in O.upsert(old, new, ["k"], "at").collect()} == {1: "z", 2: "y", 3: "w"}


def test_slugs(spark):
    df = spark.createDataFrame([(1, "ali"), (2, "ali"), (3, "ali")], "i int, s string")
    assert [r["person_id"] for r in O.numbered_slugs(df, "s", ["i"]).orderBy("i").collect()] == ["ali", "ali-2", "ali-3"]


def test_profiles(spark):
    rows = [("a", ""), ("b", "{not json"), ("c", "[]"), ("d", "null"), ("e", '{"answers": {"gender": ["Male"]}}'), ("f", '{"version": 1, "display_name": "F", "eeo": null}'), ("g", None)]
    got = {r["person_id"]: (r["display_name"], r["n_answers"]) for r in O.profile_rows(spark.createDataFrame(rows, "person_id string, content string")).collect()}
    assert got == {"a": ("", 0), "b": ("", 0), "c": ("", 0), "d": ("", 0), "e": ("", 1), "f": ("F", 0), "g": ("", 0)}


def test_roles(spark):
    chain = [(1, 1, None, 0, "A", "t1"), (1, 2, 1, 0, "B", "t2"), (1, 3, 2, 0, "C", "t3")]
    got = R.promote(spark.createDataFrame(chain, ROLES)).orderBy("new_ord").collect()
    assert [(r["company"], r["new_parent"]) for r in got] == [("A", None), ("B", None), ("C", None)]
    same = [(1, 1, None, 0, "Acme", "t1"), (1, 2, 1, 0, "ACME ", "t2"), (1, 3, 2, 0, "acme", "t3")]
    assert [r["new_parent"] for r in R.promote(spark.createDataFrame(same, ROLES)).orderBy("role_id").collect()] == [None, 1, 2]
    flat = R.flatten(spark.createDataFrame(same, ROLES)).orderBy("position").collect()
    assert [(r["depth"], r["parse_path"]) for r in flat] == [(0, "experience.0"), (1, "experience.0.sub_roles.0"), (2, "experience.0.sub_roles.0.sub_roles.0")]


def test_deep_roles(spark):
    """Deeper than any fixed number of levels, and positions beyond six digits."""
    n = 70
    chain = [(1, i, i - 1 if i else None, 2_000_000 if i == 1 else 0, "A", f"t{i}") for i in range(n)] + [(1, 900, 0, 3, "A", "small"), (1, 901, 902, 0, "A", "ring"), (1, 902, 901, 0, "A", "ring"), (1, 903, 77_777, 0, "A", "orphan")]
    roles = spark.createDataFrame(chain, ROLES)
    flat = R.flatten(roles).orderBy("position").collect()
    assert len(flat) == n + 1 and flat[1]["title"] == "small" and flat[-1]["depth"] == n - 1
    assert flat[2]["parse_path"] == "experience.0.sub_roles.2000000"
    assert sorted(r["role_id"] for r in R.unreached(roles).collect()) == [901, 902, 903]
    with pytest.raises(ValueError):
        R.walk(spark.createDataFrame([(1, 1, None, 0, "A", "t"), (1, 2, 1, 0, "A", "t"), (1, 1, 2, 0, "A", "t")], ROLES))


def test_people(spark):
    people = spark.createDataFrame([("eva", "Eva", "s1"), ("eva-2", "Eva", "s2"), ("lin-2", "Lin 2", None)], "person_id string, display_name string, active_sha string")
    names = spark.createDataFrame([(1, "Éva"), (2, "Lin 2"), (3, "eva"), (4, "?!"), (5, "Lin")], "ord int, display_name string")
    got = {(r["display_name"]): r["person_id"] for r in O.create_people(people, names).collect()}
    assert got == {"Éva": "eva-3", "eva": "eva-4", "Lin 2": "lin-2-2", "Lin": "lin", "?!": None}
    edits = spark.createDataFrame([("eva-2", "s3"), ("eva", "s2")], "person_id string, sha string")
    stored = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "sha string")
    left, orphaned = O.delete_person(people, "eva", edits, stored)
    assert sorted(r["person_id"] for r in left.collect()) == ["eva-2", "lin-2"] and sorted(r["sha"] for r in orphaned.collect()) == ["s1", "s4"]
    point = lambda *ids: spark.createDataFrame([(i,) for i in ids], "person_id string")
    assert O.active_person(point("eva"), left).count() == 0 and O.active_person(point("eva-2"), left).first()[0] == "eva-2" and O.active_person(point("../x", None), left).count() == 0


def test_many_people_of_one_name(spark):
    """Ids as if people were made one after another, names that collide with numbered ones included."""
    rnd = random.Random(3)
    held = {"lin", "lin-3", "lin-4", "lin-9", "lin-02", "lin-1", "ada-2", "x-" + "9" * 30}
    said = [rnd.choice(["Lin", "Lin 2", "Ada", "lin", "Lin-12", "Bo", "?", "Lin 2 2"]) for _ in range(300)] + ["Sam"] * 3_000
    want, taken = {}, set(held)
    for i, name in enumerate(said):
        base = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")
        tried = (base if k == 1 else f"{base}-{k}" for k in itertools.count(1))
        want[i] = next(t for t in tried if t not in taken) if base else None
        taken.add(want[i])
    names = spark.createDataFrame([(f"{n}", i) for i, n in enumerate(said)], "display_name string, ord long").repartition(5)
    got = sorted((r["person_id"] or "", r["display_name"]) for r in O.create_people(spark.createDataFrame([(h,) for h in held], "person_id string"), names).collect())
    assert len({g for g, _ in got if g}) == sum(1 for w in want.values() if w)
    assert got == sorted((want[i] or "", n) for i, n in enumerate(said))


def test_ranks_and_subsets(spark):
    rows = [(k, None if k is None else i % 3, i) for k in ("a", "b", None) for i in range(200)]
    got = O.ranked_within(spark.createDataFrame(rows, "g string, h int, i int"), ["g", "h"], ["i"]).collect()
    by = {}
    for g, h, i in rows:
        by.setdefault((g, h), []).append(i)
    assert len(got) == 600 and all(by[r["g"], r["h"]][r["position"] - 1] == r["i"] for r in got)
    own = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (3, None), (3, None)], "o int, i string")
    may = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "c"), (3, None), (4, "d")], "o int, i string")
    assert sorted(map(tuple, O.uncontained(own, may, ["o"], ["i"]).collect())) == [(1, 3, 1), (2, 1, 0), (3, 2, 1)]
    assert O.uncontained(own.limit(0), may, ["o"], ["i"]).count() == 0


@pytest.mark.parametrize("broken", [None, "written", "compared", "placed", "pointed"])
def test_migration(spark, tmp_path, broken):
    """Wherever it breaks off, the old file stands until all else does, and a rerun ends it."""
    old, store = tmp_path / "profile.json", str(tmp_path / "store")
    text = '{"answers": {"gender": ["Male"], "veteran": ["No"]}}'
    old.write_text(text)
    if broken:
        with pytest.raises(InterruptedError):
            O.migrate(spark, str(old), store, stop_after=broken)
        assert old.read_text() == text
    assert O.migrate(spark, str(old), store) == "moved" and not old.exists() and (tmp_path / "profile.json.migrated").read_text() == text
    moved = O.profile_rows(spark.read.parquet(f"{store}/people/default")).first()
    assert (moved["person_id"], moved["display_name"], moved["n_answers"]) == ("default", "Me", 2)
    assert spark.read.parquet(f"{store}/active").first()[0] == "default"
    assert O.migrate(spark, str(old), store) == "nothing"


def test_migration_that_must_not(spark, tmp_path):
    old, store = tmp_path / "p.json", tmp_path / "store"
    old.write_text("{broken")
    assert O.migrate(spark, str(old), str(store)) == "unreadable" and old.exists() and not store.exists()
    (store / "people" / "eva").mkdir(parents=True)
    old.write_text('{"answers": {}}')
    assert O.migrate(spark, str(old), str(store)) == "kept" and old.exists()


def test_old_layout(spark):
    old = lambda text: spark.createDataFrame([(text,)], "content string")
    nobody = spark.createDataFrame([], "person_id string")
    got = O.lifted(old('{"answers": {"gender": ["Male"]}}'), nobody).collect()
    assert [(r["person_id"], r["display_name"], r["n_answers"]) for r in got] == [("default", "Me", 1)]
    assert O.lifted(old("{broken"), nobody).count() == 0
    assert O.lifted(old('{"answers": {}}'), spark.createDataFrame([("eva",)], "person_id string")).count() == 0


def test_survey(spark):
    rows = [("p", "gender", "Robot"), ("p", "veteran", "Yes"), ("p", "veteran", "No"), ("p", "nope", "Yes"), ("q", "sexual_orientation", "Gay"), ("q", "sexual_orientation", "Queer"), ("r", "race", "Prefer not to say")]
    answers = spark.createDataFrame(rows, "person_id string, question string, option string")
    got = sorted(tuple(r) for r in survey.violations(answers, survey.domain(spark)).collect())
    assert got == [("p", "gender", "unknown_option"), ("p", "nope", "unknown_question"), ("p", "veteran", "several_answers")]
    people = spark.createDataFrame([("q",), ("r",), ("s",)], "person_id string")
    assert {r["person_id"]: r["state"] for r in survey.states(people, answers).collect()} == {"q": "answered", "r": "declined", "s": "never_asked"}


SOUND = json.dumps({"contact": {}, "awards": [{"text": "Prize of the harbour", "source_lines": [3]}]})


@pytest.mark.parametrize("fence", ["{}", "```json\n{}\n```", "```\n{}\n```", "  {}\n"])
@pytest.mark.parametrize("bad", [[], ["[1, 2"], [""], ['{"contact": {"phones": [{"e164": "+1"}]}}'], ["{}", "null"]])
def test_structuring(fence, bad):
    """Bad answers are asked for again, with what was wrong; then the good one counts."""
    source = K.TableProvider([*bad, fence.replace("{}", SOUND)])
    got, status, attempts, _ = K.structure("start", source)
    assert (json.loads(got), status, attempts) == (json.loads(SOUND), "ok", len(bad) + 1)
    for k, messages in enumerate(source.seen):
        assert messages[0] == "start" and len(messages) == 1 + 2 * k
        assert k == 0 or (messages[-2] == bad[k - 1] and "failed" in messages[-1])


def test_structuring_gives_up():
    assert K.structure("start", K.TableProvider(["{}"] * 9))[1:3] == ("validation_failed", K.RETRIES + 1)
    assert K.structure("start", K.TableProvider([SOUND], cut=True))[:3] == (None, "response_truncated", 1)


def test_providers():
    with pytest.raises(K.ProviderError, match="unknown_provider"):
        K.provider("nobody")
    K.register("table", lambda: K.TableProvider([SOUND]))
    assert K.structure("p", K.provider("table"))[1] == "ok"


def test_resolution(monkeypatch):
    K.register("one", lambda model="": ("one", model))
    assert K.provider("one", "m") == K.provider("one:m") == ("one", "m")
    monkeypatch.setenv("CLAIM_PROVIDER", "one")
    monkeypatch.setenv("CLAIM_MODEL", "big")
    assert K.resolved() == ("one", "big") and K.resolved(None, "small") == ("one", "small") and K.resolved("one:x") == ("one", "x")


@pytest.mark.parametrize(
    ("form", "answer", "cut", "url"),
    [
        ("chat", {"choices": [{"message": {"content": SOUND}, "finish_reason": "stop"}], "usage": {"completion_tokens": 9, "completion_tokens_details": {"reasoning_tokens": 4}}}, {"choices": [{"message": {"content": "{"}, "finish_reason": "length"}]}, "http://h/v1/chat/completions"),
        ("messages", {"content": [{"type": "text", "text": SOUND}], "usage": {"output_tokens": 9}}, {"content": [{"text": "{"}], "stop_reason": "max_tokens"}, "http://h/v1/messages"),
        ("local", {"message": {"content": SOUND}, "eval_count": 9}, {"message": {"content": "{"}, "done_reason": "length"}, "http://h/v1/api/chat"),
    ],
)
def test_forms(form, answer, cut, url):
    seen = []

    def send(to, headers, body, timeout):
        seen.append((to, headers, json.loads(body)))
        return json.dumps(answer).encode()

    source = K.http_provider(form, "http://h/v1/", key="k", send=send)(model="m")
    assert K.structure("start", source)[1] == "ok" and source.used[0] == 9
    assert seen[0][0] == url and seen[0][2]["model"] == "m" and seen[0][2]["messages"] == [{"role": "user", "content": "start"}]
    assert K.structure("start", K.http_provider(form, "http://h", send=lambda *_: json.dumps(cut).encode())())[1] == "response_truncated"
    assert K.structure("start", K.http_provider(form, "http://h", send=lambda *_: b"{}")())[1] == "provider_failed"

    def slow(*_):
        raise TimeoutError

    assert K.structure("start", K.http_provider(form, "http://h", send=slow)())[1] == "provider_timeout"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
DOC = f"""<w:document {W}><w:body><w:p><w:r><w:t>Heading</w:t></w:r></w:p>
<w:p><w:r><mc:AlternateContent><mc:Choice><w:p><w:r><w:t>In a box</w:t></w:r></w:p></mc:Choice><mc:Fallback><w:p><w:r><w:t>In a box</w:t></w:r></w:p></mc:Fallback></mc:AlternateContent></w:r></w:p>
<w:p><w:pPr><w:numPr/></w:pPr><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:tab/><w:t>end</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Skill</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Years</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
HEAD = f"<w:hdr {W}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>"


def test_docx(spark):
    raw = zipped(word__document_xml=DOC, word__header1_xml=HEAD)
    df = spark.createDataFrame([("s", bytearray(raw)), ("t", bytearray(b"PK\x03\x04broken"))], "sha string, content binary")
    got = docx.docx_blocks(df).orderBy("sha", "seq").collect()
    assert [(r["zone"], r["text"], r["from_table"], r["is_bullet"]) for r in got if r["sha"] == "s"] == [
        ("header", "top", False, False), ("body", "Heading", False, False), ("body", "In a box", False, False), ("body", "kept\tend", False, True), ("body", "Skill", True, False), ("body", "Years", True, False),
    ]
    assert [r["error"] for r in got if r["sha"] == "t"] == ["corrupt_file"]


def test_classify(spark, tmp_path):
    long_ = b"plain words that go on and on until there are more than fifty of them"
    cases = {
        "a.pdf": (b"%PDF-1.4 x", None), "b.doc": (b"\xd0\xcf\x11\xe0rest", "unsupported_format"), "c.rtf": (b"{\\rtf1 hello", "unsupported_format"), "d.txt": (long_, None), "e.MD": (long_, None),
        "f.txt": (b"short", "empty_document"), "g.txt": (b"", "empty_document"), "h.bin": (b"\xff\xfe\x00" * 40, "unsupported_format"), "i.odt": (zipped(mimetype="x"), "unsupported_format"), "j.pdf": (zipped(word__document_xml=DOC), None),
    }
    for name, (raw, _) in cases.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / ".hidden").write_bytes(b"x")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "empty.txt").write_bytes(b"")
    assert files.scan(spark, str(tmp_path), recursive=True).count() == len(cases) + 1
    got = {r["name"]: (r["kind"], r["reject_code"]) for r in files.classify(files.scan(spark, str(tmp_path))).collect()}
    assert {n: c for n, (_, c) in got.items()} == {n: c for n, (_, c) in cases.items()}
    assert got["a.pdf"][0] == "pdf" and got["d.txt"][0] == "txt" and got["e.MD"][0] == "md" and got["j.pdf"][0] == "docx"


def test_stored_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "sha string, n int")
    files.save(df, str(tmp_path / "t"))
    assert [r["n"] for r in files.cached(spark, str(tmp_path / "t"), "b").collect()] == [2]
    files.save_json(df, str(tmp_path / "j"))
    assert spark.read.schema("sha string, n int").json(str(tmp_path / "j")).count() == 2


def test_keyed_folders(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "sha string, n int")
    files.save_keyed(rows(("a", 1), ("b", 2)), str(tmp_path / "k"))
    files.save_keyed(rows(("b", 3), ("b", 4), ("c", 5)), str(tmp_path / "k"))
    assert sorted(tuple(r) for r in files.load_keyed(spark, str(tmp_path / "k")).collect()) == [("a", 1), ("b", 3), ("b", 4), ("c", 5)]
    assert [tuple(r) for r in files.load_keyed(spark, str(tmp_path / "k"), "a").collect()] == [("a", 1)]


def test_sorted_copies(spark, tmp_path):
    text = b"plain words that go on and on until there are more than fifty of them"
    up = files.received(spark, [("x/one.txt", text), ("C:\\y\\one.txt", text + b"!"), ("z/one.txt", text), ("two.md", text), ("no.bin", b"\xff\xfe\x00" * 40)])
    assert sorted(r["name"] for r in up.collect()) == ["no.bin", "one.txt", "one.txt", "one.txt", "two.md"]
    done = files.copy_sorted(spark, files.classify(up), str(tmp_path / "sorted"))
    assert done.count() == 4
    assert sorted(str(p.relative_to(tmp_path / "sorted")) for p in (tmp_path / "sorted").rglob("*.*")) == ["md/two.md", "txt/one-2.txt", "txt/one-3.txt", "txt/one.txt"]
    assert (tmp_path / "sorted/txt/one.txt").read_bytes() == text + b"!"


def test_docx_that_inflates_too_much(monkeypatch):
    raw = zipped(word__document_xml=DOC)
    assert docx.blocks(raw)
    monkeypatch.setattr(docx, "MAX_INFLATED", 100)
    assert docx.blocks(raw) is None


def test_near_job_keys(spark):
    import itertools
    import random

    rng, titles = random.Random(4), []
    for _ in range(40):
        words = rng.sample("senior data platform engineer backend python lead analyst cloud security remote".split(), rng.randint(1, 5))
        for _ in range(3):
            own = list(words)
            rng.shuffle(own)
            t = list(" ".join(own))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice("abcx")
            titles.append((rng.choice(("Acme", "acme ", "Other")), "".join(t)))
    df = spark.createDataFrame([(i, c, t, i) for i, (c, t) in enumerate(titles)], "job_id long, company string, title string, salary int").withColumn("key", J.dedupe_key(F.col("company"), F.col("title")))
    keys = sorted({(r["company"].strip().lower(), r["key"]) for r in df.collect()})
    up = {k: k for _, k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for (c, a), (d, b) in itertools.combinations(keys, 2):
        if c == d and J.token_ratio(a.replace("|", " "), b.replace("|", " ")) >= 92:
            up[max(top(a), top(b))] = min(top(a), top(b))
    assert {r["key"]: r["of"] for r in J.near_keys(df).collect()} == {k: top(k) for k in up}
    assert any(top(k) != k for k in up)
    got = {r["job_id"]: r["duplicate_of"] for r in J.near_duplicates(df, ["salary"]).collect()}
    group = {}
    for r in df.collect():
        group.setdefault(top(r["key"]), []).append(r["job_id"])
    assert got == {i: None if i == min(ids) else min(ids) for ids in group.values() for i in ids}


def test_titles_that_share_a_word_do_not_all_meet(spark):
    """Three thousand titles of one company, all with one word: what meets is bounded by what is alike."""
    import random

    rng = random.Random(2)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(1500)]
    titles = [f"engineer {w}" for w in own] + [f"engineer {w[:7]}x{w[8:]}" for w in own]
    strings = spark.createDataFrame([("acme", " ".join(sorted(f"acme {t}".split()))) for t in titles], "co string, s string")
    met = {(r["a"], r["b"]) for r in J.near_candidates(strings).collect()}
    assert len(met) < 20 * len(titles)  # all pairs would be 4.5 million
    want = {tuple(sorted(" ".join(sorted(f"acme {t}".split())) for t in pair)) for pair in zip(titles[:1500], titles[1500:], strict=True)}
    assert {p for p in want if p[0] != p[1]} <= met


def test_components_of_long_chains(spark):
    links = [(f"k{i:03}", f"k{i + 1:03}") for i in range(150)] + [("x3", "x1"), ("x1", "x2"), ("y", "y"), ("z9", "k100")]
    got = {r["key"]: r["of"] for r in J.smallest_reached(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"k{i:03}": "k000" for i in range(151)} | {"x1": "x1", "x2": "x1", "x3": "x1", "z9": "k000"}
    assert J.smallest_reached(spark.createDataFrame([], "a string, b string")).count() == 0


def test_jobs(spark):
    rows = [(1, "ACME", "Dev (m/f)", None, "x"), (2, "acme", "DEV", 5, "x"), (3, "other", "Dev", 1, None)]
    df = spark.createDataFrame(rows, "job_id long, company string, title string, salary int, place string").withColumn("key", J.dedupe_key(F.col("company"), F.col("title")))
    dup = J.duplicates(df, ["salary", "place"])
    assert {r["job_id"]: r["duplicate_of"] for r in dup.collect()} == {1: 2, 2: None, 3: None}
    led = J.ledger(dup, [("filtered_global", "duplicate", F.col("duplicate_of").isNotNull()), ("filtered_person", "low", F.col("salary") < 3)])
    assert {r["job_id"]: r["bucket"] for r in led.collect()} == {1: "filtered_global", 2: "shown", 3: "filtered_person"}
    assert led.groupBy("bucket").count().agg(F.sum("count")).first()[0] == 3
    texts = spark.createDataFrame([("<p>a&amp;b</p>\n <b>c</b>",)], "h string")
    assert texts.select(J.plain(F.col("h"))).first()[0] == "a&b c"


def test_ranges_hold_no_more_rows_as_tables_grow(spark, monkeypatch):
    from tallyproof.operators import overrides

    monkeypatch.setattr(overrides, "RANGE_ROWS", 100)
    rows = spark.range(0, 3_000).selectExpr("id % 2 AS g", "(id * 7919) % 3000 AS at")
    ranked = overrides.ranked_within(rows, ["g"], ["at"])
    assert ranked.rdd.getNumPartitions() >= 30
    got = sorted((r.g, r["at"], r.position) for r in ranked.collect())
    want = {g: sorted(n for k in range(3_000) if k % 2 == g for n in [(k * 7919) % 3_000]) for g in (0, 1)}
    assert got == [(g, n, i) for g in (0, 1) for i, n in enumerate(want[g], 1)]
