import copy
import json

import pytest

from tallyproof.operators import claims as K, tree


def test_example_and_schema():
    assert tree.problem(K.EXAMPLE) == ""
    schema = tree.json_schema()
    assert set(schema["$defs"]) == set(tree.SHAPE) and schema["$defs"]["role"]["required"] == ["company", "title", "start", "end", "source_lines"]
    told = K.instructions()
    assert all(c in told for c in tree.SKILL_CATEGORIES) and json.dumps(K.EXAMPLE) in told and json.dumps(schema) in told


def places(node, path=()):
    """All places in a tree."""
    yield path
    for k, v in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
        yield from places(v, (*path, k))


def put(node, path, value):
    node = copy.deepcopy(node)
    at = node
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return node


def test_a_wrong_kind_anywhere_is_found():
    """A fraction, which may be nowhere, at every place of the example."""
    for path in places(K.EXAMPLE):
        if path:
            why = tree.problem(put(K.EXAMPLE, path, 3.5))
            assert why, path


def test_very_deep_roles():
    role = {"company": "A", "title": "t", "start": {"raw": ""}, "end": {"raw": ""}, "source_lines": [1], "bullets": [{"text": "b", "source_lines": [1]}]}
    for k in range(3000):
        role = {**role, "company": "AB"[k % 7 == 0], "sub_roles": [role]}
    payload = {"contact": {}, "experience": [role]}
    assert tree.problem(payload) == ""
    found = [n for n in tree.nodes(payload) if n[0] == "span"]
    assert len(found) == 3001
    role["sub_roles"][0]["sub_roles"][0]["title"] = 7
    assert tree.problem(payload) == "experience.0.sub_roles.0.sub_roles.0.title: text is needed"


@pytest.mark.parametrize("value", [True, "1", None, 1.0])
def test_line_numbers(value):
    assert tree.problem({"contact": {}, "summary": {"text": "t", "source_lines": [value]}}) == "summary.source_lines: a list of numbers is needed"


def test_promotion_keeps_the_given_tree():
    inner = {"company": "b", "sub_roles": [{"company": "B ", "sub_roles": []}, {"company": "c", "sub_roles": [{"company": "b"}]}]}
    given = [{"company": "A", "sub_roles": [inner, {"company": "a", "sub_roles": None}]}, {"company": None}]
    before = copy.deepcopy(given)
    got = tree.promoted(given)
    assert given == before
    shape = lambda r: (r["company"], [shape(s) for s in r["sub_roles"]])
    assert [shape(r) for r in got] == [("A", [("a", [])]), ("b", [("B ", [])]), ("c", []), ("b", []), (None, [])]


# ---- answers of any content


ANSWERS = {
    "brackets": "[" * 20_000,
    "braces": '{"a":' * 20_000,
    "a string of brackets": json.dumps({"contact": {"name": {"text": "[" * 5000 + '\\"' + "{" * 5000, "source_lines": [1]}}}),
    "far line": json.dumps({"contact": {"name": {"text": "t", "source_lines": [10**12, -(10**40), 3]}}}),
    "half a pair": '{"contact": {"name": {"text": "a\\ud800b \\ud83d\\ude00", "source_lines": [1]}}}',
    "key of half a pair": '{"contact": {}, "x\\udfff": {"text": "t", "source_lines": [1]}}',
    "NaN": '{"contact": {}, "m": NaN}',
    "infinite": '{"contact": {}, "m": 1e999}',
    "digits": '{"contact": {"source_lines": [' + "7" * 6000 + "]}}",
    "open string": '{"contact": "' + "\\\\" * 9999,
    "not an object": "[1, 2]",
    "nothing": "",
}


@pytest.mark.parametrize("name", ANSWERS)
def test_any_answer_gets_a_status(name):
    from tallyproof.operators.claims import TableProvider, structure

    made, status, attempts, error = structure("p", TableProvider([ANSWERS[name]] * 3))
    good = name in ("a string of brackets", "far line", "half a pair", "key of half a pair")
    assert (status, attempts) == (("ok", 1) if good else ("validation_failed", 3)), error
    if good:
        made.encode("utf-8")
        assert list(tree.nodes(tree.read(made)))
    error.encode("utf-8")


def test_depth_is_bounded_and_deep_roles_are_read():
    deep = lambda n: "[" * n + "]" * n
    assert tree.read(deep(tree.MAX_DEPTH)) is not None
    with pytest.raises(ValueError, match="levels deep"):
        tree.read(deep(tree.MAX_DEPTH + 1))


def test_taken_apart_of_anything(spark):
    """One payload of each kind in one batch: all others come through whole."""
    rows = [(k, a) for k, a in enumerate(ANSWERS.values())] + [(99, None), (100, '{"experience": [1, {"company": "A", "sub_roles": 3, "source_lines": ["x", true, 2]}]}')]
    got = {}
    for r in tree.taken_apart(spark.createDataFrame(rows, "doc_id long, json string").coalesce(1)).collect():
        got.setdefault(r["doc_id"], []).append((r["what"], r["path"], r["text"], r["source_lines"]))
    names = list(ANSWERS)
    assert got[names.index("far line")] == [("span", "contact.name", "t", [tree.MAX_LINE, -tree.MAX_LINE, 3])]
    assert got[names.index("half a pair")][0][2] == "a�b \U0001f600"
    assert got[names.index("key of half a pair")] == [("span", "x�", "t", [1])]
    assert got[100] == [("object", "experience.0", None, [-1, -1, 2]), ("field", "experience.0", "A", [-1, -1, 2])]
    assert {names[k] for k in got if k < 50} == {"a string of brackets", "far line", "half a pair", "key of half a pair"}


def test_busy_services_are_asked_again():
    import io
    import urllib.error

    from tallyproof.operators.claims import ProviderError, chat_answer, chat_request, HttpProvider

    def service(*codes, header=None):
        left = list(codes)

        def send(url, headers, body, timeout):
            code = left.pop(0)
            if code == "slow":
                raise TimeoutError
            if code != 200:
                raise urllib.error.HTTPError(url, code, "", {"Retry-After": header} if header else {}, io.BytesIO())
            return b'{"choices": [{"message": {"content": "fine"}}]}'

        return send

    def asked(*codes, header=None):
        slept = []
        try:
            out = HttpProvider("http://x", "m", chat_request, chat_answer, send=service(*codes, header=header), sleep=slept.append).propose(["hello \ud800"])[0]
        except ProviderError as e:
            out = e.code
        return out, slept

    assert asked(200) == ("fine", [])
    assert asked(429, 503, 200) == ("fine", [1, 4])
    assert asked(429, 200, header="9") == ("fine", [9])
    assert asked(429, 200, header="900") == ("fine", [16])
    assert asked("slow", 200) == ("fine", [1])
    assert asked(429, 429, 429, 429) == ("provider_busy", [1, 4, 16])
    assert asked("slow", "slow", "slow", "slow") == ("provider_timeout", [1, 4, 16])
    assert asked(401) == ("provider_refused", []) and asked(400) == ("provider_failed", [])


class _Weighed:
    """Answers with 100 KB, and says at its end how much memory its process holds."""

    def propose(self, messages):
        held = int(open("/proc/self/statm").read().split()[1]) * 4096
        return json.dumps({"contact": {"location": {"text": "x" * 100_000, "source_lines": [held >> 20]}}}), False


def test_a_worker_holds_few_answers(spark):
    prompts = spark.range(0, 2500, 1, 1).selectExpr("id AS doc_id", "'p' AS prompt")
    answered = K.structured(prompts, lambda _: _Weighed())
    held = [r.mb for r in answered.selectExpr("get_json_object(json, '$.contact.location.source_lines[0]') AS mb").collect()]
    held = list(map(int, held))
    assert len(held) == 2500 and max(held) - min(held) < 150


def test_nodes_come_in_small_batches(spark):
    """Not in the ten thousand rows of an Arrow batch."""
    parts = tree.taken_apart(spark.createDataFrame([(1, json.dumps(K.EXAMPLE)), (2, None), (3, "[")], "doc_id long, json string"))
    assert {r.doc_id for r in parts.collect()} == {1}
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "MapInPandas" not in plan


def test_a_provider_for_each_partition(spark):
    class Counted:
        def __init__(self):
            self.asked = 0

        def propose(self, messages):
            self.asked += 1
            return json.dumps({"contact": {"location": {"text": str(self.asked), "source_lines": [1]}}}), False

    rows = K.structured(spark.range(0, 6, 1, 2).selectExpr("id AS doc_id", "'p' AS prompt"), lambda _: Counted(), each=False).where("status = 'ok'")
    assert sorted(json.loads(r.json)["contact"]["location"]["text"] for r in rows.collect()) == ["1", "1", "2", "2", "3", "3"]
