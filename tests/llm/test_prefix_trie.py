"""The prefix trie against a plain dictionary of sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyproof.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, d long, node long, n long, depth string"


def plain(rows):
    """Nodes from (conv, turn, role, text), by walking every prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    nodes, whole = defaultdict(list), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in under)
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)
    found = prefix_trie.prefix_trie(df)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert found.columns == names
    return sorted((tuple(r) for r in found.collect()), key=str)


def tables():
    rng = random.Random(3)
    some = []
    for c in [*range(0, 30), *range(100, 120), 205, 1_000_007, -3, -100]:
        for t in range(rng.randrange(1, 7)):
            some.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "", None, "日本", "a b"])))
    some += [(None, 0, "user", "nobody")] + some[:4]
    yield "small alphabet, ties, nulls, repeats", some
    yield "long equal conversations", [(c, t, "u", f"t{t}") for c in (100, 200, 300) for t in range(40)] + [(5, 0, "u", "taken away")]
    yield "all one conversation", [(c, 0, "u", "x" * 300_000) for c in (7, 8, 9)]


@pytest.mark.parametrize("name,rows", list(tables()), ids=lambda v: v if isinstance(v, str) else "")
def test_against_walking(spark, name, rows):
    assert got(spark, rows) == plain(rows)


def test_empty(spark):
    assert got(spark, [(None, 1, "a", "b")]) == []


def test_ends_in_many_chunks(spark, monkeypatch):
    rows = [(d, n, c) for d, n, size in ((0, 0, 9000), (3, 1, 1), (2, 1, 4096), (2, 5, 4097)) for c in range(n, n + size)]
    found = prefix_trie.digests(spark.createDataFrame(rows, "depth long, node long, conv long").repartition(7))
    want = {(d, n): hashlib.sha256(",".join(str(c) for e, m, c in rows if (e, m) == (d, n)).encode()).hexdigest() for d, n, _ in rows}
    assert {(r["depth"], r["node"]): r["ends"] for r in found.collect()} == want
