"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from tessgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key int"


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def plain(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved_tokens, ends)}"""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = sorted(own.get(c - c % 20, []))
        made[c] = [t[2:] for t in base[:h]] + [t[2:] for t in sorted(turns)[h:]]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    found = {}
    for node, members in nodes.items():
        under = [u for u in nodes if u[: len(node)] == node]
        kids = [u for u in under if len(u) == len(node) + 1]
        leaves = [u for u in under if not any(len(x) == len(u) + 1 and x[: len(u)] == u for x in under)]
        saved = sum((len(nodes[u]) - 1) * len(u[-1][1].encode().split()) for u in under if u)
        ends = sorted(c for c in members if len(made[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        found[min(members), len(node)] = (parent, len(members), len(kids), len(leaves), saved, digest(ends))
    return found


def told(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    found = prefix_trie.conversation_trie(df).collect()
    got = {(r[0], r[1]): tuple(r[2:]) for r in found}
    assert len(got) == len(found)
    return got


def some_rows(seed, n, choices, longest):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "assistant"]), rng.choice(choices))
        for c in rng.sample(range(n * 2), n)
        for t in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("turns", [5, 40, 10**6])
def test_random(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    rows = some_rows(turns, 120, ["a", "b c", "d e f"], 6)
    assert told(spark, rows) == plain(rows)


def test_hot_opening_and_copies_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS", 12)
    same = [(c, t, "user", f"turn {t}") for c in range(0, 1000, 20) for t in range(9)]
    long = [(c, t, "user", f"turn {t}" if t < 30 else f"own {c}") for c in range(1000, 1400, 20) for t in range(34)]
    rows = same + long + some_rows(1, 30, ["x", "y z"], 4)
    rows = [r for r in rows if r[0] >= 0]
    first = {}
    for r in rows:
        first.setdefault((r[0], r[1]), r)
    rows = list(first.values())
    assert told(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "no conversation"),
        (20, None, "user", "first"), (20, 0, None, None), (20, 3, "user", ""),
        (21, 0, "user", "one"), (21, 0, "user", "one"),
        (23, 0, "user", "été " * 3000),
        (25, 0, "user", "  "),
    ]
    assert told(spark, rows) == plain(rows)
    assert told(spark, []) == {}


def test_ends_of_many_copies(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 30000, 20)]
    got = told(spark, rows)
    assert got[0, 1][5] == digest(range(0, 30000, 20))
    assert got[0, 0][:4] == (None, 1500, 1, 1)
