"""Removal of repeats against a dictionary of all windows; transforms against sorted strings."""

import random

import numpy as np
import pytest

from tessgrid.llm import bwt_dedup

SCHEMA = "doc_id long, text string, _row int, spans int, bytes string, key int"


def plain(rows, width):
    first = {}
    told = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, data in told:
        for k in range(len(data) - width + 1):
            s = data[k : k + width]
            first[s] = min(first.get(s, i), i)
    found = []
    for (doc_id, _), (i, data) in zip(rows, told):
        gone = bytearray(len(data) + 1)
        for k in range(len(data) - width + 1):
            if first[data[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        spans = [k for k in range(len(data) + 1) if gone[k] != (gone[k - 1] if k else 0)]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        found.append((doc_id, len(data), list(zip(spans[::2], spans[1::2])), kept))
    return sorted(found, key=repr)


def told(spark, rows, width=50):
    df = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], SCHEMA).repartition(3)
    found = bwt_dedup.without_repeats(df, width).collect()
    return sorted(((r[0], r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in found), key=repr)


def some_rows(seed, n=60, ids=None):
    rng = random.Random(seed)
    letters = "abcdefgh é\n\0"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(49, 130))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [
            rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
            for _ in range(rng.randint(0, 6))
        ]
        rows.append((ids[i] if ids else rng.randrange(10**6), "".join(parts)))
    copies = [(i + 10**6, t[: len(t) // 2] + "Z" + t[len(t) // 2 :]) for i, t in rows[:15] if i is not None]
    return rows + copies + [(2 * 10**6 + k, t) for k, (_, t) in enumerate(rows[:10])]


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, monkeypatch, seed):
    monkeypatch.setattr(bwt_dedup, "BUCKET", 4000)
    monkeypatch.setattr(bwt_dedup, "SHARD", 700)
    monkeypatch.setattr(bwt_dedup, "HELD", 50)
    rows = some_rows(seed)
    assert told(spark, rows) == plain(rows, 50)


def test_hot_keys_by_windows(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SPLIT", 3)
    monkeypatch.setattr(bwt_dedup, "BUCKET", 2000)
    rng = random.Random(5)
    line = "a line that very many documents hold in ever new company"
    rows = [(k, "".join(rng.choice("xyz") for _ in range(40)) + line + "".join(rng.choice("xyz") for _ in range(40))) for k in range(40)]
    rows += some_rows(3, 20)
    assert told(spark, rows) == plain(rows, 50)


def test_edges(spark):
    a, b = "0123456789" * 5, "abcdefghij" * 5
    rows = [
        (None, a), (None, a + b), (3, a), (3, a), (5, a + "é" + a), (7, None), (8, ""), (9, a[:49]), (4, b), (6, b + a),
        (10, "x" * 400), (11, "x" * 401), (12, b[1:] + a + b),
    ]
    assert told(spark, rows) == plain(rows, 50)
    assert told(spark, []) == []
    assert told(spark, [(1, "short")]) == [(1, 5, [], b"short")]


def test_repeats_inside_one_document_stay(spark):
    rows = [(1, "q" * 3000), (2, "only here " * 300)]
    assert told(spark, rows) == plain(rows, 50)


def test_other_widths(spark):
    for width in (5, 23):
        rows = some_rows(4, 25)
        assert told(spark, rows, width) == plain(rows, width)


@pytest.mark.parametrize("width", [2, 7, 16, 50])
def test_interleave_orders_rotations(width):
    rng = random.Random(width)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 80))) for _ in range(40)]
    shards = [bwt_dedup.Shard(strings[i : i + 13], width) for i in range(0, 40, 13)]
    place, starts = bwt_dedup.interleave(shards, width)
    heads = []
    for i in range(0, 40, 13):
        shard = shards[i // 13]
        for r in shard.rows:
            s = strings[i + shard.string[r]] + b"\xff"
            o = shard.offset[r]
            heads.append(((s[o:] + s * width)[:width]))
    merged = [None] * len(heads)
    for head, p in zip(heads, place):
        merged[p] = head
    assert merged == sorted(merged)
    opens = [k for k in range(len(merged)) if k == 0 or merged[k] != merged[k - 1]]
    assert list(starts) == opens


def test_long_texts_go_by_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()
    whole = bwt_dedup.stretches(data)
    monkeypatch.setattr(bwt_dedup, "BLOCK", 700)
    cut = bwt_dedup.stretches(data)
    per_window = [np.repeat(k, b - a) for a, b, k in (whole, cut)]
    assert len(per_window[0]) == 4951 and (per_window[0] == per_window[1]).all()


def test_a_phrase_shorter_than_a_window_shares_no_key():
    rng = random.Random(8)
    other = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    phrase, passage = other(26), other(60)
    short = [set(bwt_dedup.stretches(other(70) + phrase + other(70))[2].tolist()) for _ in range(40)]
    assert len(set().union(*short)) == sum(map(len, short))
    whole = [set(bwt_dedup.stretches(other(70) + passage + other(70))[2].tolist()) for _ in range(40)]
    assert set.intersection(*whole)


@pytest.mark.parametrize("width", [2, 16, 17, 23, 50])
def test_equal_windows_have_equal_keys(width):
    rng = random.Random(width)
    keys = {}
    for _ in range(30):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 200)))
        for first, last, key in zip(*bwt_dedup.stretches(data, width)):
            for i in range(first, last):
                assert keys.setdefault(data[i : i + width], key) == key


def test_holders_of_windows_by_strings():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 40))) for _ in range(50)]
    holders = np.array([rng.randrange(1000) for _ in strings])
    first = {}
    for s, h in zip(strings, holders):
        for i in range(len(s) - 6):
            first[s[i : i + 7]] = min(first.get(s[i : i + 7], h), h)
    wanted = [first[s[i : i + 7]] for s in strings for i in range(len(s) - 6)]
    assert bwt_dedup.least_holders(strings, holders, 7).tolist() == wanted
