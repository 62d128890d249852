import math
from fractions import Fraction

import numpy as np
import pytest
from tessgrid.llm import topk


def brute(vectors, asks, k=10):
    usable = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = [math.floor(Fraction(x) * 1024) for x in v]
    out = set()
    for q in asks:
        if q in usable:
            scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["sphere", "lengths", "copies", "few"])
def test_against_brute_force(spark, kind, monkeypatch):
    rng = np.random.default_rng(9)
    n = 7 if kind == "few" else 700
    x = rng.normal(size=(n, 12))
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "copies":
        x[::3] = x[0]
    monkeypatch.setattr(topk, "CHUNK", 64)
    vectors = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    vectors += [(10_000, None), (10_020, [None] * 12), (10_040, [float("nan")] * 12), (10_060, [float("inf")] * 12), (10_080, [])]
    rows = topk.integer_vectors(frame(spark, vectors))
    got = topk.search(rows, rows.where("vec_id % 20 = 0"))
    assert {tuple(r) for r in got.collect()} == brute(vectors, [i for i, _ in vectors if i % 20 == 0])


def test_empty(spark):
    rows = topk.integer_vectors(frame(spark, []))
    assert topk.search(rows, rows).collect() == []


def test_only_the_query(spark):
    rows = topk.integer_vectors(frame(spark, [(1, [1.0, 2.0])]))
    assert topk.search(rows, rows).collect() == []


@pytest.mark.parametrize("huge", [70_000.0, 2.0**27, 2.0**40])
def test_a_huge_vector_among_small_ones(spark, huge):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(rng.normal(size=(300, 2)))]
    vectors += [(500, [huge, 1.0]), (520, [-huge, 0.5]), (540, [huge, 1.0])]
    rows = topk.integer_vectors(frame(spark, vectors))
    got = {tuple(r) for r in topk.search(rows, rows.where("vec_id % 20 = 0")).collect()}
    want = brute(vectors, [i for i, _ in vectors if i % 20 == 0])
    low, high = -(2**63), 2**63 - 1
    assert {(q, rank, i, min(max(s, low), high)) for q, rank, i, s in want} == got
