from collections import defaultdict

import pytest
from tessgrid.llm import mixing


def fair_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """Share the budget by weight, cap, reshare what is left over, until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = percent * sum(sizes.values()) / 100, {}
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return capped
        unit = (budget - sum(capped.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not above:
            return capped | {s: unit * weight[s] for s in open_}
        capped |= {s: float(most * sizes[s]) for s in above}


CASES = {
    "even": {"a": 100, "b": 100, "c": 100, "d": 100},
    "hot": {"a": 30, "b": 4000, "c": 55, "d": 20, "e": 17, None: 300},
    "one": {"x": 40},
    "hot_first": {"a": 5000, "b": 10, "c": 20, "d": 700},
}


@pytest.mark.parametrize("name", CASES)
def test_targets_and_taken_words(documents, name):
    sizes = CASES[name]
    rows, doc_id = [], 0
    for source, size in sizes.items():
        left = size
        while left:
            n = min(left, 1 + doc_id * 7 % 5)
            rows.append((doc_id, " ".join(["w"] * n), source))
            left, doc_id = left - n, doc_id + 1
    found = mixing.mix(documents(rows)).collect()
    again = mixing.mix(documents(rows[::-1])).collect()
    assert {tuple(r) for r in found} == {tuple(r) for r in again}
    want, source_of, taken, target = fair_targets(sizes), {r[0]: r[2] for r in rows}, defaultdict(int), {}
    for r in found:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
        target[source] = r.target
    assert target == pytest.approx(want) and sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 5


def test_edge_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a\x0bb\x0cc"), (5, "x", None), (5, "x", None), (None, "y z", "q"), (6, "  n")]
    found = mixing.mix(documents(rows)).collect()
    assert len(found) == len(rows)
    size = {r.doc_id: r.size for r in found}
    assert (size[1], size[2], size[3], size[4], size[5], size[None], size[6]) == (0, 0, 0, 3, 1, 2, 2)
    assert len({r.taken for r in found if r.doc_id == 5}) == 1
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mix(documents([(1, None), (2, " ")])).agg({"taken": "sum"}).first()[0] == 0


def test_mix_repeats_rows(documents):
    rows = [(i, " ".join(["w"] * (1 + i % 4)), "ab"[i % 2]) for i in range(200)]
    docs = documents(rows)
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    counted = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in times.items() if n}


def test_rows_without_an_id_come_one_by_one(documents):
    """50 rows of 4 words, 300 words wanted: neither all once nor all twice."""
    docs = documents([(None, "a b c d", "s")] * 50).repartition(3)
    found = mixing.mix(docs).collect()
    assert {r.target for r in found} == {300.0} and abs(sum(r.taken for r in found) - 300) <= 4
    assert abs(mixing.mixed_documents(docs).count() * 4 - 300) <= 4


def test_mix_keeps_columns_named_like_ours(spark):
    docs = spark.createDataFrame(
        [(i, "a b", "s", i, i, 1.0, 2) for i in range(8)],
        "doc_id long, text string, source string, h int, below int, target double, _doc int",
    )
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and got.exceptAll(docs.unionByName(docs)).isEmpty()
