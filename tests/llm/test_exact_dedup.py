import hashlib
import re

import pytest
from tessgrid.llm import exact_dedup


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    text = dict(rows)
    groups = {}
    for i, n in norm.items():
        groups.setdefault(n, []).append(i)
    keep = {n: min(ids, key=lambda i: (-len(text[i] or ""), i)) for n, ids in groups.items()}
    return {
        (i, keep[n], len(groups[n]), keep[n] == i, hashlib.sha256(n.encode()).hexdigest())
        for i, n in norm.items()
    }


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a\tb "), (4, " \n"), (5, ""), (6, None), (7, "é b\x0b"), (8, "éb"), (9, "éb"),
    (10, "a b"), (11, "ab" * 300_000), (12, "ab " * 300_000), (-5, "ab"), (2**62, "ba"), (-(2**63), "ba"),
]


@pytest.mark.parametrize("salts", [1, 16, 62])
def test_groups(documents, salts):
    rows = ROWS + [(100 + i, "copy of one" if i % 2 else "copy  of one") for i in range(400)]
    got = exact_dedup.exact_groups(documents(rows).repartition(7), salts).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(rows)


def test_empty_null_and_repeated_ids(documents):
    assert exact_dedup.exact_groups(documents([])).collect() == []
    got = exact_dedup.exact_groups(documents([(None, "x"), (3, "x"), (3, "x"), (None, "y")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [
        ("3", "3", 3, False), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True),
    ]


def test_dropping_keeps_columns(documents):
    docs = documents([(1, "a"), (2, "a "), (3, "b")])
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_dropping_keeps_one_row_of_each_group(documents):
    rows = [(3, "x"), (3, "x"), (None, "x"), (None, "y"), (None, "y"), (4, "y z"), (4, "a"), (5, "a"), (5, "yz"), (6, "a ")]
    left = exact_dedup.drop_copies(documents(rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("3", "x"), ("4", "y z"), ("6", "a "), ("None", "y")]
    twice = documents(ROWS).unionByName(documents(ROWS))
    once = exact_dedup.drop_copies(documents(ROWS)).collect()
    assert sorted(map(str, exact_dedup.drop_copies(twice).collect())) == sorted(map(str, once))


def test_columns_named_like_ours_stay(spark):
    docs = spark.createDataFrame(
        [(1, "a", 5, "x", 1), (2, "a ", 6, "y", 2)], "doc_id long, text string, _row int, _doc string, salt int"
    )
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "a ", 6, "y", 2)]


def test_many_rows_of_one_id_and_text(documents):
    rows = [(7, "same")] * 500 + [(None, "same")] * 500
    got = exact_dedup.exact_groups(documents(rows).repartition(5)).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {1000} and {r.keep_id for r in got} == {7}


def test_shuffles_that_find_the_copies_end_before_the_rows_move(documents):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    kept = exact_dedup.drop_copies(documents(rows))
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert sorted(r.doc_id for r in kept.collect()) == list(range(7))
