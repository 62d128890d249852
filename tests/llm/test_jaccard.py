import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessgrid.llm import jaccard
from tessgrid.llm.graph import components
from tessgrid.llm.workers import Memo


def brute(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if words else frozenset()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=50)
    rows, texts = [], []
    for _ in range(60):
        texts.append(rng.choices(words, k=rng.choice([3, 4, 5, 6, 8, 12, 30, 60, 120, 300])))
    for base in texts[:40]:
        for _ in range(rng.choice([0, 1, 1, 3])):
            near = base.copy()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(near)
    chain = rng.choices(words, k=100)
    for _ in range(12):  # each links with the next only
        chain = chain[6:] + rng.choices(words, k=6)
        texts.append(chain)
    hot = rng.choices(words, k=80)
    for i in range(60):
        near = hot.copy()
        near[rng.randrange(80)] = f"n{i}"
        texts.append(near)
    texts += [passage + rng.choices(words, k=rng.choice([10, 60])) for _ in range(40)]
    rng.shuffle(texts)
    for i, t in enumerate(texts):
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(t).upper() if i % 5 == 0 else " ".join(t)))
    return rows + [(1, None), (2, ""), (4, " \n "), (5, "one"), (7, "ONE"), (8, "É one"), (10, "é one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(documents, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows).repartition(3)).collect()}
    assert got == brute(rows)


def test_empty_null_and_repeated_ids(documents):
    assert jaccard.similar_groups(documents([])).collect() == []
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (9, text + " x"), (9, text + " x"), (None, None), (3, "other words are in here now")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.similar_groups(documents(rows)).collect())
    assert got == [("3", "3"), ("9", "9"), ("9", "9"), ("None", "9"), ("None", "None")]


def test_routing_keys_meet():
    rng = np.random.default_rng(3)
    for n in [*range(4, 40), 60, 127, 128, 255, 700]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            swap = int(rng.integers(0, len(a) // 9 + 1))
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 2**63, swap).astype(np.uint64)]))
            if rng.random() < 0.5:
                b = a[: -(-8 * len(a) // 10)]
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(jaccard.routing_keys(a)[0], jaccard.routing_keys(b)[0]))


def test_divide_skip():
    rng = np.random.default_rng(4)
    query = np.unique(rng.integers(0, 2000, 300).astype(np.uint64))
    others = []
    for i in range(40):
        keep = rng.random(len(query)) > i / 120
        others.append(np.union1d(query[keep], rng.integers(3000, 9000, i).astype(np.uint64)))
    want = []
    for place, other in enumerate(others):
        both = len(np.intersect1d(query, other))
        if 100 * both >= 80 * (len(query) + len(other) - both):
            want.append(place)
    assert jaccard.occurrences(query, others) == want and 0 < len(want) < 40


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 3000, 400).astype(np.uint64)) for _ in range(2))
        apart = np.bitwise_count((jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_sketches_of_neighbouring_octaves_and_of_long_sets():
    rng = np.random.default_rng(9)
    small = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    large = np.union1d(small, rng.integers(0, 2**63, 60).astype(np.uint64))
    a, b = jaccard.sketch(small), jaccard.sketch(large)
    assert (len(a), len(b)) == (16, 32)
    assert np.bitwise_count((a ^ jaccard.folded(b)).view(np.uint64)).sum() <= len(large) - len(small)
    for n in (700, 1500, 6000, 30_000):
        one, two = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(2))
        apart = np.bitwise_count((jaccard.sketch(one) ^ jaccard.sketch(two)).view(np.uint64)).sum()
        assert apart * 180 > 2 * n * 20, "unlike sets must not pass"


def test_pairs_meet_without_the_hot_keys_that_a_set_may_leave():
    rng = np.random.default_rng(12)
    met = {True: 0, False: 0}
    for n in [*range(6, 40), 60, 127, 128, 255, 600]:
        for share in (0.1, 0.5, 0.8, 0.95):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            swap = int(rng.integers(0, len(a) // 9 + 1))
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 2**63, swap).astype(np.uint64)]))
            if rng.random() < 0.5:
                b = a[: -(-8 * len(a) // 10)]
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or both == max(len(a), len(b)):
                continue
            offers = [jaccard.routing_keys(x) for x in (a, b)]
            shared = np.intersect1d(offers[0][0], offers[1][0])
            hot = set(rng.permutation(shared)[: int(share * len(shared)) + 1].tolist())
            kept, left_some = [], False
            for keys, kinds, spare in offers:
                spent = [sum(k in hot for k in keys[kinds == kind].tolist()) for kind in (0, 1)]
                mine = set()
                for k, kind in zip(keys.tolist(), kinds.tolist()):
                    if k in hot and kind != jaccard.OTHER and spent[kind] < spare[kind]:
                        left_some = True
                        continue
                    mine.add(k)
                kept.append(mine)
            assert kept[0] & kept[1]
            met[left_some] += 1
    assert min(met.values()) >= 10


@pytest.mark.parametrize("hot", [2, 5])
def test_components_with_hot_keys(documents, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents(rows).repartition(3)).collect()}
    assert got == brute(rows)


def test_long_documents_that_share_a_passage_are_not_held_against_each_other(spark, documents, monkeypatch):
    """Unlike documents of 1,500 words with a passage in common, some near copies among them."""
    monkeypatch.setattr(jaccard, "HOT", 20)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(300)]
    texts = [[f"w{rng.randrange(10**9)}" for _ in range(1200)] + passage for _ in range(300)]
    texts += [[*t[:700], "x", *t[701:]] for t in texts[:20]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = documents(rows).repartition(4)
    read, packed = jaccard._read(docs.select("doc_id", "text"), 5, 80)
    told = ["n_shingles", "sketch", "spare_own", "spare_next"]
    nodes = read.groupBy("node").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in told])
    lists = jaccard._lists(packed, nodes)
    assert lists.groupBy("list_id").count().agg(F.max("count")).first()[0] <= 20
    labelled = lists.withColumn("label", F.col("node"))
    assert jaccard._cross_pairs(labelled, nodes, 80).count() == 20
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()}
    assert got == {i: i - 300 if i >= 300 else i for i in range(320)}


def test_graph(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(90), 1000 + rng.randrange(90)) for _ in range(60)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = defaultdict(set)
    for i in root:
        groups[find(i)].add(i)
    assert got == {i: min(groups[find(i)]) for i in root if len(groups[find(i)]) > 1}


def test_hashed_words_only():
    words = Memo(lambda w: sum(w) * 7919)
    assert len(jaccard.shingle_set("a b c d e f", words)) == 2
    assert len(jaccard.shingle_set("a b", words)) == 1 and len(jaccard.shingle_set(" ", words)) == 0


def test_keeping_one_row_of_each_component(documents):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, long), (2, long), (None, long), (None, "p q r"), (None, "p q r"), (1, "p q s"), (2, "p q s"), (7, ""), (7, "")]
    docs = documents(rows)
    left = jaccard.keep_one(docs.repartition(3))
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [
        ("1", "p q s"), ("2", long), ("7", ""), ("7", ""), ("None", "p q r"),
    ]


def test_lists_of_much_the_same_members_are_met_once(spark):
    rng = random.Random(11)
    lists = {100 + i: rng.sample(range(40), 36) for i in range(30)}  # a group of near copies, key by key
    lists |= {200 + i: [50, *range(1000 + 30 * i, 1030 + 30 * i)] for i in range(30)}  # one node in common
    rows = [(k, n, n // 2) for k, nodes in lists.items() for n in nodes]
    pooled = jaccard._pooled(spark.createDataFrame(rows, "list_id long, node long, label long")).collect()
    now = defaultdict(set)
    for r in pooled:
        assert r.label == r.node // 2
        now[r.list_id].add(r.node)
    assert sum(map(len, now.values())) == len(pooled)
    for nodes in lists.values():  # no pair is lost
        assert any(set(nodes) <= x for x in now.values())
    assert sum(1 for x in now.values() if max(x) < 50) <= 8
    assert sum(len(x) ** 2 for x in now.values()) <= 2 * sum(len(x) ** 2 for x in lists.values())
