import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tessgrid.llm import quality


def corpus(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("aeinrst", k=rng.randint(2, 8))) for _ in range(rng.randint(8, 60))]
        bad = i % 6 == 0
        if bad:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" if kind == 0 else w + "%%%" if kind == 1 else words[0] for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus(900)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(documents(rows), told).collect()}
    assert len(got) == 900
    right = {i: got[i].predicted == q for i, q, _ in labels}
    aside = [i for i in right if got[i].held_out]
    assert {i for i in right if zlib.crc32(str(i).encode()) % 4 == 2} == set(aside)
    assert sum(right[i] for i in aside) >= 0.97 * len(aside)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_labels_held_out_change_nothing(spark, documents):
    rows, labels = corpus(300)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (
        {r.doc_id: r.score for r in quality.classify(documents(rows), spark.createDataFrame(x, schema)).collect()}
        for x in (labels, flipped)
    )
    assert a == b


def test_edge_cases(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    rows = [(1, None), (2, ""), (3, "x" * 300_000), (3, "again"), (None, "a b"), (5, "é 🙂")]
    for labels in ([], [(1, 1, 0), (None, 0, 0), (3, None, 1), (3, 7, 1)]):
        got = quality.classify(documents(rows), spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(rows) and len({r.score for r in got}) == 1
    rows, labels = corpus(300)
    odd = [(1000, None), (1001, ""), (1001, "a b c"), (None, "d e f")]
    docs = documents(rows + odd)
    told = spark.createDataFrame(labels + labels[:50], schema)
    got = quality.classify(docs, told)
    assert got.count() == len(rows) + 4
    kept = quality.accept(docs, told)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 1").count()
    assert quality.classify(documents([]), told).collect() == []


def test_training_sample_is_bounded(spark):
    told = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert quality.training_rows(told, 40).count() == 40


def test_hinge_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1, 1, 0, 0])
    ratios = quality.log_count_ratios(rows, y)
    weights, bias = quality.fit_hinge(rows, np.where(y == 1, 1.0, -1.0), ratios, np.ones(4))
    margins = [weights[r].sum() + bias for r in rows]
    assert min(margins[:2]) > 0.5 > -0.5 > max(margins[2:])


def test_pieces_cover_a_long_token():
    rng = random.Random(4)
    for signs in ("永和九年，。", "aB0+/", "ก็ดีมาก", "<a>{};=", "x", "-"):
        token = "".join(rng.choices(signs, k=700))
        parts = quality.pieces(token)
        assert "".join(parts) == token and all(0 < len(quality.shape(p)) <= 12 for p in parts)
    assert quality.shapes("well-known") == ("a-a",)
    ids = quality.Indicators().of
    assert len(ids("x" * 300)) > len(ids("x" * 30))


def test_text_without_blanks_is_read_to_its_end(spark, documents):
    rng = random.Random(5)
    opening = "春天来了，花开了，鸟叫了，人也多了。"
    rows, labels = [], []
    for i in range(240):
        clauses = ["".join(rng.choices("山水日月風雲人心天地", k=rng.randint(3, 9))) for _ in range(40)]
        good = i % 2
        rows.append((i, opening + ("，".join(clauses) + "。" if good else "#@".join(clauses) + "%%")))
        labels.append((i, good, 0))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(documents(rows), told).collect()}
    aside = [i for i, _, _ in labels if got[i].held_out]
    assert aside and all(got[i].predicted == i % 2 for i in aside)


def test_sample_takes_a_rare_class_whole(spark):
    told = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 200 <> 0 AS INT) AS quality")
    rare = quality.learnable(told).where("quality = 0").count()
    got = quality.training_rows(told, 100).groupBy("quality").count().collect()
    assert 0 < rare < 50 and {r.quality: r["count"] for r in got} == {0: rare, 1: 100 - rare}


def test_few_rows_of_a_class_are_learnt_from():
    indicators = quality.Indicators()
    rows, labels = corpus(600)
    good = [indicators.of(t) for (_, t), (_, y, _) in zip(rows, labels) if y]
    bad = [indicators.of(" ".join(w.upper() + "!!" for w in t.split())) for _, t in rows[:40]]
    for few in (1, 2, 3, 7):
        model = quality.fit(good[:300] + bad[:few], np.array([1] * 300 + [0] * few))
        assert model.fitted and max(map(model.score, bad)) < min(map(model.score, good))
        if few > 1:
            assert max(map(model.score, bad)) < quality.THRESHOLD <= min(map(model.score, good))


def test_absent_class_rejects_nothing(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    docs = documents([(i, f"text {i}") for i in range(20)])
    for labels in ([], [(i, 0, 0) for i in range(20)], [(i, 1, 0) for i in range(20)]):
        assert quality.accept(docs, spark.createDataFrame(labels, schema)).count() == 20


def test_labels_that_tell_nothing_apart_reject_nothing(spark, documents):
    """Four labels of both classes on equal texts: no score lies on the other side of the threshold."""
    docs = documents([(i, "plain words here") for i in range(6)])
    told = spark.createDataFrame([(i, i % 2, 0) for i in (0, 1, 4, 5)], "doc_id long, quality int, toxic int")
    assert quality.accept(docs, told).count() == 6
