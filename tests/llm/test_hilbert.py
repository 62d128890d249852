import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessgrid.llm import hilbert


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_curve_visits_neighbours(dims, bits):
    axes = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(2**bits)] * dims)])
    index = hilbert.curve_index(axes, bits)
    assert sorted(index) == list(range(2 ** (bits * dims)))
    along = axes[:, np.argsort(index)]
    assert (np.abs(np.diff(along, axis=1)).sum(axis=0) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 23, 24, 25, 1000])
def test_shards(documents, n):
    rows = [(i * 7 % n if n else 0, ["", None, "é", "same text", "x" * (i % 50)][i % 5], ["a", "hot", "hot", None][i % 4]) for i in range(n)]
    got = hilbert.shards(documents(rows).repartition(3)).collect()
    text = {i: t for i, t, _ in rows}
    assert len(got) == n
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(24)) and max(counts.values(), default=0) - min((counts[s] for s in range(24)), default=0) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_repeated_and_null_ids(documents):
    rows = [(None, "a")] * 3 + [(4, "b")] * 30
    got = hilbert.shards(documents(rows)).collect()
    assert len({(r.shard, r.slot) for r in got}) == 33


def test_files_prune_by_several_dimensions(spark, documents, tmp_path):
    rows = [(i, "x" * (1 + i * i % 977), f"s{i % 8}") for i in range(4000)]
    path = str(tmp_path / "shards")
    docs = documents(rows)
    hilbert.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert back.select(*docs.columns).exceptAll(docs).isEmpty() and back.count() == 4000
    ranges = back.groupBy("shard").agg(
        F.min(F.length("text")).alias("a"), F.max(F.length("text")).alias("b"), F.collect_set("source").alias("s")
    ).collect()
    both = sum(r.a <= 300 and r.b >= 280 and "s3" in r.s for r in ranges)
    assert both <= len(ranges) / 3


def test_equal_texts_lie_together(documents):
    rows = [(i, f"text {i % 90}" if i % 3 else f"own {i}", "abcdefg"[i % 7]) for i in range(2000)]
    rows += [(5000 + i, "very many copies", "xyz"[i % 3]) for i in range(700)]
    got = hilbert.shards(documents(rows).repartition(3)).orderBy("shard", "slot").collect()
    text = {i: t for i, t, _ in rows}
    order = [text[r.doc_id] for r in got]
    runs = [t for i, t in enumerate(order) if i == 0 or order[i - 1] != t]
    assert len(runs) == len(set(order)), "each text is one run of the curve order"
    shards_of = {}
    for r in got:
        shards_of.setdefault(text[r.doc_id], set()).add(r.shard)
    small = [t for t, s in shards_of.items() if len(s) > 1 and t != "very many copies"]
    assert len(small) <= 23
    assert [r.curve for r in got] == sorted(r.curve for r in got)


def test_curve_is_that_of_the_first_of_equal_texts(spark, documents):
    rows = [(3, "t", "s1"), (1, "t", "s2"), (2, "t", "s3"), (4, "other", "s4")]
    got = {r.doc_id: r.curve for r in hilbert.shards(documents(rows)).collect()}
    category = {r[0]: r[1] for r in documents(rows).select("source", hilbert.category("source")).collect()}
    lang = documents(rows).select(hilbert.category("lang")).first()[0]
    length = documents([(0, "t")]).select(hilbert.magnitude(F.octet_length("text"))).first()[0]
    want = hilbert.curve_index(np.array([[category["s2"]], [lang], [length]]), hilbert.DIM_BITS)[0]
    assert got[1] == got[2] == got[3] == want


def test_writing_columns_named_like_ours(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i % 3, f"t{i}", "en", "s", i, 5, "c", 1) for i in range(60)],
        "doc_id long, text string, lang string, source string, shard int, slot int, Curve string, _id int",
    )
    path = str(tmp_path / "shards")
    hilbert.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert back.count() == 60 and back.select(*docs.columns).exceptAll(docs).isEmpty()
    assert {"shard_", "slot_", "curve_"} <= set(back.columns)
