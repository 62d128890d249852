"""Collocations against counts of all phrases."""

import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessgrid.llm import common, phrases

SCHEMA = "doc_id long, text string, lang string, n int, rank int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, top, least):
    counts, total = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        often = {g: n for g, n in f.items() if n >= least}
        rows = []
        for g, a in often.items():
            if len(g) == 1:
                continue
            if any(
                len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h)))
                for h, b in often.items()
            ):
                continue
            score, _, left, right = min(
                (2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))
            )
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(found)


def told(spark, rows, top, least):
    df = spark.createDataFrame([(1, t, lang, 0, 0) for t, lang in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, top, least).collect())


def some_texts(seed, n, sizes=(0, 60)):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "é", "a", "b", "c", " x", "d"] + [f"w{i}" for i in range(12)]
    fixed = ["new york times today", "the end of the world", "a b c d", "w1 w2"]
    ends = [" ", " ", " ", "  ", ", ", ". ", "\t", "\n", "\x0b"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary if rng.random() < 0.7 else fixed) for _ in range(rng.randint(*sizes))]
        rows.append(("".join(w + rng.choice(ends) for w in words), rng.choice(["en", "en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("top,least,slice_", [(5, 4, 1), (40, 3, 4), (2000, 5, 4)])
def test_random(spark, monkeypatch, top, least, slice_):
    monkeypatch.setattr(phrases, "SLICE", slice_)
    monkeypatch.setattr(phrases, "WIDER", 2)
    rows = some_texts(top, 150)
    want = plain(rows, top, least)
    assert want and told(spark, rows, top, least) == want


def test_hot_copies_and_ties(spark):
    rows = [("one two three four five six seven", "en")] * 40 + some_texts(3, 40)
    assert told(spark, rows, 3, 4) == plain(rows, 3, 4)


def test_edges(spark):
    assert told(spark, [], 10, 1) == []
    assert told(spark, [(None, None), ("", "en"), (".,;", "en"), ("word", None)], 10, 1) == []
    rows = [("A\tb  a b!a b", "und"), ("a b", None), ("x " * 20000, "xx")]
    assert told(spark, rows, 10, 2) == plain(rows, 10, 2)


def test_words_spelt_like_languages(spark):
    rows = [("en es fr en es", lang) for lang in ("en", "es", "fr") for _ in range(5)]
    assert told(spark, rows, 10, 2) == plain(rows, 10, 2)


def test_scores_beyond_64_bits(spark):
    a = 6 * 10**18
    df = spark.createDataFrame([(a, a, a)], "a long, l long, r long")
    assert df.select(phrases._ratio(df.a, df.l, df.r)).first()[0] == 1_000_000


def test_tasks_hold_little_at_a_time(spark):
    """However many documents a task reads, rows of hashes, and the row groups they are read by, are small."""
    word = "concat('w', pmod(xxhash64(k, i), 1000000), if(i % 5 = 0, ',', ''))"
    texts = f"array_join(transform(sequence(1, 1000), i -> {word}), ' ') AS text"
    docs = spark.range(4000).withColumnRenamed("id", "k").selectExpr("'en' AS lang", texts).coalesce(1)
    rows = phrases.word_rows(docs)
    sizes = [len(r.ids) for r in rows.select("ids").collect()]
    assert sum(sizes) == 8 * 4000 * 1201 and max(sizes) <= 2**19
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in rows.inputFiles()]
    groups = [f.metadata.row_group(i).column(2) for f in files for i in range(f.metadata.num_row_groups)]
    assert max(g.total_compressed_size for g in groups) <= 2**23


def test_few_rows_are_decoded_at_a_time(spark, monkeypatch):
    """Rows of equal texts take next to no room in a file, so a row group may hold many."""
    seen = []
    rows = phrases.word_rows(spark.createDataFrame([("a b a b", "en")] * 3, "text string, lang string"))
    usual = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    run = phrases.stored
    monkeypatch.setattr(phrases, "stored", lambda df, *a, **k: seen.append(k.get("read_rows")) or run(df, *a, **k))
    found = phrases.counted(rows, 2, None, 3, 2)
    assert sorted(r.f for r in found.collect()) == [3, 6] and seen == [phrases.ROWS_AT_ONCE]
    with common.tidy(spark, 8, 16):
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "16"
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == usual


def test_rows_end_where_pieces_do(monkeypatch):
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 4)
    ids = np.array([1, 2, 0, 3, 4, 5, 0, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 0, 0, 1, 0], np.uint64)
    rows = phrases.cut_rows(ids)
    assert [len(r) for r in rows] == [7, 11, 3] and np.array_equal(np.concatenate(rows), ids)
    assert all(r[-1] == 0 for r in rows)
    assert [list(r) for r in phrases.cut_rows(np.zeros(1, np.uint64))] == [[0]]


@pytest.mark.parametrize("held,batches,merged,told_bits", [(1, 3, 10, 1), (300, 16, 100, 3)])
def test_small_limits(spark, monkeypatch, held, batches, merged, told_bits):
    for name, value in (("HELD", held), ("BATCHES", batches), ("MERGED", merged), ("TOLD_BITS", told_bits)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", 50)
    rows = some_texts(7, 100)
    assert told(spark, rows, 20, 3) == plain(rows, 20, 3)
