"""Queries without SQL, and the pipeline, against plain versions of what they do."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_exact_dedup import brute as exact_groups
from test_jaccard import brute as similar_groups
from test_mixing import fair_targets
from tessgrid.llm import mixing, quality
from tokenizers import Tokenizer

from __spark_entry__ import queries


@pytest.fixture(scope="module")
def docs(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()
    return {r.doc_id: (r.text or "", r.source) for r in rows}


def result(spark, small, name, key="doc_id"):
    rows = queries()[name](spark, small).collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def tokens(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_op2(spark, small, docs):
    library, got = tokens("word_bpe_49k.json"), result(spark, small, "op2_bpe")
    assert got.keys() == docs.keys()
    for i, (text, _) in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_op3(spark, small, docs):
    library, got, start = tokens("byte_bpe_50k.json"), result(spark, small, "op3_token_files"), 0
    assert got.keys() == docs.keys()
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i][0], add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5(spark, small, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = result(spark, small, "op5_token_counts")
    assert got.keys() == docs.keys()
    for i, (text, _) in docs.items():
        n = len(library.encode(text))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 4096)


def test_op6(spark, small, docs):
    got = result(spark, small, "op6_quality_classifier")
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_op10(spark, small, docs):
    got = result(spark, small, "op10_hilbert_shards")
    assert got.keys() == docs.keys()
    counts = np.bincount([r.shard for r in got.values()], minlength=24)
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    assert {(r.shard, r.slot) for r in got.values()} == {(s, k) for s, n in enumerate(counts) for k in range(n)}
    for i, (text, _) in docs.items():
        assert got[i].size == len(text.encode()) + 8 and got[i].text_crc32 == zlib.crc32(text.encode())


def plain_mix(docs):
    """How often each document comes: whole copies, then by hash until the next would go further past the
    target than stopping short of it."""
    size = {i: len(t.encode().split()) for i, (t, _) in docs.items()}
    by_source = {}
    for i, (_, source) in docs.items():
        by_source.setdefault(source, []).append(i)
    targets = fair_targets({s: sum(size[i] for i in ids) for s, ids in by_source.items()})
    times = {}
    for source, ids in by_source.items():
        total = sum(size[i] for i in ids)
        whole = int(targets[source] // total) if total else 0
        left = targets[source] - whole * total
        digits = mixing.BITS * mixing.LEVELS // 4
        ids = sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:digits])
        for i in ids:
            more = left > 0 and (size[i] <= left or 2 * left > size[i])
            times[i] = whole + more
            left = left - size[i] if more else 0
    return times


def test_pipeline(spark, small, docs):
    found = corpus_pipeline.run(spark, small).collect()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.learn(spark.read.parquet(f"{small}/documents.parquet"), labels)
    indicators = quality.Indicators()
    left = {i: d for i, d in docs.items() if model.score(indicators.of(d[0])) >= quality.THRESHOLD}
    kept = {i for i, keep, _, stays, _ in exact_groups([(i, t) for i, (t, _) in left.items()]) if stays}
    left = {i: d for i, d in left.items() if i in kept}
    groups = similar_groups([(i, t) for i, (t, _) in left.items()])
    left = {i: d for i, d in left.items() if groups[i][1] == i}
    library = tokens("word_bpe_49k.json")
    want = []
    for i, n in plain_mix(left).items():
        ids = library.encode(left[i][0], add_special_tokens=False).ids
        want += [(i, len(ids), np.array(ids, "<u4").tobytes())] * n
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in found) == sorted(want)
