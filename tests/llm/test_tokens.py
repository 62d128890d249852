import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tessgrid.llm import bpe, token_counts, token_files
from tokenizers import Tokenizer

WORD, BYTE, PIECE = (
    public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")
)
PLAIN = [
    "", " ", "  ", "\n", "a  b", " a", "a ", "a\n\nb", "don't WON'T", "ΣΑΣ ΟΔΟΣ", "İstanbul", "éa ́b", "각",
    "<|endoftext|>", "x<|startoftext|>y <|endoftext|> z", "a\x1cb\x85c d", "日本語 テキスト", "🙂🙂 🙂", "\x00a\x00",
    "▁a ▁▁ b▁", "<s> </s> <unk> <0x0A>", "1234 56,78.9", "\t\ttab\r\nline\r", "fi ﬁ Å", "tail\n", "　x", "﻿bom",
]
SIGNS = [" ", "  ", "\n", "a", "b", "the", "'s", "Σ", "é", "é", "1", "!", "<|endoftext|>", "\t", "\x1c", "▁", "日", "🙂", "<"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choices(SIGNS, k=rng.randint(1, 30))) for _ in range(1500)]
    return PLAIN + made + ["ab" * 30_000, "word " * 20_000, None]


def test_word_bpe_round_trip(documents, texts):
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.encode_documents(documents(list(enumerate(texts))), WORD).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_merges_take_the_leftmost_lowest_rank():
    ranks, made = {(1, 1): 0, (4, 1): 1, (4, 4): 2}, [4, 5, 6]
    assert bpe.merge_pairs([1] * 5, ranks, made) == [4, 5]  # 44 has a later rank than 41
    assert bpe.merge_pairs([1] * 4, ranks, made) == [6] and bpe.merge_pairs([1, 1, 1], ranks, made) == [5]
    assert bpe.merge_pairs([], ranks, made) == [] and bpe.merge_pairs([2, 3], ranks, made) == [2, 3]


def test_token_files(spark, documents, texts, tmp_path):
    library = Tokenizer.from_file(BYTE)
    rows = [(3 * i - 900, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(documents(rows).repartition(5), BYTE, path, 4)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    start = 0
    for doc_id, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[doc_id]
        assert (r.start, r.n_tokens) == (start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    crc = token_files.read_tokens(spark, path).where("doc_id = -900").select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32(got[-900].ids)


def test_token_files_edge_cases(spark, documents, tmp_path):
    token_files.write_tokens(documents([]), BYTE, str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).collect() == []
    rows = [(None, "null id"), (5, "twice"), (5, "twice"), (5, "longer text"), (1, None)]
    token_files.write_tokens(documents(rows), BYTE, str(tmp_path / "odd"), 3)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "odd")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**32, n) if n % 2 else rng.geometric(0.001, n)
    parts = token_files.pack(ids)
    assert (token_files.unpack(parts, n) == ids).all()
    blocks = -(-n // token_files.BLOCK)
    for first in range(0, blocks, 7):  # through the index of block starts
        piece = token_files.unpack(parts, n, first, first + 1)
        assert (piece == ids[first * token_files.BLOCK : (first + 1) * token_files.BLOCK]).all()


def test_piece_counts(documents, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(list(enumerate(texts))), PIECE).collect()}
    for i, text in enumerate(texts):
        assert got[i].n_tokens == len(library.encode(text or "")), repr(text)[:80]
        assert got[i].n_bytes == len((text or "").encode())


def test_single_pieces_are_proved():
    counter, library = token_counts.PieceCounter(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = [p for p in sorted(counter.single) if p.startswith("▁") and "▁" not in p[1:]]
    assert len(found) > 10_000
    assert all(len(library.encode(p[1:])) == 1 for p in found if len(p) > 1)
