"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

A leaf holds (rank, place) of the pair that starts at a symbol, an inner node the smaller of its two
children. The root therefore names the leftmost pair of lowest rank. A merge changes three leaves and
their paths: O(log n), so a word of a million characters takes n log n steps.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tessgrid.llm.common import whole_text
from tessgrid.llm.workers import Memo, slices, worker_wide

ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"

_PLACE_BITS = 40
_PLACE = (1 << _PLACE_BITS) - 1
_NONE = 1 << 62


def merge_pairs(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Apply merges until no pair has a rank. `made[rank]` is the symbol that a merge of that rank makes."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    leaves = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = get((symbols[i], symbols[i + 1]))
        if rank is not None:
            tree[leaves + i] = rank << _PLACE_BITS | i
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    symbols = symbols.copy()
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += leaves
        if tree[i] == value:
            return
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    while tree[1] != _NONE:
        at = tree[1] & _PLACE
        gone = after[at]
        symbols[at] = made[tree[1] >> _PLACE_BITS]
        symbols[gone] = -1
        follows = after[gone]
        after[at] = follows
        if gone < n - 1:
            put(gone, _NONE)
        if follows < n:
            before[follows] = at
            rank = get((symbols[at], symbols[follows]))
            put(at, _NONE if rank is None else rank << _PLACE_BITS | at)
        else:
            put(at, _NONE)
        left = before[at]
        if left >= 0:
            rank = get((symbols[left], symbols[at]))
            put(left, _NONE if rank is None else rank << _PLACE_BITS | left)
    return [s for s in symbols if s >= 0]


class Bpe:
    """Encoder and decoder for a BPE vocabulary whose pre-tokens hold no white space.

    The file's own normaliser and pre-tokeniser prepare a stretch of text; merging is done here. Stretches
    between blanks are prepared and remembered one by one: no pre-token crosses a blank, and a blank
    neither composes nor reorders with what follows it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("expects a plain BPE model")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        vocab: dict[str, int] = model["vocab"]
        self.vocab, self.suffix = vocab, model.get("end_of_word_suffix") or ""
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        found = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.special_pattern = re.compile(f"({found})") if found else None
        names = vocab | self.special
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.words = Memo(self._word)
        self.stretches = Memo(self._stretch)

    def _word(self, word: str) -> bytes:
        last = len(word) - 1
        spelled = [c if i < last else c + self.suffix for i, c in enumerate(word)]
        symbols = [self.vocab[c] for c in spelled if c in self.vocab]
        return array("I", merge_pairs(symbols, self.ranks, self.made)).tobytes()

    def _plain(self, text: str) -> bytes:
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return b"".join([self.words[w] for w, _ in self.pre_tokenizer.pre_tokenize_str(text)])

    def _stretch(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special_pattern is None or "<" not in text:
            return self._plain(text)
        parts = self.special_pattern.split(text)
        return b"".join(
            array("I", [self.special[p]]).tobytes() if i % 2 else self._plain(p)
            for i, p in enumerate(parts)
            if p
        )

    def encode(self, text: str) -> bytes:
        """Token ids as unsigned 32-bit integers in little-endian order."""
        for blank in "\n\t\r\x0b\x0c":
            if blank in text:
                text = text.replace(blank, " ")
        return b"".join(map(self.stretches.__getitem__, text.split(" ")))

    def decode(self, ids: bytes) -> str:
        """The names of the tokens with a space between them, as the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded for every document; ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no tokens and decode to empty text. Ids may repeat or be null: rows are
    encoded one by one. Extra columns are ignored. Memory holds one slice of rows and bounded memos.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_wide(f"bpe:{path}", lambda: Bpe(path))
        for part in slices(batches):
            ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([bpe.decode(i) for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, ENCODED)
