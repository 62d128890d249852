"""Token counts with a whole-token shortcut.

Two facts about a vocabulary are proved once from its file, without any text:

* which pairs of characters never stand next to each other inside a piece. No merge can cross such a
  pair, so text may be cut there into pre-tokens that are counted on their own;
* which pieces, given as text, encode as one token. A pre-token that is such a piece counts 1 without
  merging.

Only what is left is merged, by a heap of candidate pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tessgrid.llm.common import whole_text
from tessgrid.llm.workers import Memo, slices, worker_wide

COUNTED = "doc_id long, n_bytes long, n_tokens long"

#: Fixed value: how the library writes a space.
SPACE = "▁"


class PieceCounter:
    """Counts tokens of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        library = SentencePieceProcessor(model_file=path)
        usual = [
            i for i in range(library.vocab_size())
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))
        ]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in usual}
        self.next_to = {a + b for piece in self.score for a, b in zip(piece, piece[1:])}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            raise ValueError("pieces may hold spaces only in front")
        probe = "a" + SPACE + SPACE + "b"
        if "".join(library.encode(probe.replace(SPACE, " "), out_type=str)) != SPACE + probe:
            raise ValueError("expects a model that keeps spaces and puts one in front")
        self.single = {p for p in self.score if self._merged(p) == 1}
        self.pre_tokens = Memo(lambda p: 1 if p in self.single else self._merged(p))
        self.stretches = Memo(self._stretch)

    def _merged(self, text: str) -> int:
        """Tokens of a pre-token after merging: best score first, then leftmost. Characters that are no
        pieces fall back to bytes."""
        score, parts = self.score, list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = []
        for i in range(len(parts) - 1):
            both = parts[i] + parts[i + 1]
            if both in score:
                heap.append((-score[both], i, both))
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                both = parts[i] + parts[k]
                if both in score:
                    heapq.heappush(heap, (-score[both], i, both))
            h = before[i]
            if h >= 0:
                both = parts[h] + parts[i]
                if both in score:
                    heapq.heappush(heap, (-score[both], h, both))
        return sum(1 if p in score else len(p.encode()) for p in parts if p)

    def _stretch(self, text: str) -> int:
        """Tokens of spaces followed by other characters, cut wherever no piece can cross."""
        count, first = 0, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.next_to:
                count += self.pre_tokens[text[first:i]]
                first = i
        return count + self.pre_tokens[text[first:]]

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = (SPACE + text.replace(" ", SPACE)).split(SPACE)
        if "" not in parts[1:]:
            return sum(map(self.stretches.__getitem__, [SPACE + p for p in parts[1:]]))
        total, held = 0, ""
        for part in parts[1:]:  # a run of spaces belongs to what follows it
            held += SPACE
            if part:
                total += self.stretches[held + part]
                held = ""
        return total + (self.stretches[held] if held else 0)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens for every document.

    Null and empty texts count 0 bytes and 0 tokens. Rows are counted one by one, so ids may repeat or be
    null. Extra columns are ignored. Memory holds one slice of rows and bounded memos.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_wide(f"pieces:{path}", lambda: PieceCounter(path))
        for part in slices(batches):
            counts = [counter.count(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = whole_text()
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, COUNTED)
