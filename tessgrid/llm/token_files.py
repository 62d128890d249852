"""Token ids in files of patched frame-of-reference blocks.

A block of BLOCK ids stores its minimum, the differences to it packed at the width that holds at least
KEPT_PERCENT of them, and the rest as a list of (place, value). A segment is a run of whole documents
with the ids and lengths of its documents, its blocks and an index of where each block starts, so a
single document can be read by decoding the blocks it touches. Segments are rows of a Parquet table: any
store that Spark reads will do, and a lost task writes its rows again.

Segments carry (bucket, offset in bucket). Buckets are ranges of doc_id, so ascending (bucket, offset)
is ascending doc_id, and a segment's place in the whole is its bucket's start plus its offset.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessgrid.llm.common import whole_text
from tessgrid.llm.workers import Memo, slices, worker_wide

BLOCK, KEPT_PERCENT = 128, 90
#: Ids after which a segment ends, at the next end of a document.
SEGMENT_IDS = 1 << 18
END_ID = 0
#: Buckets whose starts are broadcast; more of them are joined by shuffle.
BROADCAST_BUCKETS = 1_000_000

SEGMENT = (
    "bucket int, seq long, offset long, n_ids long, doc_ids binary, lengths binary, "
    "minima binary, widths binary, starts binary, packed binary, patched binary, places binary, patches binary"
)
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def pack(ids: np.ndarray) -> dict[str, bytes]:
    """The parts of a segment for `ids` (non-negative, below 2**32)."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.int64)
    padded[: len(ids)] = ids
    grid = padded.reshape(blocks, BLOCK)
    minima = grid.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = grid - minima[:, None]
    need = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    kept = -(-BLOCK * KEPT_PERCENT // 100) - 1
    widths = np.partition(need, kept, axis=1)[:, kept] if blocks else np.zeros(0, np.uint8)
    over = need > widths[:, None]
    patched, places = np.nonzero(over)
    patches = rest[patched, places]
    rest[over] = 0
    words = widths.astype(np.int64) * (BLOCK // 64)
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(words, out=starts[1:])
    packed = np.zeros(starts[-1], np.uint64)
    for width in np.unique(widths[widths > 0]):
        mine = np.flatnonzero(widths == width)
        packed[starts[mine][:, None] + np.arange(words[mine[0]])] = _to_words(rest[mine].astype(np.uint64), int(width))
    counts = np.bincount(patched, minlength=blocks)
    return {
        "minima": minima.astype("<u4").tobytes(),
        "widths": widths.tobytes(),
        "starts": starts.astype("<u4").tobytes(),
        "packed": packed.astype("<u8").tobytes(),
        "patched": counts.astype("<u1").tobytes(),
        "places": places.astype("<u1").tobytes(),
        "patches": patches.astype("<u4").tobytes(),
    }


def _to_words(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(values), width * (BLOCK // 64)), np.uint64)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        out[:, word] |= values[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, j] >> np.uint64(64 - shift)
    return out


def _from_words(words: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(words), BLOCK), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        word, shift = divmod(j * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out


def unpack(parts: dict[str, bytes], n_ids: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first..last (all by default), whole blocks, cut at the end of the segment."""
    widths = np.frombuffer(parts["widths"], np.uint8)
    last = len(widths) if last is None else last
    starts = np.frombuffer(parts["starts"], "<u4").astype(np.int64)
    packed = np.frombuffer(parts["packed"], "<u8").astype(np.uint64, copy=False)
    counts = np.frombuffer(parts["patched"], np.uint8).astype(np.int64)
    out = np.zeros((last - first, BLOCK), np.int64)
    for width in np.unique(widths[first:last]):
        if width:
            mine = first + np.flatnonzero(widths[first:last] == width)
            words = packed[starts[mine][:, None] + np.arange(int(width) * (BLOCK // 64))]
            out[mine - first] = _from_words(words, int(width))
    before = int(counts[:first].sum())
    upto = before + int(counts[first:last].sum())
    rows = np.repeat(np.arange(last - first), counts[first:last])
    out[rows, np.frombuffer(parts["places"], np.uint8)[before:upto]] = np.frombuffer(parts["patches"], "<u4")[before:upto]
    out += np.frombuffer(parts["minima"], "<u4")[first:last].astype(np.int64)[:, None]
    return out.reshape(-1)[: max(0, n_ids - first * BLOCK)]


class Stretches(Memo):
    """Remembers stretches. A word with a point or comma after it is looked up without, and not kept."""

    def __missing__(self, key):
        end = self.ends.get(key[-1:])
        if end is not None and key[:-1].isalpha():
            return self[key[:-1]] + end
        return super().__missing__(key)


class ChunkEncoder:
    """The library's encoding of whole texts, remembered by the stretch between blanks.

    A byte-level pre-token is never cut inside by a line feed or a space that has other than white space
    on both sides: the space opens a pre-token and the line feed is one. Texts with other runs of white
    space are cut only at such spaces. Special strings hold no white space, so no cut falls inside one.
    A stretch of letters is one pre-token and goes straight to the library's merges; a point or comma
    that ends it is the next pre-token. Whatever looks otherwise goes through the whole library.
    """

    def __init__(self, path: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.type = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.heads = Stretches(lambda s: self._checked(s, s))
        self.tails = Stretches(lambda s: self._checked(" " + s, s))
        self.pieces = Memo(self._encode)
        self.feed = self._encode("\n")
        self.merge = self.library.model.tokenize
        # Bytes that a byte-level vocabulary writes as themselves; the others follow from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.written = {b: chr(256 + i) for i, b in enumerate(rest)} | {b: chr(b) for b in plain}
        self.heads.ends = self.tails.ends = {mark: self._encode(mark) for mark in ".,"}

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _checked(self, text: str, bare: str) -> bytes | None:
        if bare.isalpha():
            spelled = text.encode().decode("latin-1").translate(self.written)
            return np.array([t.id for t in self.merge(spelled)], self.type).tobytes()
        return self._encode(text) if bare and bare == bare.strip() else None

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        heads, tails, parts = self.heads, self.tails, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                parts.append(heads[words[0]] + b"".join(map(tails.__getitem__, words[1:])))
            return self.feed.join(parts)
        except TypeError:  # a stretch that opens or closes with white space
            return b"".join([self.pieces[p] for p in self.cut.split(text)])


def id_bounds(docs: DataFrame, n_buckets: int) -> list[int]:
    """Upper bounds of all but the last of `n_buckets` ranges of doc_id, from the ids alone."""
    if n_buckets < 2:
        return []
    shares = [i / n_buckets for i in range(1, n_buckets)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * n_buckets).alias("at")).first()["at"]
    return sorted(set(found or []))


def write_tokens(docs: DataFrame, tokenizer: str, path: str, n_buckets: int | None = None) -> None:
    """Encode every document, append END_ID, and write all ids in ascending doc_id order to `path`.

    Null and empty texts are the end id alone. A null doc_id sorts first. Rows repeated under one id stay
    next to each other, shorter ones first. An empty table writes no segments.
    """
    n_buckets = n_buckets or max(1, docs.rdd.getNumPartitions())
    bounds = id_bounds(docs, n_buckets)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_wide(f"chunks:{tokenizer}", lambda: ChunkEncoder(tokenizer))
        end = np.array([END_ID], encoder.type).tobytes()
        for part in slices(batches):
            at = [0 if i is None else bisect.bisect_left(bounds, i) for i in part.column(0).to_pylist()]
            ids = [encoder.encode(t) + end for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), part.column(0), pa.array([encoder.type().itemsize] * len(ids), pa.int32()),
                 pa.array(ids, pa.binary())],
                ["bucket", "doc_id", "bytes", "ids"],
            )

    rows = docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        encoded, "bucket int, doc_id long, bytes int, ids binary"
    )
    (
        rows.repartition(n_buckets, "bucket")
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), F.octet_length("ids"), "ids")
        .mapInArrow(_segments, SEGMENT)
        .write.parquet(path)
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SEGMENT.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 9
    bucket, seq, offset, held, docs = None, 0, 0, 0, []

    def row() -> pa.RecordBatch:
        ids = np.concatenate([i for _, i in docs])
        known = [d is not None for d, _ in docs]
        values = {
            "bucket": bucket, "seq": seq, "offset": offset, "n_ids": len(ids),
            "doc_ids": np.array([[k, d or 0] for k, (d, _) in zip(known, docs)], "<i8").tobytes(),
            "lengths": np.array([len(i) for _, i in docs], "<u4").tobytes(), **pack(ids),
        }
        return pa.RecordBatch.from_arrays([pa.array([values[n]], t) for n, t in zip(names, types)], names)

    for part in slices(batches):
        for at, doc_id, width, ids in zip(*[part.column(i).to_pylist() for i in range(4)]):
            if docs and (at != bucket or held >= SEGMENT_IDS):
                yield row()
                seq, offset, held, docs = seq + 1, offset + held, 0, []
            if at != bucket:
                bucket, seq, offset = at, 0, 0
            found = np.frombuffer(ids, np.uint16 if width == 2 else np.uint32)
            docs.append((doc_id, found))
            held += len(found)
    if docs:
        yield row()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit
    integers) of every document in the files at `path`. Bucket totals are one row per bucket."""
    table = spark.read.schema(SEGMENT).parquet(path)
    totals = table.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    parts = ["doc_ids", "lengths", "minima", "widths", "starts", "packed", "patched", "places", "patches"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(batches, 1):
            found = {n: one.column(n)[0].as_py() for n in [*parts, "n_ids", "first"]}
            ids = unpack(found, found["n_ids"]).astype("<u4")
            lengths = np.frombuffer(found["lengths"], "<u4").astype(np.int64)
            ends = np.cumsum(lengths)
            known = np.frombuffer(found["doc_ids"], "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(d) if k else None for k, d in known], pa.int64()),
                    pa.array(found["first"] + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lengths)], pa.binary()),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )

    # One row of two numbers per bucket. A join that shuffled the segments would move all ids once more.
    if totals.count() <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    placed = table.join(starts, F.col("bucket") == F.col("_bucket"))
    return placed.select((F.col("base") + F.col("offset")).alias("first"), "n_ids", *parts).mapInArrow(decoded, ROWS)
