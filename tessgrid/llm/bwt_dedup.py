"""Removal of repeated passages: bytes covered by a string of `width` bytes that an earlier document holds too.

1. Units. Texts are cut where a gram's hash is least among its neighbours; two pieces in a row are a unit.
   A unit that an earlier document holds whole is removed whole, and its windows need not be looked at
   again: the first document to hold a window has it outside such units. This settles copies early.
2. Routing. The minimizer of a window of `width` bytes is its gram of least hash, the leftmost of several.
   The key of a window is its minimizer and a gram further on, or further back if the minimizer stands in the
   right half. Equal windows have equal keys, so all places of a repeated string meet under one key; a phrase
   much shorter than a window seldom makes two others meet. Windows in a row with the same minimizer and key
   are one *stretch*.
3. Filter. Each document offers its keys once. Stretches whose key no other document offers hold nothing
   that repeats; only the others are read again. Equal stretches become one, with the least and the greatest
   document that bears them.
4. Shards. Stretches are dealt into buckets by key. A bucket is cut into shards, and the Burrows-Wheeler
   transform of each shard's rotations is built on its own. (A key with one stretch needs none.)
5. Merge. The transforms of a bucket are interleaved by refinement: starting from any interleave, each round
   reads the symbols before all rows in the present order and sorts rows by them, stably. After each round
   rows stand in order of a few symbols more, while the shards' own orders never change. A row that
   differs from the one before it, in those symbols or in the block it came from, opens a block; the round
   in which it does bounds their common prefix. After `width` symbols a block is the interval of one string.
6. The least document of an interval is the first to hold its string. Every place of it in a later document
   is removed.

Texts are shuffled once, into a table bucketed by row; what later steps find about a row is brought to it
there. A key with very many different stretches (a frequent phrase in ever new company) is cut into single
windows, which are dealt out by their own hash; so no bucket grows with the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessgrid.llm.common import shared_folder, stored, tidy, whole_text
from tessgrid.llm.jaccard import mixed
from tessgrid.llm.workers import slices
from tessgrid.operators.ordered import salted_join

#: Bytes of a repeated string, and of the grams that minimizers and cuts are chosen from.
WIDTH, GRAM = 50, 16
#: A cut has the least hash among so many grams on either side; pieces are about twice as long.
REACH = 64
#: Bytes a bucket and a shard hold, about, and stretches of a key beyond which it is cut into windows.
BUCKET, SHARD, SPLIT = 1 << 16, 1 << 14, 1 << 14
#: Keys of that kind that are broadcast at most.
BROADCAST_KEYS = 10_000
#: Bytes of text in a file of the bucketed table, about, and files at most.
FILE, MOST_FILES = 1 << 25, 100_000
#: Windows of a text that are routed at a time, keys that a task holds, bytes of key and row in the filter.
BLOCK, HELD, KEY_BYTES, ROW_BYTES = 1 << 22, 2_000_000, 6, 5

_END = 0xFF  # never occurs in UTF-8
_PLACE = np.uint64((1 << 24) - 1)
_PRIME = np.uint64(0xC2B2AE3D27D4EB4F)
_LAST = (1 << 63) - 1


def _hashes(data: bytes, gram: int) -> np.ndarray:
    """Hash of the gram from each place on."""
    n = len(data) - gram + 1
    if gram == 16:
        low, high = (np.ndarray(n, "<u8", data, i, (1,)) for i in (0, 8))
        return mixed(mixed(low) + high * _PRIME)
    chars = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    found = np.zeros(n, np.uint64)
    for i in range(gram):
        found = found * _PRIME + chars[i : i + n]
    return mixed(found)


def _least(hashed: np.ndarray, span: int) -> np.ndarray:
    """Place of the least hash among each `span` in a row, the leftmost of several."""
    least, have = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64), 1
    while have < span:
        more = min(have, span - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    return (least & _PLACE).astype(np.int64)


def units(data: bytes, width: int = WIDTH) -> list[tuple[int, int]]:
    """[start, end) of the units of a text. Every window lies in one: pieces but the first and the last are
    longer than a window."""
    gram, reach = min(GRAM, width), max(REACH, width)
    cuts = [0]
    for base in range(0, max(0, len(data) - gram + 1 - 2 * reach), BLOCK):
        some = data[base : base + BLOCK + 2 * reach + gram - 1]
        least = _least(_hashes(some, gram), 2 * reach + 1)
        cuts.extend((np.flatnonzero(least == np.arange(len(least)) + reach) + base + reach).tolist())
    cuts.append(len(data))
    return list(zip(cuts, cuts[2:])) or [(0, len(data))]


def stretches(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window + 1 and key of each stretch of a text."""
    gram = min(GRAM, width)
    found = []
    for base in range(0, max(0, len(data) - width + 1), BLOCK):
        hashed = _hashes(data[base : base + BLOCK + width - 1], gram)
        at = _least(hashed, width - gram + 1)
        # The other gram lies as far off as every window on this side of `half` reaches.
        half = (width - gram + 1) // 2
        right = at - np.arange(len(at)) >= half
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (right[1:] != right[:-1]))))
        least = at[first]
        other = hashed[np.where(right[first], least - half, least + width - gram + 1 - half)]
        found.append((first + base, np.append(first[1:], len(at)) + base, mixed(hashed[least] * _PRIME + other)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def open_stretches(
    data: bytes, settled: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that hold a window outside the settled units, from the first such window to the last."""
    first, last, key = stretches(data, width)
    settled = settled[settled[:, 1] - settled[:, 0] >= width]
    if not len(settled) or not len(first):
        return first, last, key
    edge = np.zeros(last[-1] + 1, np.int32)
    np.add.at(edge, settled[:, 0], 1)
    np.add.at(edge, settled[:, 1] - width + 1, -1)
    left = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    low, high = np.searchsorted(left, first), np.searchsorted(left, last)
    some = high > low
    return left[low[some]], left[high[some] - 1] + 1, key[some]


def _utf8(texts: pa.Array) -> pa.Array:
    """The bytes of the texts, as Arrow holds them."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def _short(a: np.ndarray, size: int) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _long(data: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(data) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return wide.view("<u8").ravel()


_KEY_MASK, _ROW_MASK = np.uint64((1 << 8 * KEY_BYTES) - 1), (1 << 8 * ROW_BYTES) - 1


def _texts(docs: DataFrame) -> DataFrame:
    """_row (some bits of _hash), _hash (of id and text), _id (null: the greatest LONG), doc_id and text, in a
    table bucketed by _row, so that tables by _row are joined to it without moving a text."""
    spark = docs.sparkSession
    told = docs.select("doc_id", whole_text().alias("text"))
    told = told.select(
        F.xxhash64("doc_id", "text").alias("_hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"),
        "doc_id",
        "text",
    ).withColumn("_row", F.col("_hash").bitwiseAND(F.lit(_ROW_MASK)))
    size = told.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = int(min(size // FILE + 1, MOST_FILES))
    name = f"texts_{uuid.uuid4().hex}"
    writer = told.repartition(files, "_row").write.bucketBy(files, "_row").option("compression", "zstd")
    with tidy(spark):
        writer.option("path", shared_folder(spark)).format("parquet").saveAsTable(name)
    stored_texts = spark.table(name)
    # The name is needed no longer; the files stay.
    spark.sql(f"DROP TABLE {name}")
    return stored_texts


def _brought(texts: DataFrame, *found: DataFrame) -> DataFrame:
    """Texts with columns of tables that have one line per _row, null where they have none."""
    for table in found:
        texts = texts.join(table.hint("shuffle_hash"), "_row", "left")
    return texts


def settled_units(texts: DataFrame, width: int) -> DataFrame:
    """_row, _hash, start, end of the units that a document with a smaller id holds as well."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, found = [], []
            for row, code, doc, data in zip(*(x.to_pylist() for x in (*part.columns[:3], _utf8(part.column(3))))):
                for a, b in units(data, width):
                    rows.append((row, code, doc, a, b))
                    found.append(xxhash.xxh3_128_intdigest(data[a:b]))
            sides = [np.array([d >> shift & (1 << 64) - 1 for d in found], np.uint64).view(np.int64) for shift in (64, 0)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 5
            names = ["_row", "_hash", "_id", "start", "end", "d1", "d2"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in sides)], names)

    schema = "_row long, _hash long, _id long, start long, end long, d1 long, d2 long"
    told = stored(texts.select("_row", "_hash", "_id", "text").mapInArrow(cut, schema))
    first = told.groupBy("d1", "d2").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high")
    # Units of very many copies are split by the bytes that arrive (adaptive skew join).
    later = told.join(first.hint("merge"), ["d1", "d2"]).where("_id > low")
    return stored(later.select("_row", "_hash", "start", "end"))


def _spans(found: DataFrame, name: str) -> DataFrame:
    """_row and an array of _hash, start, end, _hash, start, end and so on."""
    return found.groupBy("_row").agg(F.flatten(F.collect_list(F.array("_hash", "start", "end"))).alias(name))


def _own(spans: pa.Array, codes: pa.Array) -> list[np.ndarray]:
    """For each row the spans, start and end, that are meant for it: a few rows share _row."""
    flat = spans.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
    ends = np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // 3)
    found, begin = [], 0
    for end, code in zip(ends.tolist(), codes.to_pylist()):
        some = flat[begin:end]
        found.append(some[some[:, 0] == code, 1:])
        begin = end
    return found


def shared_keys(texts: DataFrame, settled: DataFrame, width: int) -> DataFrame:
    """_row, keys: per document its keys that another row offers as well, cut to some bytes. Rows and keys
    may be told too many, which later steps find out, never too few."""
    parts = 4 * max(2, texts.rdd.getNumPartitions())

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, held = [], [], 0

        def packed() -> pa.RecordBatch:
            key, row = np.concatenate(keys), np.concatenate(rows)
            part = ((key >> np.uint64(48)) % np.uint64(parts)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            key, row, part = key[order], row[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(at[1:], len(part))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(part[at].astype(np.int32)),
                    pa.array([_short(key[a:b], KEY_BYTES) for a, b in zip(at, ends)], pa.binary()),
                    pa.array([_short(row[a:b], ROW_BYTES) for a, b in zip(at, ends)], pa.binary()),
                ],
                ["part", "keys", "rows"],
            )

        for batch in slices(batches):
            done = _own(batch.column(3), batch.column(1))
            for row, data, settled in zip(batch.column(0).to_pylist(), _utf8(batch.column(2)).to_pylist(), done):
                mine = np.unique(open_stretches(data, settled, width)[2])
                if len(mine):
                    keys.append(mine)
                    rows.append(np.full(len(mine), row, np.uint64))
                    held += len(mine)
            if held >= HELD:
                yield packed()
                keys, rows, held = [], [], 0
        if held:
            yield packed()

    def meet(table: pa.Table) -> pa.Table:
        key = _long(b"".join(table.column("keys").to_pylist()), KEY_BYTES)
        row = _long(b"".join(table.column("rows").to_pylist()), ROW_BYTES)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        key, row = key[order], row[order]
        order = np.argsort(row, kind="stable")
        key, row = key[order], row[order]
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(row))
        return pa.table(
            {
                "_row": pa.array(row[at].astype(np.int64)),
                "keys": pa.array([_short(key[a:b], KEY_BYTES) for a, b in zip(at, ends)], pa.binary()),
            }
        )

    offered = _brought(texts, settled).select("_row", "_hash", "text", "settled")
    offered = offered.mapInArrow(offer, "part int, keys binary, rows binary")
    found = offered.groupBy("part").applyInArrow(meet, "_row long, keys binary")
    return found.groupBy("_row").agg(F.collect_list("keys").alias("keys"))


def shared_stretches(texts: DataFrame, settled: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """_row, _hash, _id, first, key, digest, bytes of every stretch whose key more than one row offers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fixed, found = [], []
            done = _own(part.column(4), part.column(1))
            told = (*part.columns[:3], _utf8(part.column(3)), part.column(5))
            for row, code, doc, data, shared, settled in zip(*(x.to_pylist() for x in told), done):
                first, last, key = open_stretches(data, settled, width)
                at = np.isin(key & _KEY_MASK, _long(b"".join(shared), KEY_BYTES))
                first, last = first[at], last[at]
                same = (np.full(len(first), x, np.int64) for x in (row, code, doc))
                fixed.append((*same, first, key[at].view(np.int64)))
                found.extend(data[a : b + width - 1] for a, b in zip(first.tolist(), last.tolist()))
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*fixed)]
            names = ["_row", "_hash", "_id", "first", "key", "bytes"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names)

    joined = _brought(texts, settled, keys).where("keys IS NOT NULL")
    made = joined.select("_row", "_hash", "_id", "text", "settled", "keys").mapInArrow(
        cut, "_row long, _hash long, _id long, first long, key long, bytes binary"
    )
    made = made.withColumn("digest", F.xxhash64("bytes"))
    return stored(made, "zstd")


class Shard:
    """Transform of the rotations of some strings, each closed by _END: `rows` lists places in sorted order
    of their first `width` symbols, `before(n)` the n symbols before each row as one number."""

    def __init__(self, strings: list[bytes], width: int):
        end = bytes([_END])
        self.text = np.frombuffer(b"".join(s + end for s in strings), np.uint8)
        sizes = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
        first = np.cumsum(sizes) - sizes
        self.string = np.repeat(np.arange(len(strings)), sizes)
        self.first, self.size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        self.offset = np.arange(len(self.text)) - self.first
        eight = self.text.astype(np.uint64)
        for known in (1, 2, 4):
            eight = eight << np.uint64(8 * known) | eight[self._at(known)]
        self.eight = eight
        self.rows = np.argsort(self._ranks(width), kind="stable")

    def _at(self, ahead: int) -> np.ndarray:
        """Place `ahead` symbols on in the same string, or back if negative."""
        return self.first + (self.offset + ahead) % self.size

    def _ranks(self, width: int) -> np.ndarray:
        """Order of the rotations by `width` symbols, by doubling."""
        if width <= 8:
            return self.eight >> np.uint64(64 - 8 * width)
        known, rank = 8, self.eight
        while known < width:
            more = min(known, width - known)
            rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
            rank = rank * np.uint64(len(rank)) + rank[self._at(more)]
            known += more
        return rank

    def before(self, n: int) -> np.ndarray:
        return self.eight[self._at(-n)][self.rows] >> np.uint64(64 - 8 * n)


def _steps(shards: list[Shard], width: int) -> list[tuple[int, np.ndarray]]:
    """Symbols per round, and for all rows what stands before them as numbers below 2**16, which keep the
    order. As many symbols are read in a round as leave no more different numbers."""
    for stride in (8, 4, 2, 1):
        found = {}
        for n in {min(stride, width), width % stride} - {0}:
            values, codes = np.unique(np.concatenate([s.before(n) for s in shards]), return_inverse=True)
            if len(values) > 1 << 16:
                break
            found[n] = codes.astype(np.uint16)
        else:
            steps = [width % stride] * (width % stride > 0) + [stride] * (width // stride)
            return [(n, found[n]) for n in steps]
    raise AssertionError("single bytes have 256 values at most")


def interleave(shards: list[Shard], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged transform. For the rows of all shards, shard after shard: their place among all; and where
    each block of rows with the same first `width` symbols starts."""
    sizes = [len(s.rows) for s in shards]
    shard = np.repeat(np.arange(len(shards)), sizes).astype(np.uint16)
    opens = np.zeros(len(shard), bool)
    opens[:1] = True
    symbol = np.empty(len(shard), np.uint16)
    for _, before in _steps(shards, width):
        symbol[np.argsort(shard, kind="stable")] = before
        order = np.argsort(symbol, kind="stable")
        block = np.cumsum(opens, dtype=np.int32)[order]
        sorted_symbol, shard = symbol[order], shard[order]
        opens[1:] = (sorted_symbol[1:] != sorted_symbol[:-1]) | (block[1:] != block[:-1])
    return np.argsort(shard, kind="stable"), np.flatnonzero(opens)


def least_holders(strings: list[bytes], holders: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each window of each string, string after string: the least holder of any string that has it."""
    shards, string_of, valid, now, size = [], [], [], [], 0
    for i, s in enumerate(strings):
        now.append(i)
        size += len(s) + 1
        if size >= SHARD or i == len(strings) - 1:
            shard = Shard([strings[j] for j in now], width)
            shards.append(shard)
            string_of.append(np.array(now)[shard.string[shard.rows]])
            valid.append((shard.offset + width < shard.size)[shard.rows])
            now, size = [], 0
    place, starts = interleave(shards, width)
    string, whole = np.concatenate(string_of), np.concatenate(valid)
    held = np.empty(len(place), np.int64)
    held[place] = np.where(whole, holders[string], _LAST)
    least = np.minimum.reduceat(held, starts)
    block = np.searchsorted(starts, place, side="right") - 1
    per_row = least[block]
    # Back to the order of the text.
    out, done = [], 0
    for shard in shards:
        in_text = np.empty(len(shard.rows), np.int64)
        in_text[shard.rows] = per_row[done : done + len(shard.rows)]
        done += len(shard.rows)
        out.append(in_text[shard.offset + width < shard.size])
    return np.concatenate(out)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _merged(strings: DataFrame, width: int) -> DataFrame:
    """key, digest, at, low: where runs of windows with the same least holder start in a string, and that
    holder; only strings of which some holder is later than that. `strings`: bucket, key, digest, bytes,
    low, high."""

    def merge(table: pa.Table) -> pa.Table:
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        windows = np.maximum(0, pc.binary_length(table.column("bytes")).to_numpy().astype(np.int64) - width + 1)
        begin, string = np.cumsum(windows) - windows, np.repeat(np.arange(len(windows)), windows)
        least = low[string]
        # A key that has one string has nothing to merge: all its windows are first held by its least holder.
        _, of_key, strings_of = np.unique(table.column("key").to_numpy(), return_inverse=True, return_counts=True)
        several = strings_of[of_key] > 1
        if several.any():
            strings = table.column("bytes").filter(pa.array(several)).to_pylist()
            least[several[string]] = least_holders(strings, low[several], width)
        first = np.ones(len(least), bool)
        first[1:] = (least[1:] != least[:-1]) | (string[1:] != string[:-1])
        keep = np.zeros(len(windows), bool)
        keep[string[least < high[string]]] = True
        at = np.flatnonzero(first & keep[string])
        # Where each run starts, and where the last one of a string ends.
        ends = np.cumsum(np.bincount(string[at], minlength=len(windows))[keep])
        stops = np.insert(at - begin[string[at]], ends, windows[keep])
        offsets = np.insert(ends, 0, 0)
        return pa.table(
            {
                "key": table.column("key").filter(pa.array(keep)),
                "digest": table.column("digest").filter(pa.array(keep)),
                "at": _lists(offsets + np.arange(len(offsets)), stops),
                "low": _lists(offsets, least[at]),
            }
        )

    schema = "key long, digest long, at array<long>, low array<long>"
    return strings.groupBy("bucket").applyInArrow(merge, schema)


def _dealt(strings: DataFrame, by: list[str]) -> DataFrame:
    """Adds bucket: as many as the bytes ask for."""
    size = strings.agg(F.sum(F.octet_length("bytes") + 1)).first()[0] or 0
    buckets = size // BUCKET + 1
    return strings.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))


def least_holders_of(found: DataFrame, width: int) -> DataFrame:
    """_merged() for all stretches in `found`, keys with very many of them by single windows."""
    strings = found.groupBy("key", "bytes").agg(F.min("_id").alias("low"), F.max("_id").alias("high"))
    strings = stored(strings.withColumn("digest", F.xxhash64("bytes")), "zstd")
    large = stored(strings.groupBy("key").count().where(F.col("count") > SPLIT).select("key", F.lit(True).alias("hot")))
    n_large = large.count()
    if n_large == 0:
        return stored(_merged(_dealt(strings, ["key"]), width))
    if n_large <= BROADCAST_KEYS:
        strings = strings.join(F.broadcast(large), "key", "left")
    else:
        strings = salted_join(strings, large, ["key"], F.col("digest"))
    strings = stored(strings.withColumn("hot", F.col("hot").isNotNull()))
    few = _merged(_dealt(strings.where("NOT hot"), ["key"]), width)
    hot = strings.where("hot")
    each = F.posexplode(
        F.expr(f"transform(sequence(1, octet_length(bytes) - {width - 1}), i -> substring(bytes, i, {width}))")
    )
    windows = hot.select("key", "digest", "low", "high", each.alias("i", "window"))
    windows = stored(windows.withColumn("window_digest", F.xxhash64("window")), "zstd")
    once = windows.groupBy("key", F.col("window").alias("bytes"), F.col("window_digest").alias("digest")).agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    best = _merged(_dealt(stored(once, "zstd"), ["key", "digest"]), width)
    best = best.select("key", F.col("digest").alias("window_digest"), F.col("low")[0].alias("least"))
    runs = (
        windows.join(best.hint("merge"), ["key", "window_digest"])
        .groupBy("key", "digest")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "least"))).alias("w"))
    )
    # One run per window: [i, i + 1) pairs need a stop of their own where windows are missing.
    gaps = "flatten(transform(w, x -> array(x.i, x.i + 1)))"
    lows = f"slice(flatten(transform(w, x -> array(x.least, {_LAST}L))), 1, 2 * size(w) - 1)"
    return stored(few.unionByName(runs.select("key", "digest", F.expr(gaps).alias("at"), F.expr(lows).alias("low"))))


def repeated_spans(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """_row, spans: byte ranges (_hash, start, end) to remove, overlapping and in no order. `texts`: `_texts`."""
    units_found = settled_units(texts, width)
    settled = stored(_spans(units_found, "settled"))
    # A stored side is shuffled to the buckets of the texts, never the texts to it.
    keys = stored(shared_keys(texts, settled, width))
    found = shared_stretches(texts, settled, keys, width)
    least = least_holders_of(found, width)
    # Stretches that very many documents bear are split by the bytes that arrive (adaptive skew join).
    places = found.select("_row", "_hash", "_id", "first", "key", "digest").join(least.hint("merge"), ["key", "digest"])
    runs = F.expr(
        "filter(transform(low, (m, i) -> struct(_hash AS _hash, first + at[i] AS start, "
        f"first + at[i + 1] + {width - 1} AS end, m AS m)), x -> x.m < _id)"
    )
    spans = places.select("_row", F.explode(runs).alias("s")).select("_row", "s._hash", "s.start", "s.end")
    return _spans(units_found.unionByName(spans), "spans")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, spans, kept: per document the maximal byte ranges removed, in order, and the bytes left.

    A byte goes if some `width` bytes around it also start in a document with a smaller doc_id, judged on
    the texts as given. Null texts count as empty; texts shorter than `width` lose nothing. A null doc_id
    counts as the greatest LONG: it comes after every other. Rows that share an id remove nothing from one
    another, so of rows repeated under one id all stay alike. Extra columns are ignored.
    """
    if width < 2:
        raise ValueError("width must be 2 or more")
    texts = _texts(docs)
    told = _brought(texts, stored(repeated_spans(texts, width))).select("doc_id", "_hash", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, spans, kept = [], [], []
            for data, mine in zip(_utf8(part.column(2)).to_pylist(), _own(part.column(3), part.column(1))):
                mine = mine[mine[:, 1] - mine[:, 0] >= width]
                sizes.append(len(data))
                if not len(mine):
                    spans.append([])
                    kept.append(data)
                    continue
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, mine[:, 0], 1)
                np.add.at(edge, mine[:, 1], -1)
                gone = np.cumsum(edge) > 0
                turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])])
                kept.append(np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return told.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
