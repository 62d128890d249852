"""Join of documents whose sets of five-word shingles are alike: Jaccard similarity of 0.8 or more.

1. Sets. Shingles are 64-bit hashes; documents with equal sets are one *node* from here on.
2. Routing. A pair that links differs in at most (n + m) / 9 <= n / 4 shingles. Shingles are dealt into
   buckets by hash; each difference spoils one bucket of a document at most, so if a document has more
   than n / 4 buckets that count, every partner shares one of them whole. The hash of a whole bucket is
   its routing key. At level 0 only buckets of two shingles or more count, which keeps documents apart
   that merely share a passage; a document with too few of those also offers all its buckets (level 1),
   and if those are too few each shingle by itself (level 2). Both of a pair reach a level if the level
   before helps neither, so no pair is lost.
   A key that very many sets offer is *hot*. A document that has more than n / 4 level-0 keys that are not
   hot leaves the hot ones: a partner shares one of the others with it, and offers that too, as nobody
   leaves a key that is not hot. If both of a pair have too few of those, both keep their hot keys. So lists
   of hot keys hold documents that consist of hot passages, not all that contain one.
3. Rounds. In each list of nodes with a common key, first every member is held against one leader; links
   merge nodes into components. In a list whose members then still lie in different components, the
   members of different components whose bit sketches allow a link are held against each other, lists with
   much the same members as one list. Sketches have a bit or more for each shingle, so unlike sets do not pass, however long. A group
   of near copies thus costs one comparison per member, and no list is ever turned into all its pairs.
4. T-occurrence search. A comparison searches the leader's shingles in the inverted lists of its
   candidates: the longest lists are left out, the short ones are merged by a heap, candidates that may
   still reach the overlap are probed in the long ones by binary search (DivideSkip).

Hash collisions are the only source of error: two shingles of one comparison (about n * m / 2**64), or two
sets in the whole corpus (one expected among six billion distinct sets).
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from itertools import groupby
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessgrid.llm.common import numbered, one_per_group, stored, whole_text
from tessgrid.llm.graph import components
from tessgrid.llm.workers import Memo, release, slices

WORDS = 5
#: Similarity at which documents link, in percent.
PERCENT = 80
#: Bits of a sketch at least; larger sets have the power of two from their size on.
SKETCH_BITS = 512
#: Sets that offer a key from which on it is hot.
HOT = 512
#: Leaders tried per list before the members of different components are held against each other.
STAR_ROUNDS = 2
#: Candidates of one search, members of one chunk of a list, and entries a task holds before it passes
#: them on. Larger groups are cut into several, none is left out.
SEARCH, CHUNK, HELD = 256, 20_000, 1_000_000
#: Node ids that are broadcast to find the documents of candidates; more of them are joined by shuffle.
BROADCAST_NODES = 1_000_000

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: Memo, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text. bytes.lower and bytes.split know exactly the
    letters A-Z and the six blanks."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(width, len(ids))
    total = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * _ODD[i % len(_ODD)] + ids[i : len(ids) - k + 1 + i]
    return np.unique(mixed(total))


def node_id(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of classes of shingles, a power of two of them, as LONGs. Two sketches of one size differ in
    no more bits than the sets differ in shingles; so do a sketch and a larger one folded."""
    bits = max(SKETCH_BITS, 1 << (max(1, len(shingles)) - 1).bit_length())
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half the size: classes half a size apart are one class there."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def _bucket_keys(shingles: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of shingles of every occupied bucket. 3 shingles a bucket at the top of an octave."""
    buckets = max(2, ceil(2 ** (octave + 1) / 3))
    at = mixed(shingles, octave + 1) % np.uint64(buckets)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sums = np.add.reduceat(mixed(shingles[order], 1000 + octave), first)
    counts = np.diff(np.append(first, len(at)))
    return mixed(sums + at[first], 2000 + octave), counts


OWN, NEXT, OTHER = 0, 1, 2


def routing_keys(shingles: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Keys of which any two sets that link share one, unless they are equal; the kind of each: level 0 in
    the octave of the set's size (OWN) or in the next one (NEXT), which a set offers too if a partner's size
    may lie there, or another level (OTHER); and by how many the level-0 keys of both octaves exceed the
    shingles in which a partner may differ."""
    n = len(shingles)
    differ = _most_different(n, percent)
    if differ < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), [0, 0]
    own = n.bit_length() - 1
    octaves = [own, own + 1] if n * 100 // percent >= 2 ** (own + 1) else [own]
    keys, kinds, spare = [], [], [0, 0]
    for kind, octave in enumerate(octaves):
        found, counts = _bucket_keys(shingles, octave)
        strong = found[counts > 1]
        offered = [(strong, kind)]
        spare[kind] = len(strong) - differ
        if len(strong) <= differ:
            offered.append((mixed(found, 1), OTHER))
            if len(found) <= differ:
                offered.append((mixed(shingles, 3000 + octave), OTHER))
        for some, of_kind in offered:
            keys.append(some)
            kinds.append(np.full(len(some), of_kind, np.uint8))
    keys, first = np.unique(np.concatenate(keys), return_index=True)
    return keys, np.concatenate(kinds)[first], spare


def _most_different(n: int, percent: int) -> int:
    """Shingles by which a set of n may differ from one that links with it: at most
    (1 - s) / (1 + s) * (n + m), where m <= n / s."""
    largest = n * 100 // percent
    return (100 - percent) * (n + largest) // (100 + percent)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node, shingles per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Memo(xxhash.xxh3_64_intdigest)
        for part in slices(batches):
            found = [shingle_set(t, words, width) for t in part.column(0).to_pylist()]
            columns = [
                pa.array([node_id(s) for s in found], pa.int64()),
                pa.array([s.tobytes() for s in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])
        release()

    return docs.select(whole_text().alias("text")).mapInArrow(run, "node long, shingles binary")


_READ = pa.schema(
    [
        ("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.list_(pa.int64())),
        ("spare_own", pa.int64()), ("spare_next", pa.int64()),
        ("part", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("kinds", pa.binary()),
    ]
)
_READ_DDL = (
    "doc_id long, node long, n_shingles long, sketch array<long>, spare_own long, spare_next long, "
    "part int, keys binary, nodes binary, kinds binary"
)


def _read(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every text is hashed once. A row per document: doc_id, node, n_shingles, sketch, spare_own, spare_next;
    and the routing keys of its node, packed: a task sends one row per part of the key space at a time."""
    parts = 4 * max(2, docs.rdd.getNumPartitions())

    def rows_of(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        arrays = [columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _READ]
        return pa.RecordBatch.from_arrays(arrays, schema=_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Memo(xxhash.xxh3_64_intdigest)
        seen, keys, nodes, kinds, held = set(), [], [], [], 0

        def packed() -> pa.RecordBatch:
            key, node, kind = np.concatenate(keys), np.concatenate(nodes), np.concatenate(kinds)
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, node, kind, part = key[order], node[order], kind[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(at[1:], len(part))
            cut = {
                name: pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())
                for name, x in (("keys", key), ("nodes", node), ("kinds", kind))
            }
            return rows_of({"part": pa.array(part[at], pa.int32()), **cut})

        for batch in slices(batches):
            of_doc, sizes, sketches, spares = [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, words, width)
                node = node_id(shingles)
                mine, of_kind, spare = routing_keys(shingles, percent)
                of_doc.append(node)
                sizes.append(len(shingles))
                sketches.append(sketch(shingles))
                spares.append(spare)
                if len(mine) and node not in seen:
                    seen.add(node)
                    keys.append(mine)
                    nodes.append(np.full(len(mine), node, np.int64))
                    kinds.append(of_kind)
                    held += len(mine)
            yield rows_of(
                {
                    "doc_id": batch.column(0).cast(pa.int64()),
                    "node": pa.array(of_doc, pa.int64()),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "sketch": pa.ListArray.from_arrays(
                        np.cumsum([0, *map(len, sketches)], dtype=np.int32), np.concatenate(sketches)
                    ),
                    "spare_own": pa.array([s[OWN] for s in spares], pa.int64()),
                    "spare_next": pa.array([s[NEXT] for s in spares], pa.int64()),
                }
            )
            if held >= HELD:
                yield packed()
                keys, nodes, kinds, held = [], [], [], 0
        if held:
            yield packed()
        release()

    told = stored(docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, _READ_DDL))
    documents = told.where("part IS NULL").select("doc_id", "node", "n_shingles", "sketch", "spare_own", "spare_next")
    return documents, told.where("part IS NOT NULL").select("part", "keys", "nodes", "kinds")


def _lists(packed: DataFrame, nodes: DataFrame) -> DataFrame:
    """list_id, node: nodes that share a routing key, hot ones as far as needed. Equal lists appear once."""

    def gathered(table: pa.Table) -> pa.Table:
        key, node, kind = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), t)
            for c, t in (("keys", np.uint64), ("nodes", np.int64), ("kinds", np.uint8))
        )
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        key, node, kind = key[order], node[order], kind[order]
        order = np.lexsort((node, key))
        key, node, kind = key[order], node[order], kind[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, kind = key[new], node[new], kind[new]
        opens = np.ones(len(key), bool)
        opens[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(opens)
        sizes = np.diff(np.append(first, len(key)))
        # Lists with the same members are one list.
        total = np.add.reduceat(mixed(node.view(np.uint64), 7), first) if len(first) else np.zeros(0, np.uint64)
        of_list = mixed(total + sizes.astype(np.uint64), 8)
        once = np.zeros(len(first), bool)
        once[np.unique(of_list, return_index=True)[1]] = True
        few = np.repeat(once & (sizes > 1) & (sizes <= HOT), sizes)
        hot = np.repeat(sizes > HOT, sizes)
        of_row = np.repeat(of_list, sizes).view(np.int64)
        # Hot lists count once per key: how many hot keys a node has decides whether it needs them.
        lists, members, kinds = of_row[hot], node[hot], kind[hot]
        order = np.lexsort((kinds, members, lists))
        lists, members, kinds = lists[order], members[order], kinds[order]
        start = np.ones(len(lists), bool)
        start[1:] = (lists[1:] != lists[:-1]) | (members[1:] != members[:-1]) | (kinds[1:] != kinds[:-1])
        at = np.flatnonzero(start)
        times = np.diff(np.append(at, len(lists)))
        n_few = int(few.sum())
        return pa.table(
            {
                "list_id": pa.array(np.concatenate([of_row[few], lists[at]])),
                "node": pa.array(np.concatenate([node[few], members[at]])),
                "kind": pa.array(np.concatenate([np.full(n_few, -1), kinds[at]]).astype(np.int32)),
                "n_keys": pa.array(np.concatenate([np.ones(n_few, np.int64), times])),
            }
        )

    found = stored(packed.groupBy("part").applyInArrow(gathered, "list_id long, node long, kind int, n_keys long"))
    few = found.where("kind < 0").select("list_id", "node")
    hot = found.where("kind >= 0")
    spent = hot.where(F.col("kind") < OTHER).groupBy("node", "kind").agg(F.sum("n_keys").alias("spent"))
    spare = nodes.select(F.col("node").alias("_node"), "spare_own", "spare_next")
    short = (
        spent.join(spare.hint("merge"), F.col("node") == F.col("_node"))
        .where(F.col("spent") >= F.when(F.col("kind") == OWN, F.col("spare_own")).otherwise(F.col("spare_next")))
        .select("node", "kind")
    )
    needed = hot.join(short.hint("merge"), ["node", "kind"], "left_semi").unionByName(hot.where(F.col("kind") == OTHER))
    return few.unionByName(needed.select("list_id", "node")).distinct()


def occurrences(query: np.ndarray, candidates: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Places of the candidates that link with the query: DivideSkip over their inverted lists."""
    n = len(query)
    lists: list[list[int]] = [[] for _ in range(n)]
    for place, other in enumerate(candidates):
        at = np.searchsorted(query, other)
        at[at == n] = 0
        for i in at[query[at] == other]:
            lists[i].append(place)  # places come in ascending order
    lists = sorted((x for x in lists if x), key=len)
    least = -(-percent * n // 100)  # no union is smaller than the query
    if len(lists) < least:
        return []
    n_long = min(least - 1, int(least / (0.01 * log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    links = []
    for place, run in groupby(heapq.merge(*short)):
        both = sum(1 for _ in run)
        if both < least - n_long:
            continue
        m = len(candidates[place])
        need = -(-percent * (n + m) // (100 + percent))
        left = len(long)
        for one in long:
            if both + left < need:
                break
            at = bisect.bisect_left(one, place)
            both += at < len(one) and one[at] == place
            left -= 1
        if 100 * both >= percent * (n + m - both):
            links.append(place)
    return links


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: the pairs that link. Searches hold a leader and at most about SEARCH candidates."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    bearers = wanted.join(nodes.select("node", "doc"), "node").select(F.col("doc").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_NODES:
        bearers = F.broadcast(bearers)
    # The only bearers of a node may have null ids, which no join finds.
    read = docs.join(bearers, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    sets = _sets(read, width).join(wanted, "node", "left_semi")
    sets = stored(sets.dropDuplicates(["node"]))
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SEARCH)
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(1)) / SEARCH))
    searches = pairs.join(sizes, "a", "left").select("a", "b", chunk.alias("chunk"))
    sides = searches.join(sets, searches["b"] == sets["node"]).select("a", "chunk", "node", "shingles")
    leaders = (
        searches.select("a", "chunk").distinct().join(sets, F.col("a") == F.col("node"))
        .select("a", "chunk", F.lit(None).cast("long").alias("node"), "shingles")
    )

    def search(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        arrays = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        query = arrays[nodes.index(None)]
        others = [i for i, x in enumerate(nodes) if x is not None]
        found = [nodes[others[i]] for i in occurrences(query, [arrays[i] for i in others], percent)]
        a = table.column("a")[0].as_py()
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return sides.unionByName(leaders).groupBy("a", "chunk").applyInArrow(search, "a long, b long")


def _may_link(percent: int) -> F.Column:
    """From sizes and sketches alone: could (n_a, sketch_a) and (n_b, sketch_b) link? Sizes that may link are
    an octave apart at most."""

    def fold(name: str, other: str) -> F.Column:
        half = (F.size(name) / 2).cast("int")
        both = F.zip_with(F.slice(name, F.lit(1), half), F.slice(name, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > F.size(other), both).otherwise(F.col(name))

    apart = F.aggregate(
        F.zip_with(fold("sketch_a", "sketch_b"), fold("sketch_b", "sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    total = F.col("n_a") + F.col("n_b")
    return (F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100) & (
        apart * (100 + percent) <= total * (100 - percent)
    )


def _star_pairs(lists: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every member of a list with the list's leader, where labels differ. `lists`: list_id, node, label."""
    leaders = lists.groupBy("list_id").agg(
        F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("leader")
    )
    pairs = (
        lists.join(leaders, "list_id")
        .where("label <> leader.label")
        .select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    return _filtered(pairs, nodes, percent)


def _filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    told = nodes.select("node", "n_shingles", "sketch")
    left, right = (told.toDF(s, f"n_{s}", f"sketch_{s}") for s in "ab")
    return pairs.join(left, "a").join(right, "b").where(_may_link(percent)).select("a", "b")


def _pooled(lists: DataFrame) -> DataFrame:
    """list_id, node, label: lists that hold much the same nodes as one list of all of them, so that a pair
    meets once and not in each of its common lists. Lists whose nodes have the same least hash are pooled
    unless the pool has more than twice the pairs of its lists together. No pair is lost."""
    sizes = lists.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node")).alias("pool")
    )
    placed = lists.join(sizes.select("list_id", "pool").hint("merge"), "list_id")
    inside = placed.groupBy("pool", "node").agg(F.first("label").alias("label"))
    held = inside.groupBy("pool").agg(F.count(F.lit(1)).cast("double").alias("held"))
    work = sizes.groupBy("pool").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
    close = held.join(work.hint("merge"), "pool").where("held * held <= 2 * work").select("pool")
    apart = placed.join(close.hint("merge"), "pool", "left_anti").select("list_id", "node", "label")
    pools = inside.join(close.hint("merge"), "pool", "left_semi").select(F.col("pool").alias("list_id"), "node", "label")
    return pools.unionByName(apart)


def _cross_pairs(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Members of a list with different labels that may link. Members outside the largest label of a list
    meet all members; a long list is met chunk by chunk."""
    lists = stored(_pooled(lists))
    by_label = lists.groupBy("list_id", "label").agg(F.count(F.lit(1)).alias("n"))
    about = by_label.groupBy("list_id").agg(
        F.max_by("label", F.struct("n", "label")).alias("most"), F.ceil(F.sum("n") / CHUNK).alias("chunks")
    )
    placed = lists.join(about, "list_id").join(nodes.select("node", "n_shingles", "sketch"), "node")
    home = F.pmod(F.xxhash64("node"), F.col("chunks"))
    members = placed.select("list_id", home.alias("chunk"), "node", "label", "n_shingles", "sketch", F.lit(False).alias("asks"))
    asking = placed.where("label <> most").select(
        "list_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
        "node", "label", "n_shingles", "sketch", F.lit(True).alias("asks"),
    )

    def meet(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        node, label, size = (table.column(c).to_numpy() for c in ("node", "label", "n_shingles"))
        of_row = [np.array(x, np.int64).view(np.uint64) for x in table.column("sketch").to_pylist()]
        length = np.fromiter(map(len, of_row), np.int64, len(of_row))
        # Members by length of sketch, in order of size: only a stretch of sizes can link with a set.
        here, sizes, whole, half = {}, {}, {}, {}
        for k in map(int, np.unique(length)):
            at = np.flatnonzero(~asks & (length == k))
            if len(at):
                at = at[np.argsort(size[at], kind="stable")]
                here[k], sizes[k], whole[k] = at, size[at], np.stack([of_row[i] for i in at])
                if k > 1:
                    half[k] = folded(whole[k])
        a, b = [], []
        for i in np.flatnonzero(asks):
            k, least, most = int(length[i]), -(-size[i] * percent // 100), size[i] * 100 // percent
            for other in (k // 2, k, 2 * k):
                if other not in here:
                    continue
                low, high = np.searchsorted(sizes[other], least), np.searchsorted(sizes[other], most, "right")
                if low == high:
                    continue
                at = here[other][low:high]
                mine = folded(of_row[i]) if other < k else of_row[i]
                bits = (half if other > k else whole)[other][low:high]
                apart = np.bitwise_count(bits ^ mine).sum(axis=1)
                may = (label[at] != label[i]) & (
                    apart.astype(np.int64) * (100 + percent) <= (size[at] + size[i]) * (100 - percent)
                )
                found = node[at[may]]
                a.append(np.minimum(found, node[i]))
                b.append(np.maximum(found, node[i]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        release()
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    met = members.unionByName(asking).groupBy("list_id", "chunk").applyInArrow(meet, "a long, b long")
    return met.distinct()


def similar_groups(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included).

    Null and empty texts and texts of blanks have no shingles and link with nothing. With fewer words than
    `width`, the whole sequence is the one shingle. Documents with equal sets link. A null doc_id takes
    part; a component of null ids alone has component_id null. Rows repeated under one id are copies.
    Extra columns are ignored. `percent` must be 50 or more.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be in 50..100")
    docs = docs.select("doc_id", "text")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    rows, packed = _read(docs, width, percent)
    about = ("n_shingles", "sketch", "spare_own", "spare_next")
    nodes = stored(
        rows.where("n_shingles > 0")
        .groupBy("node", spread.alias("s"))
        .agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in about])
        .groupBy("node")
        .agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in about])
    )
    lists = stored(_lists(packed, nodes))
    open_lists = lists.withColumn("label", F.col("node"))
    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        make = _star_pairs if turn < STAR_ROUNDS else None
        pairs = stored(make(open_lists, nodes, turn, percent) if make else _cross_pairs(open_lists, nodes, percent))
        found = _verified(pairs, docs, nodes, width, percent)
        links = stored(found if links is None else links.unionByName(found))
        labels = components(links)
        told = labels.withColumnRenamed("node", "_node")
        now = lists.join(told, F.col("node") == F.col("_node"), "left").select(
            "list_id", "node", F.coalesce("label", "node").alias("label")
        )
        mixed_up = now.groupBy("list_id").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        open_lists = stored(now.join(mixed_up.select("list_id"), "list_id"))
        if open_lists.isEmpty():
            break
    ends = nodes.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "node", "doc", F.coalesce("label", "node").alias("label")
    )
    smallest = ends.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_node = ends.join(smallest, "label").select(
        F.col("node").alias("_node"), F.col("component_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_s")
    )
    # A set with very many copies is met by 16 tasks.
    return rows.join(
        of_node.hint("merge"),
        (F.col("node") == F.col("_node")) & (spread == F.col("_s")) & (F.col("n_shingles") > 0),
        "left",
    ).select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """Exactly one row of each component, all columns as they were: the smallest doc_id, null last. Rows are
    told apart by their stored number, so ids may repeat or be null."""
    rows = numbered(docs)
    groups = similar_groups(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), **settings)
    return one_per_group(rows, groups.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")), [])
