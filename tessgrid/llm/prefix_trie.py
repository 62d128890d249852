"""Prefix trie of conversations: which openings they share, and what sharing them saves.

1. Conversations are sequences of 16-byte turn digests. Equal ones become one row with a count; the ids
   behind a row are digested as a stream of sorted chunks, never as one list.
2. The distinct sequences are range-partitioned in lexicographic order.
3. In a partition, the common prefix of each two sorted neighbours is an edge. Edges are taken in
   descending depth through a union-find: every merge of two components creates the branching node at
   that depth. Components carry sums over their members, so each node's figures are known when it closes,
   those of its whole subtree included. Nodes between two branchings follow from the lower one.
4. Nodes whose prefix goes on in a neighbouring partition stay open. There are at most as many per
   partition as its first and last sequence are long. A forest is thereby contracted to the partial sums of
   its open nodes, and forests are merged across boundaries by adding these up by node.

For a node v with members c, the words its subtree saves are sum over nodes u of (n(u) - 1) * words(u), which
is sum over c of words of c from v's depth on, less the words of all distinct nodes below and at v. Both
are sums that components, and partitions, can add.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.llm.common import stored, word_count
from tessgrid.operators.ordered import salted_join

#: Every conversation takes its opening from the one whose id is this multiple; openings are below HEADS turns.
GROUP, HEADS = 20, 4
#: Turns of distinct conversations that a partition holds, about.
TURNS = 100_000
_DIGEST = 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "member_words long, node_words long, words_above long, ends_sha256 string, open_id binary, parent_open_id binary"
)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, id, words) in order of turn, null first, then of the turn's digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role), F.lit(":"), role, text).cast("binary"))
    told = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.struct("turn", digest.alias("id"), word_count(text).alias("words")).alias("t")
    )
    return told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def opening(conv_id: str | Column = "conv_id") -> Column:
    """How many turns a conversation takes over from the first of its group."""
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the first `opening()` turns of the group's first conversation, then the own turns
    after as many."""
    own = stored(turn_sequences(conversations))
    heads = own.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, HEADS - 1).alias("_head")
    )
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("_base"), "left")
    none = F.slice("turns", 1, 0)
    return joined.select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("_head", none), F.lit(1), opening()),
            F.slice("turns", opening() + 1, F.greatest(F.size("turns") - opening(), F.lit(0))),
        ).alias("turns"),
    )


def ends_digests(members: DataFrame) -> DataFrame:
    """seq_id, ends_sha256: digest of the ascending ids of each sequence's conversations, joined by commas.
    `members`: seq_id, conv_id, unique. Ids travel in sorted chunks and are hashed as they come."""
    chunk = F.shiftright("conv_id", 8)
    chunks = members.groupBy("seq_id", chunk.alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: list) -> pa.RecordBatch:
            ids, hashes = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(hashes, pa.string())], ["seq_id", "ends_sha256"])

        now, state = None, None
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = seq, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield told(done)
        if now is not None:
            yield told([(now, state.hexdigest())])

    placed = chunks.repartition("seq_id").sortWithinPartitions("seq_id", "chunk")
    return placed.select("seq_id", "ids").mapInArrow(digest, "seq_id binary, ends_sha256 string")


def _common(a: bytes, b: bytes) -> int:
    """Number of leading digests that two sequences share."""
    low, high = 0, min(len(a), len(b)) // _DIGEST
    if a[: high * _DIGEST] == b[: high * _DIGEST]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * _DIGEST] == b[: mid * _DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def _prefix_ids(key: bytes, most: int) -> list[bytes]:
    """Digest of each prefix of 0 to `most` turns."""
    state, found = hashlib.md5(), [hashlib.md5().digest()]
    for t in range(most):
        state.update(key[t * _DIGEST : (t + 1) * _DIGEST])
        found.append(state.copy().digest())
    return found


def forest(
    rows: list[tuple[bytes, list[int], int, int, str]], before: bytes | None, after: bytes | None
) -> list[dict]:
    """Nodes of one partition. `rows`: key, words per turn, number of conversations, smallest id and digest
    of the ids, in order of key. `before` and `after` are the neighbouring keys in other partitions.

    Open nodes have an open_id; their figures are this partition's part of them.
    """
    m = len(rows)
    keys = [r[0] for r in rows]
    above = []  # words of the first t turns of each row
    for r in rows:
        sums = [0]
        for w in r[1]:
            sums.append(sums[-1] + w)
        above.append(sums)
    lcp = [0] + [_common(keys[i - 1], keys[i]) for i in range(1, m)]
    left = -1 if before is None else _common(before, keys[0])
    right = -1 if after is None else _common(keys[-1], after)
    ids = [_prefix_ids(keys[0], max(left, 0)), _prefix_ids(keys[-1], max(right, 0))]

    root = list(range(m))
    first, last = list(range(m)), list(range(m))
    top = [len(k) // _DIGEST for k in keys]
    n, conv = [r[2] for r in rows], [r[3] for r in rows]
    member_words = [r[2] * sums[-1] for r, sums in zip(rows, above)]
    node_words, kids = [0] * m, [0] * m
    ends: list[str | None] = [r[4] for r in rows]
    follows = [lcp[i + 1] if i + 1 < m else right for i in range(m)]
    leaves = [int(follows[i] < top[i]) for i in range(m)]
    waiting: list[list[dict]] = [[] for _ in range(m)]
    nodes: list[dict] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def close(c: int) -> bool:
        """Write the top node of component c; says whether this partition counts it."""
        t, sums = top[c], above[first[c]]
        open_left, open_right = first[c] == 0 and t <= left, last[c] == m - 1 and t <= right
        mine = not open_left
        if t and mine:
            node_words[c] += sums[t] - sums[t - 1]
        open_id = ids[0][t] if open_left else ids[1][t] if open_right else None
        node = {
            "conv_id": conv[c], "depth": t, "parent_conv_id": None, "n_convs": n[c], "n_children": kids[c],
            "n_leaves": leaves[c], "member_words": member_words[c], "node_words": node_words[c],
            "words_above": sums[t - 1] if t else 0, "ends_sha256": ends[c], "open_id": open_id,
            "parent_open_id": None,
        }
        nodes.append(node)
        for child in waiting[c]:
            child["parent_open_id" if open_id is not None else "parent_conv_id"] = open_id if open_id is not None else conv[c]
        waiting[c] = [node]
        return mine

    def rise(c: int, depth: int) -> None:
        while top[c] > depth:
            kids[c] = int(close(c))
            ends[c] = None
            top[c] -= 1

    for i in sorted(range(1, m), key=lambda i: -lcp[i]):
        a, b = find(i - 1), find(i)
        rise(a, lcp[i])
        rise(b, lcp[i])
        if len(waiting[a]) < len(waiting[b]):
            into, gone = b, a
        else:
            into, gone = a, b
        root[gone] = into
        first[into], last[into] = first[a], last[b]
        conv[into] = min(conv[a], conv[b])
        ends[into] = ends[a] or ends[b]
        waiting[into].extend(waiting[gone])
        for sums in (n, member_words, node_words, kids, leaves):
            sums[into] += sums[gone]
    if m:
        whole = find(0)
        rise(whole, 0)
        close(whole)
    return nodes


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `sequences`: conv_id, unique, and turns, an array of (turn, id, words). The root (depth 0) is the prefix
    of all, empty sequences included. An empty table has no nodes. A sequence must fit a row: 16 bytes a
    turn and its number of words.
    """
    spark = sequences.sparkSession
    ids = F.transform("turns", lambda t: t["id"])
    keyed = stored(
        sequences.select(
            "conv_id",
            F.unhex(F.array_join(ids, "")).alias("key"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
        ).withColumn("seq_id", F.unhex(F.md5("key")))
    )
    distinct = (
        keyed.groupBy("seq_id", "key", "words")
        .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
        .join(ends_digests(keyed.select("seq_id", "conv_id")).hint("merge"), "seq_id")
        .drop("seq_id")
    )
    distinct = stored(distinct)
    size = distinct.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    ranged = distinct.repartitionByRange(max(1, ceil(size / TURNS)), "key")
    ranged = stored(ranged.withColumn("pid", F.spark_partition_id()))
    # One row per partition.
    edges = ranged.groupBy("pid").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("pid")
    edges = edges.select("pid", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    blank = ranged.sparkSession.createDataFrame([], ranged.schema)
    both = ranged.withColumn("side", F.lit(0))
    for name, side in (("before", -1), ("after", 1)):
        rows = edges.where(F.col(name).isNotNull()).select("pid", F.col(name).alias("key"))
        both = both.unionByName(
            blank.unionByName(rows, allowMissingColumns=True).withColumn("side", F.lit(side))
        )

    def build(table: pa.Table) -> pa.Table:
        by_side: dict[int, list] = {-1: [], 0: [], 1: []}
        columns = [table.column(c).to_pylist() for c in ("side", "key", "words", "n", "conv_id", "ends_sha256")]
        for side, *row in zip(*columns):
            by_side[side].append(tuple(row))
        rows = sorted(by_side[0], key=lambda r: r[0])
        found = forest(rows, *(by_side[s][0][0] if by_side[s] else None for s in (-1, 1)))
        return pa.Table.from_pylist(found, schema=_ARROW)

    nodes = stored(both.groupBy("pid").applyInArrow(build, _NODES))
    merged = nodes.where("open_id IS NOT NULL").groupBy("open_id").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "member_words", "node_words")],
        F.min("words_above").alias("words_above"), F.max("ends_sha256").alias("ends_sha256"),
        F.max("parent_open_id").alias("parent_open_id"),
    )
    merged = stored(merged)
    whole = nodes.where("open_id IS NULL").drop("open_id").unionByName(
        merged.withColumn("parent_conv_id", F.lit(None).cast("long")).drop("open_id")
    )
    parents = merged.select(F.col("open_id").alias("parent_open_id"), F.col("conv_id").alias("_parent"))
    # A root has children in every partition.
    told = salted_join(whole, parents, ["parent_open_id"], F.xxhash64("conv_id"))
    saved = F.col("member_words") - F.col("n_convs") * F.col("words_above") - F.col("node_words")
    return told.select(
        "conv_id", "depth",
        F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


_ARROW = pa.schema(
    [(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in _NODES.split(", "))]
)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of all rebuilt conversations (see `rebuilt` and `prefix_trie`).

    Null roles and texts count as empty; a null turn comes first; turns that tie go by a digest of role and
    text, and rows repeated count as often as they occur. Rows without a conv_id belong to no conversation
    and are left out. Extra columns are ignored.
    """
    return prefix_trie(rebuilt(conversations))
