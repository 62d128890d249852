"""Phrase collocation mining: the best phrases of two to four words per language, by best-first growth.

The score of a phrase is that of its worst cut in two, 2e6 * a / (l + r). For a phrase x and any phrase y that
grows from x to the right, a(y) <= f(x), and the rest of y after its first word occurs a(y) times at least. As
2e6 * a / (l + a) rises with a, no such y scores above 2e6 * f(x) / (f(first word of x) + f(x)). Growth to the
left is bounded likewise by the last word. The larger of both is the *bound* of x: every phrase that x begins
or ends, x itself included, scores at most that, and the bound of a phrase never exceeds both bounds of its
parts.

1. Texts become rows of word hashes, written once; all counting reads those.
2. Words and pairs are counted. Pairs that occur often enough are the frontier.
3. Best first: the frontier above a level tau, chosen per language from counts of bounds, grows by one word to
   either side, then so do the phrases of three words above tau. Any phrase that scores tau or more, all its
   parts, and all that may contain it by one word more, are counted then.
4. A language is settled once its 2000th surviving score reaches tau: what was not grown cannot reach it, not
   even to tie. For the others tau falls and more of the frontier grows, until all of it has.

A phrase within a longer one at 80% of its count is within one of one word more at that count or above, so
step 3 sees all that may drop it.

Filters sent to tasks are bitmaps of fixed size over hashed phrases: they only save work, as counts are joined
by key. Phrases are told apart by 64-bit hashes; two that occur often enough collide once in 6 billion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessgrid.llm.common import stored, whole_text
from tessgrid.llm.jaccard import mixed
from tessgrid.llm.workers import Memo, release, slices
from tessgrid.operators.ordered import salted_join

#: Phrases reported per language, least count, longest phrase, percent at which a longer one drops a phrase.
TOP, LEAST, LONGEST, WITHIN = 2000, 30, 4, 80
SCALE = 2_000_000
#: Size of the first slice of a language's frontier as a multiple of TOP, and how much larger each next is.
SLICE, WIDER = 4, 8
#: Words to a row of hashes, cut where pieces part; rows that a task is handed at a time. What a task holds
#: follows from these, not from how the documents were stored.
WORDS_AT_ONCE, ROWS_AT_ONCE = 32_768, 8
#: Rows of hashes are stored in small pages and row groups, of which a task reads one at a time, and decoded a
#: few at a time, as equal texts take next to no room in a row group. By default sizes are looked at every 100
#: rows only.
_SMALL = {
    "parquet.block.size": str(4 << 20), "parquet.page.size": str(1 << 20),
    "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "8",
}
#: Bits of a filter; keys a task counts at a time, and in how many batches it sends them; words a task merges
#: at a time, about; bounds per step of a histogram; phrases that a task remembers it has told.
FILTER_BITS, HELD, BATCHES, MERGED, STEP, TOLD_BITS = 24, 2_000_000, 16, 1_000_000, 1000, 18

#: What parts a text, [.,;:!?\x0A-\x0D]. 0xFF never occurs in UTF-8 and stands for them here.
_PARTS = b".,;:!?\n\x0b\x0c\r"
_CUT = b"\xff"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _PARTS, b"abcdefghijklmnopqrstuvwxyz " + _CUT * len(_PARTS)
)
_PRIME = np.uint64(0x9FB21C651E98DF25)


def words_of(text: str) -> list[bytes]:
    """Words of a text in order, with _CUT between pieces."""
    return text.encode().translate(_TABLE).replace(_CUT, b" " + _CUT + b" ").split()


def word_id(word: bytes) -> int:
    return 0 if word == _CUT else xxhash.xxh3_64_intdigest(word) or 1


def cut_rows(ids: np.ndarray) -> list[np.ndarray]:
    """The same hashes in rows of about WORDS_AT_ONCE, each of whole pieces. The last of `ids` is 0."""
    ends = np.flatnonzero(ids == 0) + 1
    at = ends[np.searchsorted(ends, np.arange(WORDS_AT_ONCE, len(ids), WORDS_AT_ONCE))]
    return np.split(ids, np.unique(at[at < len(ids)]))


def word_rows(docs: DataFrame) -> DataFrame:
    """lang, n_words, ids, words: hashes of some words of a language (0 parts pieces and documents), and the
    words that the task had not met before, by lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[bytes] = []

        def find(word: bytes) -> int:
            if word != _CUT:
                fresh.append(word)
            return word_id(word)

        memo = Memo(find)
        for part in slices(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = words_of(text)
                ids = np.zeros(len(found) + 1, np.uint64)
                ids[:-1] = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
                by_lang.setdefault(lang, []).append(ids)
            told = [(lang, x) for lang, ids in by_lang.items() for x in cut_rows(np.concatenate(ids))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in told], pa.string()),
                    pa.array([int(np.count_nonzero(x)) for _, x in told], pa.int64()),
                    pa.array([x.tobytes() for _, x in told], pa.binary()),
                    pa.array([b"\n".join(fresh)] + [b""] * (len(told) - 1), pa.binary()),
                ],
                ["lang", "n_words", "ids", "words"],
            )
            fresh.clear()
        memo.clear()
        memo.old = {}
        release()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    return stored(rows.mapInArrow(run, "lang string, n_words long, ids binary, words binary"), "zstd", options=_SMALL)


def word_keys(lang: str, ids: np.ndarray) -> np.ndarray:
    """Keys of single words. Languages are hashed apart from words: a word may be spelt like a language."""
    return mixed(ids ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=1)))


def phrase_keys(words: list[np.ndarray]) -> np.ndarray:
    """Keys of phrases from the keys of their words: first words, second words and so on."""
    if len(words) == 1:
        return words[0]
    total = np.full(len(words[0]), len(words), np.uint64)
    for word in words:
        total = total * _PRIME + word
    return mixed(total, len(words))


class Grams:
    """Keys of all phrases of one row. A phrase's key depends on its language and words alone."""

    def __init__(self, lang: str, ids: bytes):
        self.ids = np.frombuffer(ids, np.uint64)
        #: Names the row, such that a phrase can be asked of one row alone; equal rows share it.
        self.row = xxhash.xxh3_64_intdigest(ids) & 0xFFFFFFFF
        self.word = word_keys(lang, self.ids)
        self.real = self.ids != 0

    def keys(self, n: int) -> np.ndarray:
        """Key of the n words from each place on."""
        size = max(0, len(self.word) - n + 1)
        return phrase_keys([self.word[i : i + size] for i in range(n)])

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each place on lie in one piece."""
        size = max(0, len(self.word) - n + 1)
        return np.logical_and.reduce([self.real[i : i + size] for i in range(n)])


def within(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def placed(keys: np.ndarray, row: np.ndarray | int) -> np.ndarray:
    """Hash of a phrase in a row."""
    return mixed(keys ^ (np.uint64(row) if isinstance(row, int) else row.astype(np.uint64)), 5)


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bitmap of the keys: 2**FILTER_BITS bits (2 MB), however many keys there are."""
    slot_bits = 12

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << slot_bits, np.uint8)
        bits[table.column("at").to_numpy()] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"slot": table.column("slot")[:1], "bits": pa.array([packed], pa.binary())})

    bit = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    placed = keys.select(
        F.shiftright(bit, slot_bits).alias("slot"), bit.bitwiseAND(F.lit((1 << slot_bits) - 1)).alias("at")
    )
    found = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    size = (1 << slot_bits) // 8
    for slot, bits in placed.distinct().groupBy("slot").applyInArrow(pack, "slot long, bits binary").collect():
        found[slot * size : (slot + 1) * size] = np.frombuffer(bits, np.uint8)
    return found


Choose = Callable[[Grams, int], np.ndarray]


def dealt(rows: DataFrame) -> int:
    """Parts of the key space, such that each holds about MERGED words of all rows at most."""
    n_words = rows.agg(F.sum("n_words")).first()[0] or 0
    return max(4 * max(2, rows.rdd.getNumPartitions()), -(-n_words // MERGED))


def counted(rows: DataFrame, n: int, choose: Choose | None, least: int, parts: int) -> DataFrame:
    """key, f, place: phrases of n words that occur `least` times or more, among those that `choose` lets pass.
    The place is a hash of the key and a row that holds the phrase.

    Each task counts what it holds before it sends it on, packed by part of the key space.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        of_rows: list[int] = []

        def packed() -> Iterator[pa.RecordBatch]:
            """What is held, some parts to a batch."""
            keys = np.concatenate(held)
            row = np.repeat(np.array(of_rows, np.uint32), [len(h) for h in held])
            held.clear()
            of_rows.clear()
            part = (keys % np.uint64(parts)).astype(np.int32)
            width = -(-parts // BATCHES)
            for low in range(0, parts, width):
                mine = np.flatnonzero((part >= low) & (part < low + width))
                if len(mine):
                    yield of_parts(keys[mine], row[mine])

        def of_parts(keys: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(keys)
            keys, row = keys[order], row[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n_each = np.diff(np.append(first, len(keys))).astype(np.int32)
            keys, row = keys[first], row[first]
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            keys, n_each, row, part = keys[order], n_each[order], row[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(at[1:], len(part))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(part[at], pa.int32()),
                    pa.array([keys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                    pa.array([n_each[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                    pa.array([row[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                ],
                ["part", "keys", "counts", "rows"],
            )

        for batch in slices(batches, 1):
            row = Grams(batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            use = row.whole(n)
            if choose is not None:
                use = use & choose(row, n)
            if use.any():
                held.append(row.keys(n)[use])
                of_rows.append(row.row)
            if sum(map(len, held)) >= HELD:
                yield from packed()
        if held:
            yield from packed()
        release()

    def merge(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        n_each = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        row = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint32)
        order = np.argsort(keys)
        keys, n_each, row = keys[order], n_each[order].astype(np.int64), row[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total = np.add.reduceat(n_each, at)
        often = total >= least
        at = at[often]
        return pa.table(
            {
                "key": pa.array(keys[at].view(np.int64)),
                "f": pa.array(total[often]),
                "place": pa.array(placed(keys[at], row[at]).view(np.int64)),
            }
        )

    packed_rows = rows.select("lang", "ids").mapInArrow(count, "part int, keys binary, counts binary, rows binary")
    found = packed_rows.groupBy("part").applyInArrow(merge, "key long, f long, place long")
    return stored(found, batch_rows=ROWS_AT_ONCE, read_rows=ROWS_AT_ONCE)


def described(rows: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """lang, n, key, f, ids (word hashes) and parts (keys left and right of each cut, in order) of phrases."""
    # Each phrase is read off the rows of one place, so few are told more than once.
    bits, at_place = key_filter(counts), key_filter(counts.select(F.col("place").alias("key")))
    columns = [f"w{i}" for i in range(n)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What was told last at each place of a table of fixed size; told again, a phrase is only more to gather.
        seen = np.zeros(1 << TOLD_BITS, np.uint64)
        seen[0] = 1
        for batch in slices(batches, 1):
            lang = batch.column(0)[0].as_py()
            row = Grams(lang, batch.column(1)[0].as_py())
            keys = row.keys(n)
            at = np.flatnonzero(row.whole(n) & within(bits, keys))
            at = at[within(at_place, placed(keys[at], row.row))]
            new, first = np.unique(keys[at], return_index=True)
            slot = (new & np.uint64(len(seen) - 1)).astype(np.int64)
            fresh = seen[slot] != new
            seen[slot[fresh]] = new[fresh]
            at = at[first[fresh]]
            if not len(at):
                continue
            words = [pa.array(row.ids[at + i].view(np.int64)) for i in range(n)]
            langs = pa.array([lang] * len(at), pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.array(keys[at].view(np.int64)), *words], ["lang", "key", *columns])
        release()

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            ids = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in columns], 1)
            words = np.empty_like(ids)
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])
                words[mine] = word_keys(lang, ids[mine])
            word = list(words.T)
            sides = [x for k in range(1, n) for x in (phrase_keys(word[:k]), phrase_keys(word[k:]))]
            lists = [
                pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel().view(np.int64))
                for m in (ids, np.stack(sides, 1))
            ]
            sizes = pa.array([n] * len(langs), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), sizes, batch.column("key"), batch.column("f"), *lists],
                ["lang", "n", "key", "f", "ids", "parts"],
            )

    fixed = ", ".join(f"{c} long" for c in columns)
    met = rows.select("lang", "ids").mapInArrow(find, f"lang string, key long, {fixed}")
    once = stored(met.groupBy("lang", "key").agg(*[F.max(c).alias(c) for c in columns]), batch_rows=ROWS_AT_ONCE, read_rows=ROWS_AT_ONCE)
    told = once.join(counts.select("key", "f"), "key").select("lang", "key", "f", *columns)
    schema = "lang string, n int, key long, f long, ids array<long>, parts array<long>"
    return stored(told.mapInArrow(take_apart, schema))


def _ratio(a: Column, l: Column, r: Column) -> Column:
    """floor(2e6 * a / (l + r)); the product may pass 64 bits."""
    wide = [c.cast("decimal(19,0)") for c in (a, l, r)]
    return F.call_function("div", wide[0] * F.lit(SCALE).cast("decimal(7,0)"), wide[1] + wide[2])


def bounded(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds `bound`: no phrase that this one begins or ends, itself included, scores above it."""
    ends = [
        counts.select(F.col("key").alias(f"_{side}"), F.col("f").alias(f"_f_{side}")) for side in ("first", "last")
    ]
    told = grams.withColumns({"_first": F.col("parts")[0], "_last": F.element_at("parts", -1)})
    told = told.join(ends[0], "_first").join(ends[1], "_last")
    bound = F.greatest(*[_ratio(F.col("f"), F.col(f"_f_{side}"), F.col("f")) for side in ("first", "last")])
    return told.withColumn("bound", bound).drop("_first", "_last", "_f_first", "_f_last")


def scored(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, key, ids, a, l, r, score of the phrases all of whose parts are counted. The cut that scores
    lowest counts, the earliest of several."""
    cut = F.posexplode(F.expr("transform(sequence(1, n - 1), k -> struct(parts[2 * k - 2] AS l, parts[2 * k - 1] AS r))"))
    cuts = grams.select("key", "n", "f", cut.alias("k", "cut"))
    left = counts.select(F.col("key").alias("_l"), F.col("f").alias("l"))
    right = counts.select(F.col("key").alias("_r"), F.col("f").alias("r"))
    told = cuts.join(left, F.col("cut.l") == F.col("_l")).join(right, F.col("cut.r") == F.col("_r"))
    told = told.withColumn("score", _ratio(F.col("f"), F.col("l"), F.col("r")))
    worst = told.groupBy("key", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("w"), F.count(F.lit(1)).alias("cuts")
    )
    worst = worst.where("cuts = n - 1").select("key", "w.l", "w.r", "w.score")
    return grams.join(worst, "key").select("lang", "key", "ids", F.col("f").alias("a"), "l", "r", "score")


def surviving(found: DataFrame, grams: DataFrame) -> DataFrame:
    """`found` without the phrases inside a longer one that is nearly as frequent. `grams`: all counted."""
    longer = grams.where("n > 2").select(
        "f", F.explode(F.array(F.element_at("parts", -2), F.col("parts")[1])).alias("key")
    )
    most = longer.groupBy("key").agg(F.max("f").alias("_most"))
    kept = F.coalesce(F.col("_most"), F.lit(0)).cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * WITHIN
    return found.join(most, "key", "left").where(kept).drop("_most")


def _levels(frontier: DataFrame, size: int) -> DataFrame:
    """lang, tau: down to which bound about `size` phrases of a language lie; 0 where it has fewer. Counts
    per step of bounds, at most SCALE / STEP rows of a language, are summed."""
    steps = frontier.groupBy("lang", F.floor(F.col("bound") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("m"))
    above = Window.partitionBy("lang").orderBy(F.desc("step"))
    reached = steps.withColumn("upto", F.sum("m").over(above)).groupBy("lang").agg(
        F.max(F.when(F.col("upto") >= size, F.col("step") * STEP)).alias("tau")
    )
    return stored(reached.select("lang", F.coalesce("tau", F.lit(0)).cast("long").alias("tau")))


def _above(grams: DataFrame, levels: DataFrame, measure: str) -> DataFrame:
    """Phrases of the languages in `levels` that reach their tau. A language may hold most phrases."""
    told = salted_join(grams, levels, ["lang"], F.col("key"))
    return told.where(F.col(measure) >= F.col("tau"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases, by score, count and phrase.

    A null lang counts as `und`, a null text as empty. n is the number of words of the language. Repeated
    rows count as often as they occur. Ids and extra columns are ignored. An empty table, or one where no
    phrase occurs `least` times, gives no rows.
    """
    rows = word_rows(docs.select("lang", "text"))
    parts = dealt(rows)
    words = counted(rows, 1, None, least, parts)
    known = key_filter(words)

    def of_known(row: Grams, n: int) -> np.ndarray:
        use = within(known, row.word)
        return use[:-1] & use[1:]

    pairs = counted(rows, 2, of_known, least, parts)
    pairs = described(rows, pairs, 2)
    counts = words.select("key", "f").unionByName(pairs.select("key", "f"))
    frontier = stored(bounded(pairs, counts))
    total = rows.groupBy("lang").agg(F.sum("n_words").alias("n"))
    open_langs, size, settled = frontier.select("lang").distinct(), SLICE * top, None
    while True:
        levels = _levels(frontier.join(open_langs, "lang", "left_semi"), size)
        grown, near, all_counts = pairs, frontier, counts
        for n in range(3, LONGEST + 1):
            often, chosen = key_filter(near), key_filter(_above(near, levels, "bound"))

            def grows(row: Grams, n: int, often: np.ndarray = often, chosen: np.ndarray = chosen) -> np.ndarray:
                shorter = row.keys(n - 1)
                use, grow = within(often, shorter), within(chosen, shorter)
                return use[:-1] & use[1:] & (grow[:-1] | grow[1:])

            longer = described(rows, counted(rows, n, grows, least, parts), n)
            all_counts = all_counts.unionByName(longer.select("key", "f"))
            grown = grown.unionByName(longer)
            near = stored(bounded(longer, all_counts))
        found = _above(scored(grown, all_counts), levels, "score")
        found = surviving(found, grown)
        place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
        best = stored(found.withColumn("_place", place).where(F.col("_place") <= top).drop("_place"))
        reached = best.groupBy("lang").agg(F.count(F.lit(1)).alias("m"))
        done = stored(
            levels.join(reached, "lang", "left").where((F.col("tau") == 0) | (F.col("m") >= top)).select("lang")
        )
        mine = best.drop("tau").join(done, "lang", "left_semi")
        settled = stored(mine if settled is None else settled.unionByName(mine))
        open_langs = stored(levels.join(done, "lang", "left_anti").select("lang"))
        if open_langs.isEmpty():
            break
        size *= WIDER
    return _ranked(settled, rows, total, top)


def _ranked(best: DataFrame, rows: DataFrame, total: DataFrame, top: int) -> DataFrame:
    """Phrases as text, ranked."""
    wanted = best.select("key", F.posexplode("ids").alias("i", "id"))
    bits = key_filter(wanted.select(F.col("id").alias("key")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [w for row in batch.column(0).to_pylist() for w in row.split(b"\n") if row]
            ids = np.fromiter(map(word_id, found), np.uint64, len(found))
            at = np.flatnonzero(within(bits, ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at].view(np.int64)), pa.array([found[i].decode() for i in at], pa.string())], ["id", "word"]
            )
        release()

    words = rows.select("words").mapInArrow(read, "id long, word string").dropDuplicates(["id"])
    words = stored(words, batch_rows=ROWS_AT_ONCE, read_rows=ROWS_AT_ONCE)
    phrases = wanted.join(words, "id").groupBy("key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return (
        best.join(phrases, "key").join(total, "lang")
        .withColumn("rank", place)
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
