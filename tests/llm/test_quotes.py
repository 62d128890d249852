import textwrap

from tessgrid.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, turn_id long"


def threads(spark, rows):
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return {(r.conv_id, r.turn): r for r in quotes.conversations(frame).collect()}


def test_nested_quotes(spark):
    got = threads(spark, [
        (1, 0, "user", "First line\nSecond  line"),
        (1, 1, "assistant", "> first LINE\n\nAn answer"),
        (1, 2, "user", ">> First line\n> An answer\nMy reply"),
        (1, 3, "user", "> Second line\r\nAside"),
        (1, 4, "user", "> never said\nlone"),
        (2, 0, "user", "> First line\nelsewhere"),
    ])
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, 1, 0, None]
    assert got[1, 2].path == [0, 1, 2] and got[1, 2].depth == 2 and got[1, 2].quote_depth == 2
    assert got[1, 2].reply == "My reply" and got[1, 3].reply == "Aside" and got[1, 1].reply == "An answer"
    assert got[1, 4].root_turn == 4 and got[1, 4].n_quoted == 1 and got[2, 0].parent_turn is None


def test_order(spark):
    rows = [(1, 0, "u", "root"), (1, 1, "u", "> root\nleft"), (1, 2, "u", "> root\nright"), (1, 3, "u", "> left\ndeep")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert [r.turn for r in quotes.conversations(frame).collect()] == [0, 1, 3, 2]


def test_long_thread_and_common_line(spark):
    rows = [(7, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}\nthanks") for i in range(40)]
    rows += [(8, i, "u", "> thanks\nthanks") for i in range(300)]
    got = threads(spark, rows)
    assert got[7, 39].depth == 39 and got[7, 39].path == list(range(40))
    assert all(got[8, i].parent_turn == 0 for i in range(1, 300)) and got[8, 0].parent_turn is None


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 1, "u", ""), (1, 2, "u", ">"), (1, 3, "u", "> > \n>"), (None, 0, "u", "> x"),
            (1, None, "u", "> y"), (1, 5, "u", "same"), (1, 5, "u", "same"), (1, 6, "u", "> same\nok " + "z" * 200_000)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    found = quotes.conversations(frame).collect()
    assert len(found) == len(rows)
    assert {r.reply for r in found if r.turn == 0 and r.conv_id == 1} == {None}
    assert [r.parent_turn for r in found if r.turn == 6] == [5]
    assert quotes.conversations(frame.where("false")).collect() == []


def test_quotes_wrapped_anew(spark):
    words = [f"word{i}" for i in range(60)]
    long = " ".join(words)
    wrapped = "\n".join("> " + line for line in textwrap.wrap(long, 72))
    deeper = "\n".join("> > " + line for line in textwrap.wrap(long, 50))
    got = threads(spark, [
        (1, 0, "user", "Unlike this\n\n" + long),
        (1, 1, "assistant", wrapped + "\nAn answer that\nis split over two lines"),
        (1, 2, "user", deeper + "\n> an answer that is split\n> over two  LINES\nok"),
        (1, 3, "user", "> " + " ".join(words[20:30]) + "\npart of a line"),
        (1, 4, "user", "> " + " ".join(words[20:25]) + "\n> is split over two lines\n> An answer that\ntwo sources"),
        (1, 5, "user", "> " + " ".join(words[20:25]) + "x\nword cut short"),
        (1, 6, "user", "> word8 word7 word6 word5\nother order"),
        (2, 0, "user", wrapped + "\nelsewhere"),
    ])
    assert [got[1, t].parent_turn for t in range(7)] == [None, 0, 1, 0, 1, None, None]
    assert got[1, 2].path == [0, 1, 2] and got[2, 0].parent_turn is None


def test_given_conversations_quoted_in_new_lines(spark, small):
    told = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    text = {(r.conv_id, r.turn): r.text for r in told}
    rows = []
    for r in told:
        before = " ".join((text.get((r.conv_id, r.turn - 1)) or "").split())
        quoted = "".join(f"> {line}\n" for line in textwrap.wrap(before, 40, break_long_words=False, break_on_hyphens=False))
        rows.append((r.conv_id, r.turn, r.role, quoted + (r.text or "")))
    got = threads(spark, rows)
    for (conv, turn), r in got.items():
        if len((text.get((conv, turn - 1)) or "").split()) > 8:
            assert r.parent_turn is not None and r.parent_turn < turn
