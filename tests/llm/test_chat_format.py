from gaugework.llm.chat_format import format_chats

SCHEMA = "conv_id long, turn long, role string, text string, pos int, last boolean"


def test_snapshots_and_copies_collapse(spark):
    a = [(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "more")]
    rows = [(1, *t) for t in a[:1]] + [(2, *t) for t in a[:2]] + [(3, *t) for t in a] + [(4, *t) for t in a]
    rows += [(5, 0, "user", "other"), (6, 0, "user", None), (7, 0, None, "x"), (8, 5, "user", "hi"), (8, 6, "user", "hi"), (8, 6, "user", "hi"), (9, 0, "user", "hi" * 50000), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA)
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in format_chats(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8, 9, None}  # 1 and 2 are snapshots of 3; 4 equals 3
    assert got[3][:2] == (3, 2)
    assert got[3][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[6][2] == "<|im_start|>user\n<|im_end|>\n" and got[7][2] == "<|im_start|>\nx<|im_end|>\n"
    assert got[8][0] == 2


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_is_not_the_empty_text(spark):
    rows = [(1, 0, "user", None), (2, 0, "user", ""), (2, 1, "user", "go")]
    got = {r["conv_id"] for r in format_chats(spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA)).collect()}
    assert got == {1, 2}


def test_lines_of_one_turn_and_rows_without_a_conversation(spark):
    rows = [(10, 0, "user", "b"), (10, 0, "user", "a"), (11, 0, "user", "a"), (11, 0, "user", "b"), (11, 1, "user", "c"), (12, 0, "user", "b"), (12, 1, "user", "c")]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 3, "user", "x"), (None, 1, "user", "y"), (13, 0, "user", "y"), (13, 1, "user", "z"), (14, None, "user", "t")]
    got = sorted(((r["conv_id"], r["n_turns"], r["n_copies"], r["rendered"].count("<|im_start|>")) for r in format_chats(spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA)).collect()), key=str)
    assert got == [(11, 3, 1, 3), (12, 2, 1, 2), (13, 2, 1, 2), (14, 1, 1, 1), (None, 1, 2, 1)]  # the two x are copies, y begins 13
