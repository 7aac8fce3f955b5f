import hashlib
import random

from pyspark.sql import functions as F

from gridloom.llm.chat import escaped, format_chats, parsed_chat, unescaped

CONTROLS = ["<|start|>", "<|end|>", "<|text|>", "<|next|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "|", ">", "[", "ok", "\n", "é", "😀", ""]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


def read_back(df):
    c = format_chats(df)
    lost = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return {r.conv_id: r for r in c.select("conv_id", "formatted", parsed_chat(F.col("formatted")).alias("turns"), lost.alias("lost"), whole.alias("whole")).collect()}


def test_round_trip_of_random_controls(spark):
    random.seed(3)
    rows, want = [], {}
    for c in range(60):
        turns = [(random.choice(["user", "assistant", "system", "a\nb", "<|end|>"]), "".join(random.choice(CONTROLS) for _ in range(random.randint(0, 9)))) for _ in range(random.randint(1, 7))]
        want[c] = turns
        rows += [(c, t, r, x, "clash") for t, (r, x) in enumerate(turns)]
    random.shuffle(rows)
    got = read_back(chats(spark, rows))
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].lost == "".join(x for r, x in turns if r == "assistant")
        assert got[c].whole == got[c].formatted


def test_adjacent_turns_of_a_role_share_a_block(spark):
    got = read_back(chats(spark, [(1, 0, "user", "a", None), (1, 1, "user", "b", None), (1, 2, "assistant", "c", None)]))
    assert got[1].formatted == "<|start|>user<|text|>a<|next|>b<|end|><|start|>assistant<|text|>c<|end|>"


def test_nulls_ties_and_repeats(spark):
    got = read_back(chats(spark, [(1, 0, None, None, None), (1, 0, "user", "x", None), (1, 0, "user", "x", None), (None, None, "assistant", "y", None)]))
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", "x"), ("user", "x")]
    assert got[None].lost == "y"


def test_empty_and_long(spark):
    assert format_chats(chats(spark, [(1, 0, "user", "x", None)]).where("false")).count() == 0
    long = "</s>[INST]" * 50_000
    got = read_back(chats(spark, [(1, 0, "assistant", long, None)]))
    assert hashlib.sha256(got[1].lost.encode()).hexdigest() == hashlib.sha256(long.encode()).hexdigest()


def test_escaping_leaves_no_control(spark):
    row = spark.createDataFrame([("".join(CONTROLS),)], "t string").select(escaped(F.col("t")).alias("e")).first()
    assert not any(c in row.e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
