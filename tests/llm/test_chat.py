import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat

ODD = ["", "\\", "<", "\\l", "\\b", "\\\\l<", chat.TURN, chat.BODY, chat.END, "a<|end|>b\\", "\\### Assistant: </turn> ok", "<|image|>", "é\n\x00<|", None]


def back(spark, said):
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    made = chat.format_chat(df)
    return made.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans").collect()


def test_odd_texts_come_back(spark):
    said = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(ODD)] + [(2, 0, "<|end|>", "x"), (None, None, None, None), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    got = {r["conv_id"]: r for r in back(spark, said)}
    assert [t["text"] for t in got[1]["turns"]] == [t or "" for t in ODD]
    assert got[1]["loss"] == "".join(t or "" for t in ODD[1::2])
    assert got[2]["turns"][0]["role"] == "<|end|>"
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
    assert len(got[3]["turns"]) == 2 and got[3]["loss"] == "samesame"
    assert back(spark, []) == []


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="<|\\lbend>turn\n é", max_size=30), min_size=30, max_size=60))
def test_any_text_comes_back(spark, texts):
    got = back(spark, [(1, i, "assistant", t) for i, t in enumerate(texts)])[0]
    assert [t["text"] for t in got["turns"]] == texts
    assert got["loss"] == "".join(texts)
    assert hashlib.sha256(got["loss"].encode()).digest() == hashlib.sha256("".join(texts).encode()).digest()


def test_parts_leave_placeholders_and_attachments(spark):
    parts = "array<struct<type:string,text:string,ref:string,units:bigint>>"
    said = [(1, 0, "user", [("text", "see <this>", None, None), ("image", None, "i.png", 4), ("audio", None, "a.wav", 10), ("video", None, "v", 3)]), (1, 1, "assistant", [("document", None, "d.pdf", None), (None, "ok", None, None)]), (2, 0, "user", None)]
    df = spark.createDataFrame(said, f"conv_id long, turn long, role string, parts {parts}")
    got = {r["conv_id"]: r for r in chat.format_chat(df).collect()}
    assert got[1]["formatted"].startswith("<|turn|>user<|body|>see \\lthis><|image|><|audio|><|video|><|end|>")
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, 1, "image", "i.png", 1024), (0, 2, "audio", "a.wav", 250), (0, 3, "video", "v", 0), (1, 0, "document", "d.pdf", 512)]
    assert got[1]["expanded_tokens"] == 1786
    assert got[2]["formatted"] == "<|turn|>user<|body|><|end|>" and got[2]["attachments"] == []
