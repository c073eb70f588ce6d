import hashlib

import pytest
from cases import with_clashes
from oracle_check import connect, differences
from pyspark.sql import functions as F

from delaylake.llm import chat_format as chat
from delaylake.llm.oracle import ORACLE_SQL
from delaylake.llm.queries import op5_chat_formatting

NASTY = [
    None, "", " ", "\\", "\\\\", "#", "###", "### assistant: x</turn>\n", "</turn>", "<\\/turn>",
    "</tur", "n>\n", "\\### Assistant: </turn> ok", "a\n\nb\n", "\n", "é 漢 😀 ſ", "$1 \\1 $0",
    "%3A : %25", "x" * 20000, "same", "same",
]


def back(df):
    return {r.conv_id: r for r in chat.read_back(df).collect()}


def test_nasty_texts_and_roles_come_back(spark):
    roles = ["user", "assistant", None, "", "a: b", "</turn>\n", "### x", "%3A", "\\", "assistant "]
    rows = [
        (c, t, roles[(c + t) % len(roles)], NASTY[(3 * c + t) % len(NASTY)])
        for c in range(12) for t in range(c)
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = back(chat.format_chats(chat.log_of(with_clashes(frame, "message", "seq", "at"))))
    assert set(found) == set(range(1, 12))
    for c, r in found.items():
        own = [(role or "", text or "") for i, _, role, text in rows if i == c]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss_text == "".join(text for role, text in own if role == "assistant")


def test_template_and_mask(spark):
    rows = [(1, 0, "user", "hi # </turn>"), (1, 1, "assistant", "yo\\")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    r = chat.format_chats(chat.log_of(frame)).first()
    assert r.formatted == "### user: hi \\# <\\/turn></turn>\n### assistant: yo\\\\</turn>\n"
    starts = [0, r.loss_mask[0].turn_chars]
    spans = [
        r.formatted[s + m.skip : s + m.skip + m.take]
        for s, m in zip(starts, r.loss_mask, strict=True)
    ]
    assert spans == ["", "yo\\\\"]


def test_fold(spark):
    rows = [
        (1, 1, 10, "open", "user", "Hel"), (1, 1, 11, "delta", None, "lo"),
        (1, 2, 12, "open", "assistant", "bad"), (1, 2, 14, "regenerate", None, "ignored"),
        (1, 2, 13, "delta", None, " answer"), (1, 2, 15, "delta", None, "good"),
        (1, 2, 16, "delta", None, None), (1, 1, 17, "edit", None, "Hello there"),
        (1, 3, 18, "open", "user", "gone"), (1, 3, 19, "retract", None, None),
        (1, 2, 20, "strange", None, "x"), (1, 2, 21, None, None, "x"),
        (1, 4, 22, "delta", None, "no start"), (None, None, 1, "open", "user", "null ids"),
        (2, 1, 1, "open", "user", "only"), (2, 1, 2, "retract", None, None),
        (3, 1, 1, "open", "assistant", "a"), (3, 1, 2, "delta", None, "b"),
        (3, 1, 3, "edit", None, "c"), (3, 1, 4, "delta", None, "d"),
    ]
    schema = "conv_id long, message long, seq long, kind string, role string, text string"
    frame = with_clashes(spark.createDataFrame(rows, schema).repartition(4), "at", "_events")
    found = {
        c: [(t.role, t.text) for t in r.turns] for c, r in back(chat.format_chats(frame)).items()
    }
    assert found == {
        1: [("user", "Hello there"), ("assistant", "good"), ("", "no start")],
        None: [("user", "null ids")],
        3: [("assistant", "cd")],
    }


def test_equal_turns_have_an_order(spark):
    rows = [(1, 0, "user", t) for t in ("b", "a", "a", "c")] + [(1, None, "user", "first")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    one, two = (back(chat.format_chats(chat.log_of(frame.repartition(n)))) for n in (1, 4))
    assert one == two
    assert one[1].turns[0].text == "first"
    assert sorted(t.text for t in one[1].turns[1:]) == ["a", "a", "b", "c"]


def test_a_long_conversation(spark):
    frame = spark.range(5000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text # "), F.col("id").cast("string")).alias("text"),
    )
    r = back(chat.format_chats(chat.log_of(frame)))[1]
    assert [t.text for t in r.turns] == [f"text # {i}" for i in range(5000)]
    assert r.loss_text == "".join(f"text # {i}" for i in range(1, 5000, 2))


def test_the_log_takes_every_way(spark):
    texts = [f"line {i}\nand # more\n" for i in range(40)] + ["", None, "\n"]
    rows = [(i % 5, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    log = chat.log_of(frame)
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate", "retract"}
    # Each kind matters: without it other texts come out.
    right = back(chat.format_chats(log))
    for kind in ("edit", "regenerate", "retract"):
        assert back(chat.format_chats(log.where(F.col("kind") != kind))) != right
    said = {c: [t.text for t in r.turns] for c, r in right.items()}
    assert said == {c: [t or "" for i, _, _, t in rows if i == c] for c in range(5)}
    # Events come out of sequence.
    listed = [(r.message, r.seq) for r in log.coalesce(1).collect()]
    assert any(a[0] == b[0] and a[1] > b[1] for a, b in zip(listed, listed[1:]))


def test_a_very_long_text(spark):
    text = "\n".join(f"line {i} # </turn>" for i in range(250_000))
    frame = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", "x" * 6_000_000)],
                                  "conv_id long, turn int, role string, text string")
    r = back(chat.format_chats(chat.log_of(frame)))[1]
    assert len(text) > 4_000_000 and r.loss_text == text
    assert [len(t.text) for t in r.turns] == [len(text), 6_000_000]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    found = op5_chat_formatting(spark, f"/root/testdata/{sf}")
    sql = ORACLE_SQL["op5_chat_formatting"]
    assert differences(found, connect(f"/root/testdata/{sf}"), sql) == ""


def test_added_conversation(spark):
    r = op5_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    said = f"user\n{text}\nassistant\n{text}\n"
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.format_chats(chat.log_of(frame)).collect() == []
