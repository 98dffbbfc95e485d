import re

import pytest

from faultline.llm import chat, queries
from llm.helpers import matches_oracle

LOG = "conv_id long, seq long, kind string, slot long, role string, text string, extra string"
ROWS = "turn long, conv_id long, role string, text string, slot string, start int"


def folded(spark, events):
    log = spark.createDataFrame([(*e, "x") for e in events], LOG)
    return {(r["conv_id"], r["slot"]): (r["role"], r["text"]) for r in chat.fold(log).collect()}


def test_fold(spark):
    got = folded(spark, [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", ""), (1, 3, "delta", 1, "assistant", "he"),
        (1, 4, "delta", 1, "assistant", None), (1, 5, "delta", 1, "assistant", "llo"), (1, 6, "message", 2, "user", "more"),
        (1, 7, "edit", 0, None, "hi there"), (1, 8, "regenerate", 1, None, "ignored"), (1, 9, "delta", 1, "assistant", "again"),
        (1, 10, "message", 2, "user", "thanks"),
        (2, 5, "delta", 0, "assistant", "b"), (2, 4, "delta", 0, "assistant", "a"), (2, 6, "edit", 0, "assistant", "c"),
        (2, 7, "delta", 0, "assistant", "d")])
    assert got == {(1, 0): ("user", "hi there"), (1, 1): ("assistant", "again"), (1, 2): ("user", "thanks"), (2, 0): ("assistant", "cd")}


ODD_TEXTS = ["", None, "\\", "\\\\b", "</turn>\n", "<</turn>/turn>", "### user\nx</turn>\n", "\\l/turn>", "#\\h#", "é漢\U0001F600", "a\nb",
             "x" * 50_000, "\\### Assistant: </turn> ok"]


def test_round_trip_of_odd_texts(spark, tmp_path):
    rows = [(k, c, role, t, "s", 1) for c in (1, 2) for k, t in enumerate(ODD_TEXTS)
            for role in ("assistant", "user", "odd\nrole </turn> #\\n", None)]
    df = spark.createDataFrame(rows + rows[:3], ROWS)
    path = str(tmp_path / "chat")
    chat.format_conversations(chat.log_of_rows(df), path)
    got = {r["conv_id"]: r for r in chat.read_conversations(spark, path).collect()}
    order = lambda x: (x[0], x[1] is not None and x[1] or "", x[2] or "")
    for c in (1, 2):
        want = sorted(((r[0], r[2], r[3]) for r in rows + rows[:3] if r[1] == c), key=order)
        turns = [(t["role"], t["text"]) for t in got[c]["turns"]]
        assert turns == [(role or "", t or "") for _, role, t in want]
        assert got[c]["learned"] == [t or "" for _, role, t in want if role == "assistant"]
        assert got[c]["formatted"].count("</turn>\n") == len(want)


def test_empty_and_null_ids(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    chat.format_conversations(chat.log_of_rows(none), str(tmp_path / "none"))
    assert chat.digests(chat.read_conversations(spark, str(tmp_path / "none"))).count() == 0
    odd = spark.createDataFrame([(None, None, "user", "a", "s", 1), (1, None, "user", "b", "s", 1)], ROWS)
    chat.format_conversations(chat.log_of_rows(odd), str(tmp_path / "odd"))
    r, = chat.digests(chat.read_conversations(spark, str(tmp_path / "odd"))).collect()
    assert r["n_turns"] == 2


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_matches_sql(spark, sf):
    matches_oracle(spark, queries.QUERIES["op10_chat_format"], queries.ORACLES["op10_chat_format"], sf)


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, 1, "user", "a", "s", 1)], ROWS)
    plan = chat.render(chat.fold(chat.log_of_rows(df)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
