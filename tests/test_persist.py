import time

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.sessions import persist_turns

SESSION = "session string, install string, title string, token_count long, status string, ended_reason string, updated long"
MESSAGE = "session string, message long, role string, content string, total_tokens long"
TURN = "session string, install string, at long, question string, answer string, total_tokens long"


def test_persist_turns(spark):
    sessions = spark.createDataFrame([("a", "i", "Kept", 5, "ended", "limit", 1), ("b", "i", "", 5, "ended", None, 1), ("c", "i", "C", 9, "ended", "limit", 1)], SESSION)
    messages = spark.createDataFrame([("a", 7, "user", "old", None), ("c", 1, "user", "c", None)], MESSAGE)
    long = "x" * 120
    rows = [("a", "j", 2, "q", None, None), ("b", "i", 3, " \n ", "r", 4), ("b", "i", 4, "later", "s", 6), ("d", "k", 9, "second", "t", 8), ("d", "j", 8, f"\n {long} ", "u", 7), (None, "i", 1, "q", "r", 1), ("e", None, 1, "q", "r", 1)]
    after, said = persist_turns(sessions, messages, spark.createDataFrame(rows, TURN))
    want = [("a", "i", "Kept", 0, "active", "limit", 2), ("b", "i", "New chat", 6, "active", None, 4), ("c", "i", "C", 9, "ended", "limit", 1), ("d", "j", "x" * 100, 8, "active", None, 9)]
    assert sorted(map(tuple, after.collect()), key=str) == want
    got = sorted(map(tuple, said.collect()))
    assert [r for r in got if r[0] == "a"] == [("a", 7, "user", "old", None), ("a", 8, "user", "q", None), ("a", 9, "assistant", "", None)]
    assert [(r[1], r[2]) for r in got if r[0] == "d"] == [(1, "user"), (2, "assistant"), (3, "user"), (4, "assistant")] and {r[0] for r in got} == {"a", "b", "c", "d"}
    # Turns in two lots give what they give at once.
    turns = spark.createDataFrame(rows, TURN)
    first = persist_turns(sessions, messages, turns.where("at < 4"))
    again = persist_turns(*first, turns.where("at >= 4"))
    assert [sorted(map(str, df.collect())) for df in again] == [sorted(map(str, df.collect())) for df in (after, said)]
    none = persist_turns(sessions.limit(0), messages.limit(0), turns.limit(0))
    assert none[0].count() == none[1].count() == 0


def test_list_indents_of_long_texts(spark):
    cases = {"": "", "a": "a", "  - a": "- a", "- a\n    1. b\nx\n\n   * c\n     * d": "- a\n    1. b\nx\n\n* c\n  * d", "  - a\n\n    - b\n": "- a\n\n- b\n"}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", T.normalize_list_indent(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == {**cases, None: None}
    long = "\n".join("x" if i % 1000 == 999 else "  " * (1 + i % 3) + "- y" for i in range(60_000))
    began = time.time()
    got = spark.createDataFrame([(long,)], "t string").select(T.normalize_list_indent(F.col("t")).alias("t")).first().t
    assert got == "\n".join("x" if i % 1000 == 999 else "  " * (i % 3) + "- y" for i in range(60_000)) and time.time() - began < 30


def test_indicator_words(spark):
    docs = [(i, "en" if i % 2 else "fr", f"The pdf and word{i}" if i % 2 else "le pdf et Mot") for i in range(40)] + [(90, None, "the"), (91, "en", None)]
    docs = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    found = [tuple(r) for r in T.indicator_words(docs, "en", 3).collect()]
    assert found[:2] == [("and", 20, 0), ("the", 20, 0)] and len(found) == 3
    assert T.indicator_words(docs, "xx").count() == 0 and T.indicator_words(docs.limit(0), "en").count() == 0
