"""Sessions from message rows: the rules one by one, then random logs against a plain fold."""

import json
import random

from pyspark.sql import functions as F

from loreweave.llm import conversations as C

SCHEMA = "row_id bigint, session_id string, transcript_path string, line_no int, event_type string, event_time string, message struct<role:string,content:string>, received_at timestamp_ntz, at int, speaker int"


def frame(spark, sessions):
    rows, n = [], 0
    for name, lines in sessions.items():
        for k, (role, content, *time) in enumerate(lines, 1):
            n += 1
            rows.append((n, name, f"{name}.jsonl", k, None, time[0] if time else f"2026-01-01T00:{k:02d}:00Z", (role, content), None, 0, 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_rules(spark):
    block = lambda *b: json.dumps(list(b))
    text, tool = (lambda t: {"type": "text", "text": t}), {"type": "tool_use", "name": "x", "input": {}}
    kept = {
        "plain": [("user", "hi"), ("assistant", "yes")], "several": [("user", "hi"), ("assistant", "a"), ("ai", "b")], "noise": [("user", "(No Content)"), ("Human", "hi"), ("model", block(tool)), ("model", block(text("ok"), tool))],
        "markup": [("assistant", "<command-name>x"), ("user", "[see note] hi"), ("assistant", "ok")], "zones": [("assistant", "late", "2026-01-01T10:00:00+02:00"), ("user", "first", "1767250800000")],
        "noTime": [("user", "hi", None), ("assistant", "ok")],
    }
    dropped = {
        "empty": [("user", "  "), ("assistant", block(tool))], "answerless": [("user", "hi")], "twice": [("user", "a"), ("user", "b"), ("assistant", "c")], "opened": [("assistant", "a"), ("user", "b"), ("assistant", "c")],
        "last": [("user", "a"), ("assistant", "b"), ("user", "c")], "broken": [("user", "a"), ("assistant", "b"), ("assistant", '[{"type": "text", "te')], "cut": [("user", "a"), ("assistant", "b"), ("assistant", "[")],
    }
    df = frame(spark, kept | dropped)
    gap = frame(spark, {"gap": [("user", "a"), ("assistant", "b"), ("assistant", "c")]}).where("line_no <> 2")
    every = df.unionByName(gap).unionByName(df.limit(3).withColumn("row_id", F.col("row_id") + 1000))
    assert {r.session_id for r in C.dropped_sessions(every).collect()} == {*dropped, "gap"}
    turns = C.conversations(every).orderBy("session_id", "turn_no").collect()
    assert {r.session_id for r in turns} == set(kept)
    assert [(r.turn_no, r.role, r.content) for r in turns if r.session_id == "zones"] == [(1, "user", "first"), (2, "assistant", "late")]
    assert C.dropped_sessions(df.limit(0)).count() == 0


def test_edits_deletes_and_retries(spark):
    rows = [("e", 1, "user", "hi", 1), ("e", 2, "assistant", "no", 1), ("e", 2, "assistant", "yes", 2), ("d", 1, "user", "hi", 1), ("d", 2, "assistant", "ok", 1), ("d", 3, "user", "x", 1), ("d", 3, "user", None, 2), ("r", 1, "user", "hi", 1), ("r", 1, "user", "hi", 1), ("r", 1, "user", "hi", 3), ("r", 2, "assistant", "ok", 2), ("u", 1, "user", "hi", 2), ("u", 2, "assistant", "ok", 2), ("u", 2, "assistant", " ", 3)]
    df = spark.createDataFrame([(i, s, s, n, role, f"2026-01-01T00:0{n}:00Z", (role, text), None, 0, 0, at) for i, (s, n, role, text, at) in enumerate(rows)], SCHEMA + ", sent int")
    df = df.withColumn("received_at", F.timestamp_seconds("sent").cast("timestamp_ntz"))
    assert [tuple(r) for r in C.conversations(df).select("session_id", "turn_no", "content").orderBy("session_id", "turn_no").collect()] == [("d", 1, "hi"), ("d", 2, "ok"), ("e", 1, "hi"), ("e", 2, "yes"), ("r", 1, "hi"), ("r", 2, "ok")]
    assert [r.session_id for r in C.dropped_sessions(df).collect()] == ["u"]


def test_hot_session_against_a_fold(spark):
    rng = random.Random(8)
    sessions = {"hot": [(rng.choice(["user", "assistant", "assistant"]), rng.choice(["x", "y", " ", None])) for _ in range(59)]}
    for i in range(60):
        lines = [("user", "q")] + [(rng.choice(["user", "assistant"]), rng.choice(["x", "  ", "y"])) for _ in range(rng.randrange(6))]
        sessions[f"s{i}"] = lines
    want = set()
    for name, lines in sessions.items():
        said = [r for r, c in lines if c and c.strip()]
        if not said or said[0] != "user" or any(a == "user" and b == "user" for a, b in zip(said, [*said[1:], "user"])):
            want.add(name)
    assert {r.session_id for r in C.dropped_sessions(frame(spark, sessions)).collect()} == want


def test_instants(spark):
    rows = [("2026-01-11T08:23:23Z",), ("2026-01-11 10:23:23+02:00",), ("2026-01-11T08:23:23.000Z",), ("1768119803000",), ("1768119803",), ("soon",), (None,), ("",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(C.instant(F.col("t")).alias("x")).collect()]
    assert got == [1768119803000000] * 5 + [None] * 3
