"""Operators against hand-made or brute-force results on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loreweave.functions import text as T
from loreweave.operators import audit, code, events, graph, index, journal, roadmap, search, vectors
from loreweave.session import first_by, nth, running_sum


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("said", "seconds"), [("1h 12m", 4320), ("4m 30s", 270), ("13s", 13), ("soon", 0), ("", 0), (None, 0)])
def test_durations(spark, said, seconds):
    assert one(spark, T.duration_seconds(F.col("d")), d=said) == seconds


@pytest.mark.parametrize(("title", "slug"), [("Fix the  Boiler!", "fix-the-boiler"), ("---", "note"), ("à la carte", "la-carte"), (None, "note"), ("x" * 70, "x" * 60)])
def test_slugs(spark, title, slug):
    assert one(spark, T.slugify(F.col("t")), t=title) == slug


def test_paths(spark):
    for path, plain in [("a\\b//c.py", "a/b/c.py"), ("./a/./b.py", "a/b.py"), ("a/b.py", "a/b.py")]:
        assert one(spark, T.plain_path(F.col("p")), p=path) == plain
    assert one(spark, T.page_slug(F.col("p")), p="wiki/concepts/x-y.md") == "concepts:x-y"


def test_keyword_score_counts_without_overlap(spark):
    assert one(spark, T.keyword_score(F.col("t"), ["aa", "b"]), t="AAAA b B") == 4


# messages, seconds, entry point, reason, tools, prompts -> programmatic, worth
JOURNALS = [
    (10, 900, "sdk-py", "other", None, None, "entrypoint:sdk-py", None), (0, 0, "cli", "resume", None, None, "no-user-messages", None), (1, 13, "", "other", None, None, "one-shot<30s", None),
    (1, 13, "cli", "prompt_input_exit", None, None, None, None), (5, 600, "cli", "other", None, None, None, None), (4, 600, None, None, ["Read", "Edit"], None, None, True),
    (4, 600, None, None, None, ["please split it"], None, True), (4, 600, None, None, ["Read"], ["ok", "grazie"], None, False), (8, 600, None, None, None, ["ok"] * 8, None, True),
    (20, 120, None, None, ["Edit"], None, None, False), (2, 6000, None, None, ["Edit"], ["split"], None, False),
]


def test_journal_rules(spark):
    rows = [(i, *j[:6]) for i, j in enumerate(JOURNALS)]
    df = spark.createDataFrame(rows, "i int, messages_user int, duration_s int, entrypoint string, end_reason string, tools array<string>, prompts array<string>")
    got = {r.i: (r.p, r.w) for r in df.select("i", journal.programmatic_reason().alias("p"), journal.worth().alias("w")).collect()}
    for i, j in enumerate(JOURNALS):
        assert got[i][0] == j[6]
        if j[7] is not None:
            assert got[i][1] is j[7]


def test_sections_links_and_headers(spark):
    raw = "---\ntitle: One\ntype: concept\n---\nintro\n\n## A\nsee x_y.py and x_y.py\n## B\n\n"
    p = spark.createDataFrame([(1, "p", "s", T_body) for T_body in [raw]], "id int, project string, slug string, content string").withColumn("body", T.body(F.col("content")))
    got = [(r.pos, r.section, r.text) for r in audit.sections(p).orderBy("pos").collect()]
    assert got == [(0, "", "intro"), (1, "A", "see x_y.py and x_y.py"), (2, "B", "")]
    assert [(r.line_no, r.target) for r in audit.mentions(p).collect()] == [(4, "x_y.py"), (4, "x_y.py")]


@pytest.mark.parametrize("n", [1, 79, 80, 81, 150, 151, 200, 221])
def test_line_windows(spark, n):
    text = "\n".join(map(str, range(1, n + 1)))
    got = [(r.line_start, r.line_end) for r in index.line_windows(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("line_start").collect()]
    want, s = [], 0
    while True:
        want.append((s + 1, min(s + 80, n)))
        if s + 80 >= n:
            break
        s += 70
    assert got == want


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    for i in range(20):
        w = texts[i].split()
        for _ in range(i % 4):
            w[rng.randrange(80)] = "changed"
        texts.append(" ".join(w))
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, texts[0]), (901, "short one"), (902, None), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sh = {}
    for i, t in docs:
        if i is not None and t and t not in [x for _, x in sh.values()]:
            w = t.split()
            sh[i] = ({" ".join(w[k : k + 5]) for k in range(len(w) - 4)}, t)
    want = {(a, b) for a in sh for b in sh if a < b and sh[a][0] and sh[b][0] and len(sh[a][0] & sh[b][0]) / len(sh[a][0] | sh[b][0]) >= 0.8}
    assert {(r.a, r.b) for r in graph.near_duplicate_pages(df, "doc_id", "text").collect()} == want
    assert want


def test_minute_rule_against_a_loop(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", start + dt.timedelta(seconds=rng.randrange(20_000))) for i in range(1500)]
    last, want = {}, set()
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() >= 60:
            last[k] = t
            want.add(i)
    df = spark.createDataFrame(rows, "event_id long, k string, ts timestamp_ntz")
    assert {r.event_id for r in events.accepted(df, ["k"], "ts", "event_id").collect()} == want


@pytest.mark.parametrize("n", [1, 20, 100, 333])
def test_nth_value(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % n).alias("v"), "id")
    got = [r.v for r in nth(df, "v", F.least(F.floor(F.col("n") * 0.85), F.col("n") - 1), ties=["id"]).collect()]
    assert got == [sorted(i * 7 % n for i in range(n))[min(int(n * 0.85), n - 1)]]


def test_bad_vectors_are_left_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (6, [1e300, 1.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    assert [r.id for r in vectors.valid_vectors(df, "v", 2).collect()] == [1]


def test_knn_in_several_blocks(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(90)], "i long, v array<double>").repartition(5)
    whole = sorted(map(tuple, vectors.knn(df, df.where("i % 3 = 0"), "i", "v", 3).select("query_id", "neighbour", "rank").collect()))
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(vectors, "DATA_ROWS", 20)
    assert sorted(map(tuple, vectors.knn(df, df.where("i % 3 = 0"), "i", "v", 3).select("query_id", "neighbour", "rank").collect())) == whole
    assert len(whole) == 90
    assert vectors.knn(df, df.where("i < 0"), "i", "v", 3).count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "k string, rank int")
    got = {r.k: r.rrf for r in search.rrf(a, b, "k").collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 62 + 1 / 61, 9), "z": round(1 / 62, 9)}


def test_first_by_keeps_one_row(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (None, 1, None)], "k int, o int, v string")
    assert {(r.k, r.v) for r in first_by(df, ["k"], F.col("o")).collect()} == {(1, "b"), (None, None)}


def test_states(spark):
    df = spark.createDataFrame([("Done ",), ("wip",), ("odd",), (None,)], "status string")
    assert [r.x for r in df.select(roadmap.plain_status(F.col("status")).alias("x")).collect()] == ["done", "in-progress", "odd", None]


def test_python_facts():
    source = "import os\nfrom a import b as c\n@dec\ndef f():\n    class K:\n        def m(self):\n            return g(os.x())\n"
    got = code.python_facts(source)
    assert ("import", "a.b", "", 2, 2) in got and ("function", "f", "", 3, 7) in got and ("class", "K", "f", 5, 7) in got and ("call", "g", "f.K.m", 7, 7) in got
    assert code.python_facts("def broken(") == [] and code.python_facts("\0") == [] and code.python_facts("") == []


def test_diffs(spark):
    df = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, None, "x"), (3, "same", "same")], "k int, a string, b string")
    got = {r.k: r.diff for r in code.diffs(df, "k", "a", "b", 25).collect()}
    assert got[3] == "" and len(got[1]) == 25 and got[2].startswith("--- before")


def test_running_sum_with_a_hot_key(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", rng.randrange(50), rng.randrange(9)) for i in range(1500)]
    got = {r.i: r.s for r in running_sum(spark.createDataFrame(rows, "i long, k string, o int, v int"), "k", ["o", "i"], "v", "s").collect()}
    sums, want = {}, {}
    for i, k, o, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert got == want


def test_trust_tiers(spark):
    page = "---\ntitle: T\nupdated: 2026-01-01\n{}---\nbody"
    plain = page.format("")
    revision = one(spark, audit.content_revision(F.col("t")), t=plain)
    assert revision == one(spark, audit.content_revision(F.col("t")), t=plain.replace("2026-01-01", "2026-02-02"))
    assert revision != one(spark, audit.content_revision(F.col("t")), t=plain.replace("body", "other"))
    event = lambda by, rev, origin: page.format('verified: [{"by": "%s", "at": "x", "content_revision": "%s", "origin": "%s"}]\n' % (by, rev, origin))
    for text, tier in [
        (plain, "unverified"), (event("human:ada", revision, "local-cli"), "human-reviewed"), (event("human:ada", revision, "mcp"), "machine-confirmed"), (event("process:x", revision, "mcp"), "machine-confirmed"),
        (event("human:ada", "sha256:old", "local-cli"), "stale"), (page.format("verified: { by: someone }\n"), "legacy"), ("no header", "unverified"),
    ]:
        assert one(spark, audit.trust_tier(F.col("t")), t=text) == tier, text
