"""Files that nobody wrote by hand: marks, composition, copies across projects."""

import random

import pytest

from loreweave.llm import handwritten as H

CODE = "\n".join(f"def collect_{i}(rows):\n    total_{i} = rows.measure(limit={i})\n    return total_{i}" for i in range(12))


def test_marks():
    for text in ("// Code generated by x 1.2. DO NOT EDIT.\nfoo", "# @generated\n", "# File generato automaticamente da x: non modificare a mano.", "x = 1\n# This file was produced by gen from a.schema on 2026-01-01; regenerate instead of editing"):
        assert H.GENERATED.search(text)
    for text in ('banner = "Code generated by x. DO NOT EDIT."', "# Edit by hand; the old schema generator is gone.", "# Do not edit on the server, change it here and deploy.", "# reads what the generator writes"):
        assert not H.GENERATED.search(text)
    assert H.VENDORED.search("// Upstream: lib@4d8fbaf\n") and not H.VENDORED.search("// Copyright (c) the atlas team. Internal use only.")


def test_composition():
    assert H.composition(CODE) == (0, 0)
    assert H.composition("DATA = [\n" + "    72366, 90492, 30730, 97192,\n" * 40 + "]")[0] > 1000
    mini = "function p(f,v){return f.c+v}for(var s=0;s<h.length;s++)g(h[s]);" * 10
    assert H.composition(mini) == (0, len(mini))
    assert H.composition('P = "' + "aB3/" * 300 + '"')[0] > 1000
    assert H.composition("") == (0, 0)


def test_files(spark):
    rng = random.Random(2)
    library = [f"    value_{i} = compute_something({rng.random()}, {rng.random()})" for i in range(40)]
    edited = library[:20] + ["    changed line that stands nowhere else"] + library[21:]
    rows = [
        (1, "code", "p", "src/a.py", CODE, 0), (2, "code", "p", "src/vendor_portal/b.py", CODE + "\n", 0), (3, "code", "p", "vendor/lib/c.py", CODE, 0), (4, "code", "p", "x/d.min.js", "a", 0),
        (5, "code", "p", "conf/e.json", "[1, 2, 3]\n" * 80, 0), (6, "code", "p", "src/f.py", "1,2,3\n" * 80, 0), (6, "code", "p", "src/f.py", "1,2,3\n" * 80, 0),
        (7, "code", "p", "vendor/lib/copy.py", "\n".join(library), 0), (8, "code", "q", "src/own.py", "\n".join(edited), 0), (9, "code", "p", "src/null.py", None, 0), (10, "code", None, "a", "x", 0), (11, "wiki", "p", "w.md", "# @generated", 0),
    ]
    df = spark.createDataFrame(rows, "id bigint, kind string, project string, file_path string, content string, f int")
    got = {(r.project, r.file_path): r.reason for r in H.not_handwritten(df).collect()}
    assert got == {("p", "vendor/lib/c.py"): "vendored", ("p", "x/d.min.js"): "minified", ("p", "src/f.py"): "data", ("p", "vendor/lib/copy.py"): "vendored", ("q", "src/own.py"): "vendored"}
    assert H.not_handwritten(df.limit(0)).count() == 0
    pair = {(r.share) for r in H.containment(df).collect()}
    assert len(pair) == 1 and abs(pair.pop() - 39 / 40) < 0.03


def test_copies_in_many_files(spark):
    library = "\n".join(f"    value_{i} = compute_something_from(rows, {i})" for i in range(30))
    edited = library.replace("value_7 ", "another_7 ")
    rows = [(i, "code", f"p{i % 30}", f"src/copy_{i}.py", edited if i % 5 == 0 else library, 0) for i in range(60)]
    rows += [(100 + i, "code", f"p{i}", f"src/own_{i}.py", "\n".join(library.split("\n")[:4] + [f"    own_{i}_{k} = compute_nothing_at_all()" for k in range(20)]), 0) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, kind string, project string, file_path string, content string, f int")
    got = {(r.project, r.file_path) for r in H.not_handwritten(df).collect()}
    assert got == {(r[2], r[3]) for r in rows[:60]}
    assert H.containment(df).count() == 60 * 58


def test_hint_lets_every_mark_through():
    for text in ("# copied from lib/x.py at v1", "// left-pad 1.2.0 (c) 2020 the pad authors", "# non modificare a mano", "# automatically built", "# automatically written", "# this was written by gen from a.schema", "# changes will be lost when the schema is built"):
        found = next(H._features(iter([H.pd.DataFrame({"project": ["p"], "file_path": ["a"], "id": [1], "content": [text]})])))
        assert found["generated"][0] or found["vendored"][0], text


def test_copies_that_are_all_edited(spark):
    base = [f"    value_{i} = compute_something_from(rows, {i})" for i in range(12)]
    rows = [(i, "code", f"p{i % 40}", f"src/copy_{i}.py", "\n".join([*base[: i % 12], f"    edit_{i} = nothing_like_it_elsewhere()", *base[i % 12 + 1 :]]), 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, kind string, project string, file_path string, content string, f int")
    assert H.not_handwritten(df).where("reason = 'vendored' and array_contains(evidence, 'containment')").count() == 1000


@pytest.mark.parametrize("seed", range(2))
def test_rounds_give_what_all_pairs_give(spark, seed):
    rng = random.Random(seed)
    pool = [f"    value_{i} = compute_something_from(rows, {i})" for i in range(14)]
    rows = [(i, "code", f"p{rng.randrange(5)}", f"f{i}.py", "\n".join(rng.sample(pool, rng.randrange(5, 9)) + [f"    own_{i}_{k} = nothing_like_it()" for k in range(rng.randrange(4))]), 0) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, kind string, project string, file_path string, content string, f int")
    from pyspark.sql import functions as F

    ids = {r.f: r.project for r in df.select(F.xxhash64("project", "file_path").alias("f"), "project").collect()}
    vendored = set(rng.sample(sorted(ids), 6))
    pairs = [(r.f, r.other) for r in H.containment(df).collect()]
    want = {f for f in ids if len({ids[o] for g, o in pairs if g == f}) >= 2 or any(o in vendored for g, o in pairs if g == f)}
    known = spark.createDataFrame([(f,) for f in vendored], "f bigint")
    assert {r.f for r in H.copied_files(df, known, anchors=2).collect()} == want == {r.f for r in H.copied_files(df, known).collect()}
    assert 5 < len(want) < 90
