"""Readers, published snapshots and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loreweave.sources import pages, snapshots
from loreweave.streaming import events as streaming


def test_pages_of_a_directory(spark, tmp_path):
    (tmp_path / "concepts").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "concepts/a.md").write_text("---\ntitle: A\ntype: concept\ncreated: 2026-01-02\n---\n# A\n")
    (tmp_path / "b.md").write_text("no header")
    (tmp_path / ".git/c.md").write_text("hidden")
    got = {r.path: (r.title, r.type, r.body) for r in pages.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"concepts/a.md": ("A", "concept", "# A\n"), "b.md": (None, None, "no header")}


def test_discovery_reasons(spark):
    rows = [("a/.env", 5), ("a/.x/b.py", 5), ("dist/a.js", 5), ("a.py", 600_000), ("b.py", 0), ("c.py", 5)]
    got = [r.x for r in spark.createDataFrame(rows, "path string, size int").select(pages.discovery_reason().alias("x")).collect()]
    assert got == ["sensitive", "hidden", "generated", "too_large", "empty", None]


def test_transcript_lines(spark, tmp_path):
    lines = [json.dumps({"type": "user", "entrypoint": "cli", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}}), "{broken", json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "yes"}]}})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = [(r.event_type, r.role, r.content) for r in pages.read_transcript(spark, str(tmp_path / "t.jsonl")).orderBy("order").collect()]
    assert got[0] == ("user", "user", "hi") and len(got) == 2 and json.loads(got[1][2])[0]["text"] == "yes"


def test_task_lines(spark, tmp_path):
    (tmp_path / "roadmap.md").write_text("# R\n## Now\n- [~] P1 Fix it | est: 2h | owner: ada\n- [ ] Plain one\nnote\n## Done\n- [x] P0 Old | id: task-1 | done: 2026-01-01\n")
    got = [(r.section, r.sign, r.priority, r.title, r.est, r.owner, r.id) for r in pages.read_tasks(spark, str(tmp_path / "roadmap.md")).orderBy("pos").collect()]
    assert got == [("Now", "~", "P1", "Fix it", "2h", "ada", None), ("Now", " ", None, "Plain one", None, None, None), ("Done", "x", "P0", "Old", None, None, "task-1")]


def test_task_lines_with_bars_notes_and_repeated_ids(spark, tmp_path):
    (tmp_path / "r.md").write_text("## Now\n- [ ] A | b | c | owner: x | y | est: 1h | owner: z\n  note of it\n\n- [?] P9 odd | id: t1\n## Done\n- [x] P0 | id: t1 | took: 2h\n- [x]no task\n")
    rows = pages.read_tasks(spark, str(tmp_path / "r.md")).orderBy("pos").collect()
    assert [(r.sign, r.priority, r.title, r.owner, r.est, r.id, r.took, r.repeated) for r in rows] == [(" ", None, "A | b | c", "x | y", "1h", None, None, False), ("?", None, "P9 odd", None, None, "t1", None, True), ("x", "P0", "", None, None, "t1", "2h", True)]
    assert [(r.section, r.line) for r in pages.read_task_notes(spark, str(tmp_path / "r.md")).orderBy("pos").collect()] == [("Now", "  note of it"), ("Done", "- [x]no task")]


def test_snapshots_are_published_once(spark, tmp_path):
    root = str(tmp_path / "table")
    assert snapshots.current(spark, root) == (0, None) and snapshots.read(spark, root) is None
    assert snapshots.publish(spark.range(3), root, 0) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark.range(9), root, 0)
    changes = spark.createDataFrame([(1, True), (7, False)], "id long, gone boolean")
    assert snapshots.publish(snapshots.merge(snapshots.read(spark, root), changes, "id", "gone"), root, 1) == 2
    assert sorted(r.id for r in snapshots.read(spark, root).collect()) == [0, 2, 7]


def test_streams_end_in_the_batch_result(spark, sf_dir, tmp_path):
    stream = streaming.event_stream(spark, sf_dir)
    streaming.run_available(streaming.stream_accepted(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    from loreweave.operators.events import dedupe_60s

    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.event_id for r in dedupe_60s(spark, sf_dir).collect()}


def test_stream_sessions_count_every_event_once(spark, sf_dir, tmp_path):
    out = streaming.stream_sessions(streaming.event_stream(spark, sf_dir), late="0 seconds")
    streaming.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    closed = spark.read.parquet(str(tmp_path / "out"))
    last = batch.agg(F.max("ts")).first()[0]
    from loreweave.operators.events import sessionize

    want = sessionize(spark, sf_dir).where(F.col("ended") < F.lit(last) - F.expr("interval 31 minutes"))
    assert closed.count() == want.count()
