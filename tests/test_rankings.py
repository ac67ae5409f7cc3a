"""Rankings by rare words: against brute force."""

import random
from collections import Counter
from pathlib import Path

import duckdb
from compare import canonical

from loreweave.operators import evaluate
from loreweave.session import checkpoints


def tables(spark, folder, queries, files):
    target = "array<struct<path string, start_line int, end_line int>>"
    q = [(f"q{i}", "p", t, "symbol", "dev", [], None) for i, t in enumerate(queries)]
    spark.createDataFrame(q, f"id string, project string, query string, category string, split string, relevant {target}, added_at timestamp").write.parquet(f"{folder}/dataset.parquet")
    c = [(i, "code", "p", f, n, 1, 9) for i, (f, n) in enumerate(files)]
    spark.createDataFrame(c, "id long, kind string, project string, file_path string, func_name string, line_start int, line_end int").write.parquet(f"{folder}/chunks.parquet")


def test_rankings_against_brute_force(spark, tmp_path):
    rng, words = random.Random(4), [f"{a}{b}word" for a in "abc" for b in "abc"]
    files = [("/".join(rng.sample(words, rng.randrange(1, 5))) + f"/{i}", "_".join(rng.sample(words, rng.randrange(1, 5)))) for i in range(120)]
    queries = [" ".join(rng.sample(words, rng.randrange(1, 6))) for _ in range(80)]
    tables(spark, tmp_path, queries, files)

    def want(items):
        df, out = Counter(w for _, ws in items for w in ws), set()
        for i, q in enumerate(queries):
            rare = sorted({w for w in q.split() if df[w]}, key=lambda w: (df[w], w))[:3]
            hits = sorted((-round(sum(1 / df[w] for w in rare if w in ws), 9), item) for item, ws in items if set(rare) & ws)
            out |= {(f"q{i}", item, k + 1) for k, (_, item) in enumerate(hits[:5])}
        return out

    split = lambda t: {w for w in t.replace("/", " ").replace("_", " ").split() if w in words}
    assert {(r.query_id, r.path, r["rank"]) for r in evaluate.path_ranking(spark, str(tmp_path)).collect()} == want([(f, split(f)) for f, _ in files])
    assert {(r.query_id, (r.path, r.id), r["rank"]) for r in evaluate.span_ranking(spark, str(tmp_path)).collect()} == want([((f, i), split(n)) for i, (f, n) in enumerate(files)])


TARGET = "array<struct<path string, start_line int, end_line int>>"


def span_tables(spark, folder, queries, chunks):
    spark.createDataFrame(queries, f"id string, project string, query string, category string, split string, relevant {TARGET}, added_at timestamp").repartition(2).write.parquet(f"{folder}/dataset.parquet")
    spark.createDataFrame(chunks, "id long, kind string, project string, file_path string, func_name string, line_start int, line_end int").repartition(2).write.parquet(f"{folder}/chunks.parquet")


def by_sql(folder, name):
    c = duckdb.connect()
    for t in ("dataset", "chunks"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return canonical(c.sql(evaluate.SQL[name]).df())


def test_span_metrics_against_sql_on_odd_tables(spark, tmp_path):
    rng, words = random.Random(6), [f"{a}{b}word" for a in "abc" for b in "abc"]
    line = lambda: rng.choice([None, 0, 1, 2, 5, 9, 20])
    chunks = [(i, "code", rng.choice(["p", "q", None]), "/".join(rng.sample(words, 2)) + f"/{i % 40}", rng.choice([None, "_".join(rng.sample(words, 3))]), line(), line()) for i in range(150)]
    files = [(c[3], line(), line()) for c in chunks]
    queries = [(f"q{i}", rng.choice(["p", "q", None]), " ".join(rng.sample(words, rng.randrange(4))), "symbol", rng.choice(["dev", "Training", "x"]), rng.choice([None, [], rng.sample(files, 3), [(f"./{rng.choice(files)[0]}", 1, 9)], [(None, 1, 9)]]), None) for i in range(120)]
    span_tables(spark, tmp_path, queries, chunks)
    for name in ("span_metrics", "fused_ranking"):
        assert canonical(evaluate.QUERIES[name](spark, str(tmp_path)).toPandas()) == by_sql(tmp_path, name)


def test_span_metrics_lists_methods_without_a_hit(spark, tmp_path):
    span_tables(spark, tmp_path, [(f"q{i}", "p", "nothing like that", "symbol", "dev", [("a/file", 1, 9)][i:], None) for i in range(2)], [(1, "code", "p", "a/file", "unit", 1, 9)])
    got = canonical(evaluate.span_metrics(spark, str(tmp_path)).toPandas())
    assert len(got) == 6 and got == by_sql(tmp_path, "span_metrics")


def test_span_metrics_writes_no_hits(spark, tmp_path):
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "abcdefgh"]
    chunks = [(i, "code", "p", f"{words[i % 64]}/{i}", words[(i + 7) % 64], 1, 9) for i in range(640)]
    span_tables(spark, tmp_path, [(f"q{i}", "p", words[i % 64], "symbol", "dev", [], None) for i in range(3_000)], chunks)
    checkpoints(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    written = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = written()
    assert evaluate.span_metrics(spark, str(tmp_path)).count() == 6
    assert written() == before
