"""Near duplicates: against brute force, and what the join shuffles."""

import random

import duckdb
import pytest

from loreweave.operators import graph


def shuffled(spark):
    rows = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(rows.apply(i).totalShuffleWrite() for i in range(rows.size()))


def similar(docs, least=0.8):
    sets = {}
    for i, t in sorted(docs):
        if t not in {x for _, x in sets.values()}:
            w = t.split()
            sets[i] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)}, t)
    s = {i: x for i, (x, _) in sets.items() if x}
    return {(a, b, round(len(s[a] & s[b]) / len(s[a] | s[b]), 6)) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) >= least}


@pytest.mark.parametrize("key", ["long", "string"])
def test_shared_openings_over_many_batches(spark, key):
    rng = random.Random(5)
    opening = " ".join(f"o{i}" for i in range(40))
    docs = []
    for i in range(60):
        body = [f"w{rng.randrange(400)}" for _ in range(rng.choice([0, 3, 8, 60]))]
        docs += [(2 * i, f"{opening} {' '.join(body)}"), (2 * i + 1, f"{opening} {' '.join([*body[:-1], 'end'])}")]
    docs = [(i if key == "long" else f"k{i:03d}", t) for i, t in docs]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = graph.near_duplicate_pages(spark.createDataFrame(docs + docs[:9], f"k {key}, t string"), "k", "t").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({(r.a, r.b) for r in got}) and {tuple(r) for r in got} == similar(docs)


def test_postings_are_paired_in_steps(spark):
    index = spark.createDataFrame([(7, k, 100, 0) for k in range(50)], "x long, k long, n int, i int")
    got = graph.meeting_pairs(index, "k", 0.8, at_once=10).collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(50) for b in range(a + 1, 50)]


def test_edited_copies_shuffle_less_than_twice_their_texts(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, f"title {i}\n" + " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(2_000)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    assert graph.edited_copies(spark, str(tmp_path)).count() == 2_000
    assert shuffled(spark) - before < 2 * 2 * sum(len(t) for _, t in docs)


def test_find_duplicates_makes_no_table_of_shingles(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(3_000)]
    docs += [(10_000 + i, docs[i][1] + " more") for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    assert {(r.a, r.b) for r in graph.find_duplicates(spark, str(tmp_path)).collect()} == {(i, 10_000 + i) for i in range(5)}
    assert shuffled(spark) - before < sum(len(t) for _, t in docs)


def test_find_duplicates_broadcasts_no_texts(spark, tmp_path):
    rng = random.Random(10)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))) for i in range(500)]
    docs += [(1_000 + i, t + " more") for i, t in docs]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    found = graph.find_duplicates(spark, str(tmp_path))
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    sides = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftAnti" not in x and "LeftSemi" not in x]
    assert "SortMergeJoin" in plan and not sides


def all_similar(docs, least=0.8):
    shingles = {t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in docs if t is not None}
    found = set()
    for i, s in docs:
        for j, t in docs:
            if None not in (i, j, s, t) and i < j:
                a, b = shingles[s], shingles[t]
                same = 1.0 if s == t else len(a & b) / len(a | b) if a and b else 0.0
                if same >= least:
                    found.add((i, j, round(same, 6)))
    return found


def with_copies(rng):
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(12)]
    texts += [f"{t} more" for t in texts[:6]] + ["short one", "", "\n", "short two"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[0]) for i in range(30)] + [(200 + i, texts[12]) for i in range(9)]
    docs += [(300 + i, rng.choice(texts)) for i in range(40)] + [(400, None), (None, texts[0])]
    return rng.sample(docs, len(docs)) + docs[3:8]


@pytest.mark.parametrize("at_once", [1, 4, 128])
@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("key", ["long", "string"])
def test_every_pair_of_copies_is_listed(spark, key, several, at_once):
    docs = with_copies(random.Random(11))
    if several:  # ids with two texts, similar ones too
        t = dict(docs)
        docs += [(0, t[1]), (1, t[0]), (2, t[2] + " more"), (500, t[3]), (500, t[4])]
    docs = [(i if key == "long" or i is None else f"k{i:03d}", t) for i, t in docs]
    got = graph.duplicate_pages(spark.createDataFrame(docs, f"k {key}, t string"), "k", "t", at_once=at_once).collect()
    want = all_similar(docs)
    assert len(got) == len({(r.a, r.b, r.similarity) for r in got}) and {tuple(r) for r in got} == want
    assert len(want) > 30 * 29 / 2


def test_copies_beyond_a_broadcast_are_merged(spark, monkeypatch):
    docs = with_copies(random.Random(12))
    monkeypatch.setattr(graph, "sized_broadcast", lambda df: df)
    found = graph.duplicate_pages(spark.createDataFrame(docs, "k long, t string"), "k", "t", at_once=4)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == all_similar(docs)


def test_find_duplicates_lists_copies_as_its_sql(spark, tmp_path):
    docs = with_copies(random.Random(13)) + [(0, "one two three four five"), (900, "one two three four five")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, graph.find_duplicates(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(graph.SQL["find_duplicates"]).fetchall()) and set(got) == all_similar(docs)
