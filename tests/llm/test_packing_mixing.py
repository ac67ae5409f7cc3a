"""Packs and mixes: every item once, capacities and shares kept, running sums against a loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.llm import common, mixing, packing, tokens

WORDS = "the lease table of a snapshot store 目录 सूची ไฟล์ é".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(int(rng.expovariate(1 / 60)) + 1)), rng.choice(["wiki", "Wiki ", "issue", None]), 1) for i in range(300)]
    rows += [(900, "word " * 3000, "wiki", 1), (901, "", "wiki", 1), (902, None, "wiki", 1), (None, "x", "wiki", 1), (3, rows[3][1], rows[3][2], 1), (903, "same " * 20, "issue", 1), (904, "same " * 20, "issue", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")


def test_hilbert_neighbours():
    seen = sorted((tokens.hilbert_key((x, y, z), 3), (x, y, z)) for x in range(8) for y in range(8) for z in range(8))
    assert [k for k, _ in seen] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(seen, seen[1:]))


def test_cut_between_characters():
    whole = np.array([True, False, False, True, True])  # the second character has three tokens
    assert tokens.cut(np.arange(1, 6), whole, 2) == [(0, 1), (1, 4), (4, 5)]
    assert tokens.cut(np.arange(1, 6), whole, 4) == [(0, 4), (4, 5)]


@pytest.mark.parametrize("text", ["plain words " * 50, "สวัสดี 目录 é" * 40, "x" * 500, "🙂" * 90])
def test_parts_are_the_text_again(text):
    coder, sizes = tokens.load_ranks(tokens.tokenizer_path(), tokens.PATTERN)
    ids = np.asarray(coder.encode_ordinary(text), dtype=np.int64)
    parts = tokens.char_parts(text, ids, sizes, [7, 20])
    for limit in (7, 20):
        mine = [p for p in parts if p[0] == limit]
        assert "".join(text[p[2] : p[3]] for p in mine) == text and sum(p[4] for p in mine) == len(ids) and max(p[4] for p in mine) <= limit


def test_packs(spark, docs):
    sizes = spark.createDataFrame([("s", 64), ("l", 512)], "pack_name string, capacity_tokens int")
    common_checkpoint(spark)
    rows = packing.pack_documents(docs, sizes, block_items=200).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.text}
    for name, capacity in (("s", 64), ("l", 512)):
        mine = [r for r in rows if r.pack_name == name]
        by_pack, by_doc = {}, {}
        for r in mine:
            by_pack[r.pack_id] = by_pack.get(r.pack_id, 0) + r.n_tokens
            by_doc.setdefault(r.doc_id, []).append(r)
        assert max(by_pack.values()) <= capacity and set(by_doc) == set(texts)
        total = sum(by_pack.values())
        assert total / (len(by_pack) * capacity) > 0.9
        for d, parts in by_doc.items():
            parts.sort(key=lambda r: r.part_no)
            assert [p.part_no for p in parts] == list(range(1, len(parts) + 1))
            assert "".join(texts[d][p.start_pos : p.end_pos] for p in parts) == texts[d]
            assert len(parts) == 1 or sum(p.n_tokens for p in parts) > capacity
    # whatever the number of blocks, every item is in one pack and little room is left
    fills = [packing.pack_report(packing.pack_documents(docs, sizes, blocks=n)).where("pack_name = 's'").first() for n in (1, 20)]
    assert fills[0].tokens == fills[1].tokens and fills[1].fill > 0.95 * fills[0].fill
    assert packing.pack_documents(docs.limit(0), sizes).count() == 0
    assert packing.pack_documents(docs, sizes.limit(0)).count() == 0
    assert {r.pack_name for r in packing.pack_report(packing.pack_documents(docs, sizes)).collect()} == {"s", "l"}


def common_checkpoint(spark):
    from loreweave.llm.common import checkpoints

    checkpoints(spark)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix_reaches_shares(spark, docs):
    common_checkpoint(spark)
    out, report = mixing.mix(docs, targets(spark, [("wiki", 0.5, 1), ("issue", 0.4, 3), ("none", 0.1, 2)]))
    got = {r.source: r for r in report.collect()}
    assert got["none"].mix_tokens == 0
    assert abs(got["wiki"].reached_share - 5 / 9) < 0.02 and abs(got["issue"].reached_share - 4 / 9) < 0.02
    assert got["issue"].most_repeats <= 3 and got["wiki"].most_repeats <= 1
    assert out.count() == out.select("doc_id").distinct().count()
    same = mixing.mix(docs, targets(spark, [("wiki", 0.5, 1), ("issue", 0.4, 3), ("none", 0.1, 2)]))[0]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, same.collect()))


def test_mix_beyond_the_caps(spark, docs):
    common_checkpoint(spark)
    out, report = mixing.mix(docs, targets(spark, [("wiki", 0.5, 1), ("issue", 0.5, 2)]), total_tokens=10**9)
    got = {r.source: r for r in report.collect()}
    assert got["wiki"].mix_tokens == got["wiki"].source_tokens and got["issue"].mix_tokens == 2 * got["issue"].source_tokens
    assert mixing.mix(docs.limit(0), targets(spark, [("wiki", 1.0, 1)]))[0].count() == 0


def test_running_sum_with_a_hot_key(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", rng.randrange(50), rng.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, k string, o int, v int")
    got = {r.i: r.s for r in common.running_sum(df, "k", ["o", "i"], "v", "s").collect()}
    sums, want = {}, {}
    for i, k, o, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = sums.get(k, 0)
        sums[k] = want[i] + v
    assert got == want


def test_latest_row(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 5, None)], "k int, o int, v string")
    assert {(r.k, r.v) for r in common.latest(df, ["k"], [F.col("o")]).collect()} == {(1, "b"), (2, None)}
