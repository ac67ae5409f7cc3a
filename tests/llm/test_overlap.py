"""Overlapping queries: what counts as the same words, and the join against all pairs."""

import itertools
import random
from collections import Counter

import pytest

from loreweave.llm import overlap as O

SAME = [
    ("where is the lease set", "WHERE IS THE LEASE SET"), ("where is the lease set", "whére  is\tthe lease set?"), ("where is the lease set", "please, where is the lease set"),
    ("where is the lease set", "where is the leases set"), ("where is the lease set", "where is the laese set"), ("where is the lease set", "set where is the lease"),
    ("dispatchLocalTariff", "dispatch_local_tariff"), ("ｗｈｅｒｅ is it", "where is it"), ("per favore, dove sta il lease", "dove sta il lease"), ("freezeEarlyBatch", "FREEZEEARLYBATCH"),
]
OTHER = [("where is the lease set", "where is the gauge set"), ("who chose the grid", "who chose the panel"), ("limit is 10", "limit is 12"), ("", "please"), ("please", "where")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert O.same_question(O.canonical(a), O.canonical(b), {})


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert not O.same_question(O.canonical(a), O.canonical(b), {"lease": 100, "gauge": 90})


def test_known_words_are_no_slips_of_each_other():
    a, b = O.canonical("rank the grade"), O.canonical("rank the trade")
    assert O.same_question(a, b, {}) and not O.same_question(a, b, {"grade": 40, "trade": 30})


@pytest.mark.parametrize("size", [1, 10, 100])
def test_same_verdict_at_every_size(size):
    counts = {"stable": 9, "stale": 5, "shared": 18, "shard": 2, "span": 6, "spawn": 5, "cursor": 57, "flush": 40, "flusher": 1}
    for a, b in (("stable", "stale"), ("shared", "shard"), ("span", "spawn"), ("flush", "flusher")):
        assert not O.same_question(O.canonical(f"where is the {a}"), O.canonical(f"where is the {b}"), {w: n * size for w, n in counts.items()})
    assert "cusor" not in O._told({"cusor": 4 * size}, 5000 * size) and "thaw" in O._told({"thaw": 5 * size}, 400 * size)
    slips = {w: n * size for w, n in counts.items()} | {"cusor": size}
    assert O.same_question(O.canonical("where is the cursor"), O.canonical("where is the cusor"), slips)


SCHEMA = "id string, project string, query string, split string, source string, relevant array<struct<path:string,start_line:int,end_line:int>>, added_at timestamp_ntz, words int"


def test_join_against_all_pairs(spark):
    rng = random.Random(4)
    nouns = ["lease", "gauge", "panel", "grid", "album", "bucket", "carton", "window", "ledger", "signal"]
    rows, seen = [], []
    for i in range(400):
        base = f"where is the {rng.choice(nouns)} of the {rng.choice(nouns)} kept"
        if rng.random() < 0.4 and seen:
            base = rng.choice(seen)
            k = rng.randrange(len(base) - 1)
            base = [base.upper(), "please " + base, base[:k] + base[k + 1 :], base + "?"][rng.randrange(4)]
        seen.append(base)
        hot = "p0" if rng.random() < 0.6 else f"p{rng.randrange(3)}"
        rel = [(["a/b.py", "a\\b.py", "./a//b.py"][rng.randrange(3)], 1, 2)] if rng.random() < 0.7 else []
        rows.append((f"{hot}-{i:04d}", hot, base, rng.choice(["train", " TRAIN", "dev", "Evaluation", None]), rng.choice(["mined", None]), rel, None, 1))
    rows += [rows[0], (None, "p0", "x", "train", None, [], None, 1), ("z1", None, None, "train", None, None, None, 1), ("z2", None, "", "dev", None, None, None, 1), ("z3", None, "alone here", "dev", None, None, None, 1), ("z4", None, "alone here", "train", None, None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id_a, r.id_b) for r in O.overlapping_records(df).collect()}
    once = {r[0]: r for r in rows if r[0] and r[3]}
    side = {k: "T" if r[3].strip().lower().startswith("train") else "H" for k, r in once.items()}
    words = {k: O.canonical(r[2]) for k, r in once.items()}
    group = {k: (r[1], bool(r[5])) for k, r in once.items()}
    known = Counter(w for c in {(group[k], tuple(words[k])) for k in once} for w in set(c[1]))
    want = {(a, b) for a, b in itertools.combinations(sorted(once), 2) if side[a] != side[b] and group[a] == group[b] and words[a] and words[b] and O.same_question(words[a], words[b], known)}
    assert got == want and len(want) > 50 and ("z3", "z4") in got
    report = O.overlap_report(df)
    assert report.agg({"overlapping": "sum"}).first()[0] == len({k for p in want for k in p if side[k] == "H"})
    assert O.overlapping_records(df.limit(0)).count() == 0


def test_shingles_cover_every_slip():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.choice([3, 4, 5, 6, 7, 8, 19, 21, 22, 23, 24, 40])))
        b = a
        for _ in range(rng.choice([1, 2])):
            k = rng.randrange(len(b))
            b = [b[:k] + b[k + 1 :], b[:k] + "x" + b[k:], b[:k] + "x" + b[k + 1 :], b[:k] + b[k + 1 : k + 2] + b[k : k + 1] + b[k + 2 :]][rng.randrange(4)]
        if O._slip(a, b, {}):
            assert set(O.shingles(a, False)) & set(O.shingles(b, True)) and set(O.shingles(b, False)) & set(O.shingles(a, True)), (a, b)


def test_join_finds_two_slips_and_long_fillings(spark):
    long = "please hi hello hey thanks can you kindly tell me just now so where is the lease"
    pairs = [
        ("where is authentication middleware kept", "where is athenticaton mddlewar kept"), ("initialization", "intializaton"), ("how big is the box", "how big is the bix"), ("where is the lease", long),
        ("internationalizationhandlerfactory", "internatonalizationhandlrfactory"), ("pleaze", "please thanks"),
    ]
    rows = [(f"t{i}", f"p{i}", a, "train", None, [], None, 1) for i, (a, _) in enumerate(pairs)] + [(f"v{i}", f"p{i}", b, "dev", None, [], None, 1) for i, (_, b) in enumerate(pairs)]
    rows += [("u0", "p0", "authentication middleware of another", "train", None, [], None, 1)] + [(f"w{i}", "p0", f"where is {chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3} kept", "train", None, [], None, 1) for i in range(58)]
    turned = [(r[0], r[1] + "x", r[2], {"train": "dev", "dev": "train"}[r[3]], *r[4:]) for r in rows if r[0] != "t5" and r[0] != "v5"]
    for some, n in ((rows, 6), (turned, 5)):
        got = {(r.id_a, r.id_b) for r in O.overlapping_records(spark.createDataFrame(some, SCHEMA)).collect()}
        assert got == {(f"t{i}", f"v{i}") for i in range(n)}
