"""Removal of repeated word sequences against plain sets of windows."""

import hashlib
import random

import numpy as np

from postwatch.llm import substring
from postwatch.operators.membership import maybe_in, membership

DOCS = "doc long, doc_id long, text string, key string, asked int"


def words_of(text):
    return (text or "").encode().split()


def brute(docs, window):
    first = {}
    for doc_id, text in docs:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            d = float("inf") if doc_id is None else doc_id
            first[g] = min(first.get(g, d), d)
    out = []
    for doc_id, text in docs:
        w, d = words_of(text), float("inf") if doc_id is None else doc_id
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                keep[i:i + window] = [False] * window
        left = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((doc_id, len(w), keep.count(False), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def removed(spark, docs, **options):
    df = spark.createDataFrame([(7, d, t, "x", 1) for d, t in docs], DOCS).repartition(3)
    return sorted(map(tuple, substring.remove_repeats(df, **options).collect()), key=repr)


def test_random_passages_nulls_ties_and_repeats(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(30)]
    prose = lambda n: random.choices(vocabulary, k=n)
    passages = [prose(random.choice([9, 10, 14, 40])) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [prose(random.randrange(12)) for _ in range(3)]
        parts[1:1] = random.choices(passages, k=random.randrange(3))
        text = [w for p in parts for w in p]
        if random.random() < 0.3 and len(text) > 12:
            text[random.randrange(len(text))] = "edit"
        docs.append((random.choice([i, i, 5, None]),
                     random.choice([" ", "\n", "\x0b "]).join(text)))
    docs += [(500, None), (501, ""), (502, " \t\n"), docs[0], (503, "é\xa0x " * 30)]
    docs += [(600, "a " * 400), (601, "a " * 11), (602, "b " + "a " * 900), (603, "a b " * 60)]
    for window, anchor in ((10, 4), (10, 10), (3, 16)):
        assert removed(spark, docs, window=window, anchor=anchor) == brute(docs, window)


def test_production_window_on_copies_and_a_hot_passage(spark):
    random.seed(8)
    prose = lambda n: " ".join(f"x{random.randrange(10**6)}" for _ in range(n))
    passage, long = prose(60), prose(20_000)
    docs = [(i, f"{prose(30)} {passage} {prose(20)}") for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(200)]
    docs += [(2000, long), (2001, long + " end"), (2002, prose(10) + " " + long[len(long) // 2:])]
    docs += [(3000, prose(49)), (3001, prose(50))]
    docs += [(3002, docs[-1][1]), (3003, docs[-2][1])]
    got = removed(spark, docs)
    assert got == brute(docs, 50)
    assert sum(r[2] for r in got) > 0


def test_no_rows(spark):
    assert removed(spark, []) == []


def test_spans_name_their_source(spark):
    words = [f"x{i}" for i in range(300)]
    docs = [(1, " ".join(words)), (2, "y " + " ".join(words[100:200])), (3, " ".join(words))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {(r["doc"], r["start"], r["n"], r["src"], r["src_start"])
             for r in substring.repeated_spans(df).collect()}
    of_two = [s for s in spans if s[0] == 2]
    assert {i for s in of_two for i in range(s[1], s[1] + s[2])} == set(range(1, 101))
    assert {(s[3], s[4] - s[1]) for s in of_two} == {(1, 99)}
    assert sum(s[2] - 49 for s in of_two) == 51  # every window once
    assert sum(s[2] - 49 for s in spans if s[0] == 3) == 251


def test_a_span_that_differs_from_its_source_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x b c d")], "doc_id long, text string")
    found = substring.graph(docs, window=2)
    keys = {r["doc_id"]: r["key"] for r in found.rows.collect()}
    columns = ("doc long, key long, start int, src long, src_key long, src_start int, words int")
    spans = spark.createDataFrame([(2, keys[2], 1, 1, keys[1], 1, 3),
                                   (2, keys[2], 0, 1, keys[1], 0, 2)], columns)
    assert [r["start"] for r in found.verified(spans).collect()] == [1]


def test_runs_of_any_length_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(0)
    part, before = (rng.integers(0, 2**63, n).astype("uint64") for n in (500, 3000))
    a, b = substring.Rolling(part), substring.Rolling(np.r_[before, part])
    for which in (0, 1):
        assert a.of(np.array([7]), 400, which) == b.of(np.array([3007]), 400, which)
    assert (substring.sliding_min(part, 35)[3] == part[3:38].min())


def test_membership_filter_loses_nothing(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    few = ids.where("k % 10 = 0")
    found = membership(few, ["k"], words=1 << 12)
    inside = {r["k"] for r in maybe_in(ids, ["k"], found, words=1 << 12).collect()}
    outside = {r["k"] for r in maybe_in(ids, ["k"], found, 1 << 12, inside=False).collect()}
    assert inside >= set(range(0, 20_000, 10)) and len(inside) < 3000
    assert outside == set(range(20_000)) - inside
