"""Filter audit against plain loops; whitening against dense linear algebra."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from postwatch.llm import audit, whitening

DOCS = "extra string, doc_id long, text string, source string, part string, code int, good int"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails_of(text):
    words = [w for w in
             text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words),
            100 * capitals > 5 * len(text), any(c in "#$%&*|" for c in text)]


def brute_audit(docs, labels):
    rows = []
    for doc_id, text, source in docs:
        copied = any((other_text or "") == (text or "") and other is not None
                     and (doc_id is None or other < doc_id) for other, other_text, _ in docs)
        marks = [(q, t) for d, q, t in labels if d is not None and d == doc_id]
        rows.append((source or "", [*fails_of(text or ""), copied],
                     any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations(range(5)):
            name, alive = "".join("ABCDE"[i] for i in order), own
            for step, i in enumerate(order, 1):
                gone = [r for r in alive if r[1][i]]
                left = [r for r in alive if not r[1][i]]
                shapley[part, i] += len(gone)
                out[part, name, step] = [
                    len(left), len(gone), sum(r[1][i] for r in own) - len(gone),
                    sum(r[1][i] and sum(r[1]) == 1 for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
                alive = left
    return {(p, n, s): [*v, shapley[p, "ABCDE".index(n[s - 1])]]
            for (p, n, s), v in out.items()}


def audited(spark, docs, labels):
    rows = [("x", d, t, s, "p", 7, 1) for d, t, s in docs]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    marks = spark.createDataFrame([(*m, "t") for m in labels], LABELS)
    got = audit.filter_audit(df, marks).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COUNTS] for r in got}
    assert len(found) == len(got)
    return found


def texts(count):
    random.seed(3)
    words = [f"w{i}" for i in range(40)] + ["Big", "LOUD", "a#b", "c|d", "é"]
    out = [" ".join(random.choices(words, k=random.choice([5, 49, 50, 80]))) for _ in range(count)]
    return out + [" ".join(f"plain{i}" for i in range(60)), "", None, " word\x0btwo\x0c",
                  " ".join(f"word{i}" for i in range(200_000))]


def test_audit_equals_loops_with_nulls_ties_and_copies(spark):
    pool = texts(12)
    docs = [(random.choice([None, 1, 2, 3, i]), random.choice(pool),
             random.choice([None, "", "a", "b"])) for i in range(80)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (9, 1, None), (40, 0, 0)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_hot_text_and_of_no_rows(spark):
    docs = [(i, "same text again", "s") for i in range(3000)] + [(9999, "other", "s")]
    got = audited(spark, docs, [(0, 1, 0)])
    assert got["s", "EABCD", 1][:3] == [2, 2999, 0]
    assert got["s", "AEBCD", 1] == [0, 3001, 0, 2, 1, 0, got["s", "AEBCD", 1][6]]
    assert audited(spark, [], [(0, 1, 0)]) == {}
    assert len(audited(spark, docs[:1], [])) == 600


def test_audit_efficiency_of_shapley():
    """The values of all filters add up to what all of them remove, over all orders."""
    random.seed(5)
    tensor = np.array([random.randrange(50) for _ in range(32)]).reshape(1, 2, 2, 2, 2, 2)
    steps, out = audit.audit_tensors(tensor, tensor, tensor)
    removed = tensor.sum() - tensor[0, 0, 0, 0, 0, 0]
    of = {order[step - 1]: v for (order, step), v in zip(steps, out["shapley"][0])}
    assert sum(of.values()) == 120 * removed
    assert (out["good_lost"] == out["removed"]).all()


EMB = "vec_id long, embedding array<float>, x string, weight int, deviation int"


def whitened(spark, vectors, **options):
    rows = [(i, v, "x", 0, 0) for i, v in vectors]
    df = spark.createDataFrame(rows, EMB).repartition(3)
    return whitening.whiten(df, **options).collect()


def brute_whitening(vectors, once=False):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v])
            for i, v in vectors if v is not None and all(
                c is not None and np.isfinite(c) for c in v)]
    base = [list(x) for x in {tuple(x) for _, x in kept}] if once else [x for _, x in kept]
    n, sums = len(base), [sum(c) for c in zip(*base)]
    away = np.array(base, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    return kept, n, sums, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("once", [False, True])
def test_whitening_equals_dense_algebra(spark, once):
    rng = np.random.default_rng(2)
    spread = rng.normal(size=(40, 40)) * np.geomspace(30, 1, 40)
    vectors = [(i, (rng.normal(size=40) @ spread).tolist()) for i in range(300)]
    vectors += [(400 + i % 7, vectors[0][1]) for i in range(150)]  # a hot vector, repeated ids
    vectors += [(None, vectors[1][1]), (900, None), (901, [None, *vectors[2][1][1:]]),
                (902, [float("nan")] * 40), (903, [float("inf")] * 40)]
    got = whitened(spark, vectors, weights="one" if once else "counts")
    kept, n, sums, values, axes = brute_whitening(vectors, once)
    assert len(got) == 32 * len(kept) and {r["n"] for r in got} == {n}
    want = {}
    for vec_id, x in kept:
        away = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
        want[vec_id, sum((n * a - s) ** 2 for a, s in zip(x, sums))] = away
    signs = {}
    for r in got:
        k = r["component"] - 1
        value = want[r["vec_id"], int(r["deviation"])][k]
        sign = signs.setdefault(k, np.sign(value) * np.sign(r["whitened"]))
        assert abs(sign * r["whitened"] - value) < 1e-6
        assert abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-6
        assert r["identity_error"] < 1e-8
    assert {r["component"] for r in got} == set(range(1, 33))


def test_whitening_without_variance_rows_or_equal_lengths(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [1.0, 2.0])] * 5) == []
    assert whitened(spark, [(1, None), (2, [None])]) == []
    flat = whitened(spark, [(i, [float(i), 5.0, -float(i)]) for i in range(4)])
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)
    with pytest.raises(ValueError):
        whitened(spark, [(1, [1.0]), (2, [1.0, 2.0])])


def test_whitening_of_very_large_entries_is_exact(spark):
    vectors = [(i, [float(np.float32(1e12 * i)), float(i % 3)]) for i in range(50)]
    got = whitened(spark, vectors)
    kept, n, sums, _, _ = brute_whitening(vectors)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want
