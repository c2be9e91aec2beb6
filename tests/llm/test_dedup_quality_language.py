"""Dedup, quality, language and licence operators against SQL and brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from postwatch.llm import exact, langid, licenses, lines, packing, quality, simhash
from postwatch.operators.components import components, union_find

from test_archives_chat_packing import SF, oracle, rows_of

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def frame(spark, rows, extra="digest int, fp int, component int, key int, n int"):
    """doc_id and text with further columns whose names the operators use themselves."""
    some = len(extra.split(","))
    return spark.createDataFrame([(*r, *range(some)) for r in rows],
                                 f"doc_id long, text string, {extra}")


# Exact


def test_exact_query_equals_sql(spark):
    assert rows_of(exact.op9_exact_dedup(spark, SF)) == oracle("documents", exact.OP9_SQL)


HARD = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab "), (6, "a  b"), (7, "A b"),
        (None, "a b c"), (8, "abc"), (None, None), (9, "x"), (9, "x"), (10, "a b")]


def test_exact_nulls_ties_and_weak_digest(spark):
    docs = frame(spark, HARD).repartition(3)
    sha = sorted(map(repr, exact.exact_groups(docs).drop("digest").collect()))
    for digest in (F.lit("same"), F.substring("_norm", 1, 1)):
        weak = exact.exact_groups(docs, digest=digest, salts=2).drop("digest").collect()
        assert sorted(map(repr, weak)) == sha
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"])
           for r in exact.exact_groups(docs).collect()}
    assert {(1, 3, 4, False), (3, 3, 4, True), (6, 6, 3, True), (4, 6, 3, False),
            (7, 7, 1, True), (9, 9, 2, True), (10, 10, 1, True)} <= got
    assert (None, None, 2, True) in got and (8, None, 2, False) in got  # the longest text stays
    assert exact.exact_groups(docs.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps):
    """{doc_id: smallest doc_id reachable} by comparing all pairs."""
    ids = sorted(fps)
    u, v = [], []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                u.append(a)
                v.append(b)
    return {**{i: i for i in ids}, **dict(zip(*union_find(u, v)))}


def test_simhash_query_equals_brute_force(spark, documents):
    fps = {i: plain_fingerprint(t) for i, t in zip(documents.doc_id, documents.text)}
    want = components_of(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in simhash.op7_simhash_neardup(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_simhash_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('é b c d') AS h").first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest("é b c d".encode(), 42)


def test_simhash_nulls_blanks_repeats(spark):
    docs = frame(spark, [(3, None), (2, ""), (5, " \t"), (7, "One two"), (8, "one TWO"),
                         (8, "one two"), (None, "one two"), (9, "other words here now and then")])
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in
                 simhash.near_groups(docs).collect())
    assert got == [(0, 7), (2, 2), (3, 2), (5, 2), (7, 7), (8, 7), (8, 7), (9, 9)]
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_simhash_links_connect_dense_balls_and_chains(spark):
    """Chunks smaller than a bucket, chains of many steps, balls: the components stay right."""
    random.seed(3)
    fps = {random.getrandbits(64) for _ in range(50)}
    for _ in range(4):
        at = random.getrandbits(64)
        fps |= {at ^ 1 << random.randrange(64) ^ 1 << random.randrange(64) for _ in range(60)}
    at = random.getrandbits(64)
    for step in range(60):
        at ^= sum(1 << b for b in random.sample(range(64), 4))
        fps.add(at)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components_of({f: f & (1 << 64) - 1 for f in signed})
    for chunk in (7, 20_000):
        found = components(simhash.near_links(df, chunk)).collect()
        assert {**{f: f for f in signed}, **{r[0]: r[1] for r in found}} == want


def test_block_masks_share_a_key_at_four_bits():
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks()]
    random.seed(2)
    for _ in range(2000):
        x = sum(1 << b for b in random.sample(range(64), 4))
        assert any(x & m == 0 for m in masks)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 3000)] + [(7, 7), (5, 4), (10_000, 9_999)]
    random.seed(4)
    random.shuffle(links)
    got = dict(components(spark.createDataFrame(links, "u long, v long").repartition(8)).collect())
    assert got == {**{i: 0 for i in range(1, 3001)}, 10_000: 9_999}


# Lines


def plain_line_groups(docs):
    first, places = {}, []
    for doc_id, text in sorted(docs):
        for number, raw in enumerate((text or "").split("\n")):
            if line := lines.normalized(raw):
                first.setdefault(line, len(places))
                places.append((doc_id, number, line))
    shingles = {x: {x[i:i + 6] for i in range(max(1, len(x) - 5))} for x in first}
    held, u, v = defaultdict(list), [], []
    for x, parts in shingles.items():
        shared = Counter(y for p in parts for y in held[p])
        for y, n in shared.items():
            if n >= 0.8 * (len(parts) + len(shingles[y]) - n):
                u.append(first[x])
                v.append(first[y])
        for p in parts:
            held[p].append(x)
    root = dict(zip(*union_find(u, v)))
    return {(d, n): places[root.get(first[x], first[x])][:2] for d, n, x in places}


def test_line_query_equals_brute_force(spark, documents):
    want = plain_line_groups(zip(documents.doc_id, documents.text))
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"])
           for r in lines.op4_line_dedup(spark, SF).collect()}
    missed = [k for k in want if want[k] != got[k]]
    assert got.keys() == want.keys() and len(missed) <= 0.01 * len(want)


def test_lines_nulls_blanks_and_near_copies(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    docs = frame(spark, [(1, f"{base}\n\n  \nx"), (2, base.upper() + "  "), (3, base + "!"),
                         (4, None), (5, ""), (6, "x\nsomething else entirely, on its own"),
                         (None, base)], "uid int, digest int, bands int")
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"], r["kept"])
           for r in lines.line_groups(docs).collect()}
    assert got == {(1, 0): (1, 0, True), (1, 3): (1, 3, True), (2, 0): (1, 0, False),
                   (3, 0): (1, 0, False), (6, 0): (1, 3, False), (6, 1): (6, 1, True),
                   (None, 0): (1, 0, False)}
    assert lines.line_groups(docs.limit(0)).count() == 0


def test_line_bands_recall_pairs_at_the_limit():
    random.seed(6)
    hit = total = 0
    for _ in range(300):
        a = "".join(random.choices("abcdefgh ", k=200)).strip()
        at = random.randrange(20, 160)
        b = a[:at] + "".join(random.choices("ijkl", k=9)) + a[at + 9:]
        parts = [{x[i:i + 6] for i in range(len(x) - 5)} for x in (a, b)]
        if len(parts[0] & parts[1]) >= 0.8 * len(parts[0] | parts[1]):
            total += 1
            one, two = lines.bands_of([a, b])
            hit += bool((one == two).any())
    assert total > 100 and hit >= 0.98 * total


# Quality


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    held = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum((text or "").count(s) for s in "#*$%&|<>"),
            len(held) - len(set(held)), len(covered), failed)


def test_quality_query_equals_brute_force(spark, documents):
    got = {r["doc_id"]: r for r in quality.op8_quality_rules(spark, SF).collect()}
    assert len(got) == len(documents)
    for doc_id, text in zip(documents.doc_id, documents.text):
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"], r["base_failed"]) == plain_counts(text)
        assert not (r["kept"] and r["base_failed"])


def test_quality_line_frequency_per_host(spark):
    """A footer of many documents goes; a document that is little else is rejected; copies of one
    document do not make its lines frequent; other hosts are counted apart."""
    footer = "All rights reserved by the owners of this site and their many friends abroad"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(15))
    rows = [(i, f"{body(i)}\n{body(i + 1000)}\n{footer}", "h") for i in range(30)]
    rows += [(100, footer + "\nshort " + footer[:20], "h"), (101, footer, "other"),
             (102, footer + "\nnew words", None)]
    copy = "\n".join(body(7000 + k) for k in range(5))
    rows += [(200 + i, copy, "h") for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows],
                                 "doc_id long, text string, source string, key int, kind int")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, limit=10, min_left=0.5).collect()}
    assert all(got[i]["kept"] and got[i]["removed_chars"] > 50 for i in range(30))
    assert not got[100]["kept"] and not got[100]["base_failed"]
    assert got[101]["kept"] and got[102]["kept"]
    assert all(got[200 + i]["kept"] for i in range(60))


def test_quality_nulls_and_long(spark):
    long = "one two three four five six seven eight nine ten\n" * 3000
    docs = spark.createDataFrame([(1, None, None), (None, "a", "h"), (3, long, None), (3, "", "")],
                                 "doc_id long, text string, source string")
    got = [(r["doc_id"], r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["kept"])
           for r in quality.quality_rules(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, 0, 0, False), (None, 1, 0, 0, False), (3, 30000, 2999, 30000, False),
         (3, 0, 0, 0, False)], key=str)
    assert quality.quality_rules(docs.limit(0)).count() == 0


# Language


def plain_phrases(text, learnt):
    count = 0
    for at in range(0, len(text), langid.BLOCK):
        block, i = text[at:at + langid.BLOCK], 0
        while i < len(block):
            size = 1
            while i + size <= len(block) and block[i:i + size] in learnt:
                size += 1
            i += max(1, size - 1)
            count += 1
    return count


def test_cross_parsing_equals_search():
    random.seed(8)
    texts = ["".join(random.choices("abc dé", k=n)) for n in (1, 5, 300, 900)] + ["zz漢 a", "b"]
    learnt = ["".join(random.choices("abc d", k=400)), "".join(random.choices("bcd é", k=300))]
    codes = langid.letter_codes(learnt)
    as_text = lambda x: "".join(chr(33 + c) for c in x)
    tables = [langid.symbols(x, codes) for x in learnt]
    alphabet = int(codes.max()) + 1
    parsed = [langid.parse_table(x, alphabet) for x in tables]
    model = langid.Model(["a", "b"], codes, np.concatenate(parsed).ravel(),
                         np.array([0, len(parsed[0])]), alphabet, 300)
    coded = [langid.symbols(x, codes) for x in texts]
    assert model.phrases(coded).tolist() == [
        [plain_phrases(as_text(x), as_text(y)) for y in tables] for x in coded]


def test_language_query_on_held_out(spark, documents):
    got = {r["doc_id"]: r for r in langid.op5_language_id(spark, SF).collect()}
    assert len(got) == len(documents)
    held = [(got[i]["lang_pred"], lang) for i, lang in zip(documents.doc_id, documents.lang)
            if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) > 20
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_nulls_and_no_training(spark):
    docs = spark.createDataFrame(
        [(1, "alpha beta gamma " * 40, "x", 0), (2, "ωμέγα θήτα ζήτα " * 40, "y", 0),
         (3, None, "x", 0), (4, "12 !", None, 0), (5, "alpha gamma", None, 0),
         (None, "θήτα", None, 0), (6, "漢字", None, 0)],
        "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in langid.predict(
        docs, langid.fit(docs)).collect()}
    assert got == {1: ("x", True), 2: ("y", True), 3: ("und", False), 4: ("und", False),
                   5: ("x", True), None: ("y", True), 6: ("x", True)}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(bare) is None
    assert {r["lang_pred"] for r in langid.predict(bare, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


# Licences


def test_license_scan(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.fit(docs)
    named = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
             "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "Released under the MIT License.": "mit"}
    want = {(i, n): family for i, text in zip(documents.doc_id, documents.text)
            for n, line in enumerate(text.split("\n"))
            for words, family in named.items() if words in line}
    got = {(r["doc_id"], r["paragraph"]): r["family"]
           for r in licenses.scan(docs, model).where("confirmed").collect()}
    assert got == want
    hard = frame(spark, [
        (1, None), (2, ""), (3, "\n\nreleased under the mit license"), (None, "Licensed under CC BY 4.0"),
        (5, "We licensed the film to the college under the old terms of the general manager"),
        (6, "Some words. " * 3000 + "This work is licensed under the GNU General Public License, "
            "version 3. " + "More words. " * 3000)], "words int, family int, line int")
    found = licenses.scan(hard, model).where("confirmed").collect()
    assert sorted((r["doc_id"] or 0, r["paragraph"], r["family"]) for r in found) == [
        (0, 0, "cc-by-4.0"), (3, 2, "mit"), (6, 0, "gpl-3.0")]
    assert licenses.scan(hard.limit(0), model).count() == 0


# Pipeline


def test_pipeline_equals_brute_force(spark, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "exact dedup", "SimHash near-dedup", "packing"]
    pieces = corpus_pipeline.run(spark, SF).collect()
    left = {}
    for i, text in zip(documents.doc_id, documents.text):
        if not plain_counts(text)[-1]:  # at this size no line is frequent enough to be removed
            left.setdefault("".join(WORD.findall(text)), []).append((-len(text), i))
    texts = dict(zip(documents.doc_id, documents.text))
    unique = [min(group)[1] for group in left.values()]
    near = components_of({i: plain_fingerprint(texts[i]) for i in unique})
    want = {i for i in unique if near[i] == i}
    assert {p["doc_id"] for p in pieces} == want
    tokens = {}
    for p in pieces:
        tokens[p["doc_id"]] = tokens.get(p["doc_id"], 0) + p["length"]
    sizes = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert tokens == sizes


def test_pipeline_stages_on_hard_rows(spark):
    """Every stage takes nulls, blanks, repeated rows and no rows, and keeps the columns."""
    good = "these are enough different words for the rules to let this small document pass through"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, good, "en", None, 1),
            (4, good + " now", "en", "s", 2), (4, good + " now", "en", "s", 2),
            (5, "12 34 56 78 90 11 22 33 44 55 66", None, "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert sorted(out.columns) == sorted(docs.columns)
            out.collect()
        assert packing.pack(docs).where("start = 0").count() == docs.count()
