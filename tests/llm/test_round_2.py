"""Whole results where the training-data operators once gave a part."""

import random

from postwatch.llm import exact, langid, licenses, lines, quality, simhash

from test_archives_chat_packing import SF


def removed(spark, docs):
    df = spark.createDataFrame([(i, text, "h") for i, text in enumerate(docs)],
                               "doc_id long, text string, source string")
    return {r["doc_id"]: r["removed_chars"] for r in quality.quality_rules(df).collect()}


def size(lines):
    return sum(len(x.replace(" ", "")) for x in lines)


# Quality


def test_quality_counts_documents_made_of_a_pool_of_lines(spark):
    random.seed(1)
    pool = [f"pool line {i} with some words of its own {i * i}" for i in range(60)]
    docs = [random.sample(pool, 8) for _ in range(5000)]
    got = removed(spark, ["\n".join(d) for d in docs])
    assert all(got[i] == size(d) for i, d in enumerate(docs))


def test_quality_counts_documents_under_navigation_lines(spark):
    for count in (10, 20):
        shared = [f"navigation {i} of the site" for i in range(count)]
        docs = ["\n".join([*shared, f"one line of document {i} alone"]) for i in range(1000)]
        got = removed(spark, docs)
        assert set(got.values()) == {size(shared)}


def test_quality_limit_is_of_different_documents(spark):
    """A line in exactly LINE_LIMIT documents stays, in one more it goes; whole copies count once."""
    line = "the very same line of words"
    docs = [f"{line}\nown line number {i}" for i in range(quality.LINE_LIMIT)]
    assert set(removed(spark, docs * 3).values()) == {0}
    assert set(removed(spark, [*docs, line]).values()) == {size([line])}


# Licences


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_license_notices_in_wrapped_lines(spark):
    marks = [("", ""), ("# ", "#"), (" * ", " *"), ("// ", "//")]
    rows, want = [], set()
    for i, (mark, blank) in enumerate(marks):
        for k, (text, family) in enumerate(((MIT, "mit"), (BSD, "bsd-3-clause"), (GPL, "gpl-3.0"))):
            lines = [mark + x for x in text.split("\n")]
            rows.append((10 * i + k, "\n".join(["Copyright by its owners", blank, *lines, blank,
                                                "import os", "Some other words of the file"])))
            want.add((10 * i + k, 2, family))
    rows.append((100, "\n".join([*GPL.split("\n"), "", "Released under the MIT License.",
                                 *BSD.split("\n"), "", "", *MIT.split("\n")])))
    want |= {(100, 0, "gpl-3.0"), (100, 5, "mit"), (100, 6, "bsd-3-clause"), (100, 11, "mit")}
    model = licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in found if r["confirmed"]} == want
    assert len(found) == len(want)


# Language


def speech(seed):
    """A maker of texts in an invented language of one alphabet and 300 words."""
    make = random.Random(seed)
    parts = ["".join(make.choices("bcdfghjklmnpqrstvwxz", k=make.choice((1, 2)))) + make.choice(
        "aeiouy") for _ in range(25)]
    vocabulary = ["".join(make.choices(parts, k=make.choice((1, 2, 3)))) for _ in range(300)]
    return lambda words: " ".join(make.choices(vocabulary, k=words))


def kept_ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"] for r in langid.keep_known(df).collect()}


def test_language_stage_does_not_depend_on_the_number_of_languages(spark):
    for count in (1, 2, 12):
        makers = [speech(i) for i in range(count)]
        rows = [(1000 * i + j, makers[i](150), f"l{i:02}") for i in range(count) for j in range(40)]
        noise = random.Random(5)
        bad = [(-1 - j, "".join(noise.choices("abcdefghijklmnopqrstuvwxyz ", k=900)), None)
               for j in range(20)]
        assert kept_ids(spark, rows + bad) == {r[0] for r in rows}


def test_language_samples_of_very_different_size(spark):
    """Languages of 1,000 and 5,000 symbols beside two of 30,000: each document goes to its own."""
    makers = {lang: speech(seed) for seed, lang in enumerate(("big", "large", "middle", "small"))}
    learnt = {"big": 8000, "large": 8000, "middle": 1000, "small": 200}
    train = spark.createDataFrame([(i, makers[x](n), x) for i, (x, n) in enumerate(learnt.items())],
                                  "doc_id long, text string, lang string")
    model = langid.fit(train)
    sizes = dict(zip(model.languages, model.length.tolist()))
    assert sizes["big"] == sizes["large"] == langid.SAMPLE_CHARS
    assert 3000 < sizes["middle"] < 8000 and 800 < sizes["small"] < 1500
    rows = [(100 * i + j, make(40), x) for i, (x, make) in enumerate(makers.items())
            for j in range(50)]
    tried = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(tried, model).collect()}
    wrong = [(x, found[i]) for i, _, x in rows if found[i] != x]
    assert len(wrong) <= 2, wrong


# Stages with null, repeated and shared ids


def words(seed):
    return " ".join(f"w{seed}x{j}" for j in range(30))


def test_stages_decide_row_by_row(spark):
    def run(stage, rows):
        df = spark.createDataFrame([(*r, "s") for r in rows],
                                   "doc_id long, text string, lang string, source string")
        out = stage(df.repartition(3))
        assert out.columns == df.columns
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    good, near = words(1), " ".join(words(k) for k in range(2, 9))
    rows = [(None, good, "x"), (None, "bad", "x"), (3, good, "x"), (3, "bad", "x")]
    assert run(quality.keep_good, rows) == [(3, good), (None, good)]
    rows = [(None, speech(1)(60), "x") for _ in range(40)] + [(None, "12 34", None), (5, "56", None)]
    assert len(run(langid.keep_known, rows)) == 40
    rows = [(None, good, "x")] * 3 + [(None, near, "x")] * 2 + [(4, good, "x")] * 2 + [
        (4, words(9), "x"), (2, words(9), "x")]
    assert run(exact.keep_one, rows) == [(2, words(9)), (4, good), (None, near)]
    rows = [(None, near, "x"), (None, near.upper(), "x"), (None, good, "x"), (7, good, "x"),
            (7, good, "x"), (7, words(9), "x"), (6, words(9), "x")]
    assert [r for r in run(simhash.keep_one, rows) if r[0]] == [(6, words(9)), (7, good)]
    assert len(run(simhash.keep_one, rows)) == 3


# Lines


def test_lines_of_several_documents_without_or_with_one_id(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    other = "a line of quite other words about ships, harbours and the weather at sea"
    own = lambda i: f"only {i * 7919} here stands {i * 104729} in line {i}"
    rows = [(None, "\n".join([own(1), own(2), own(3), base + "!"])), (None, other + "."),
            (None, base + "?"), (7, "\n".join([own(4), other + ","])), (7, own(5)),
            (1, base), (2, f"{own(6)}\n{other}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {
        ((r["doc_id"], r["line_no"]), (r["keep_doc_id"], r["keep_line_no"]), r["group_lines"])
        for r in lines.line_groups(docs).collect() if r["group_lines"] > 1}
    assert got == {((1, 0), (1, 0), 3), ((None, 0), (1, 0), 3), ((None, 3), (1, 0), 3),
                   ((2, 1), (2, 1), 3), ((7, 1), (2, 1), 3), ((None, 0), (2, 1), 3)}


def test_stages_keep_columns_of_any_name(spark):
    """Columns that are named like those of the operators stay as they are in every stage."""
    names = ["_row_number", "_known", "_word", "_bits", "_mask", "digest", "kept", "_part"]
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(i, f"{text} {i}", "en", "s", *[f"{n}{i}" for n in names]) for i in range(20)],
        "doc_id long, text string, lang string, source string, "
        + ", ".join(f"{n} string" for n in names))
    for keep in (quality.keep_good, langid.keep_known, exact.keep_one, simhash.keep_one):
        out = keep(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
