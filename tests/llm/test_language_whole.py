"""Language model: whole texts are cross-parsed by automata of every training row's parts."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from postwatch.llm import langid


def plain_known(texts, places):
    """Parts of up to ORDER bytes that make one of `places` of the training bytes."""
    found = Counter(t[i:i + k] for t in texts for i in range(len(t))
                    for k in range(1, langid.ORDER + 1) if i + k <= len(t))
    return {p for p, n in found.items() if n * places >= sum(map(len, texts))}


def plain_phrases(text, known):
    count = i = 0
    while i < len(text):
        size = 1
        while i + size < len(text) and text[i:i + size + 1] in known and text[i:i + size] in known:
            size += 1
        i, count = i + size, count + 1
    return count


def speech(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghéß漢", k=draw.randint(1, 7))) for _ in range(60)]
    return lambda n: " ".join(draw.choices(words, k=n))


@pytest.mark.parametrize("places", [100, 1 << 15])
def test_language_query_cross_parses_by_every_row(spark, monkeypatch, places):
    """Phrases, bits and the language equal a search in all training rows; a text is parsed whole,
    also alone and when it is much longer than the others."""
    monkeypatch.setattr(langid, "PLACES", places)
    one, two = speech(1), speech(2)
    rows = [(i, one(30), "x") for i in range(150)] + [(500 + i, two(20), "y") for i in range(90)]
    rows += [(900, one(4) + " " + two(4), None), (901, two(3000), None), (902, "Zz. 12 é!", None),
             (903, None, "x"), (904, "12 ?", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.count(docs)
    spelt = {i: langid.spelled(langid.points(t)) for i, t, _ in rows if t and i != 904}
    own = {x: [spelt[i] for i, _, lang in rows if lang == x and i in spelt] for x in "xy"}
    known = {x: plain_known(own[x], places) for x in "xy"}
    assert model.languages == ["x", "y"] and spelt[902] == " zz é ".encode()

    coded = [model.codes[np.frombuffer(t, "uint8")] for t in spelt.values()]
    want = [[plain_phrases(t, known[x]) for x in "xy"] for t in spelt.values()]
    assert model.phrases(coded).tolist() == want
    assert [model.phrases([t]).tolist()[0] for t in coded[-20:]] == want[-20:]

    letters = {c for x in "xy" for p in known[x] for c in p}
    cost = [np.log2(min(sum(map(len, own[x])), places) + len(letters)) for x in "xy"]
    got = {r["doc_id"]: r for r in langid.judge(docs, model).collect()}
    for (i, t), n in zip(spelt.items(), want):
        bits = []
        for k, x in enumerate("xy"):
            strange = sum(bytes([c]) not in known[x] for c in t)
            bits.append(((n[k] - strange) * cost[k] + strange * max(cost)) / got[i]["symbols"])
        assert got[i]["lang_pred"] == "xy"[int(np.argmin(bits))]
        assert got[i]["bits"] == pytest.approx(min(bits))
    assert [got[i]["lang_pred"] for i in (903, 904)] == ["und", "und"]


def test_parts_are_counted_over_slices(monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 7)
    texts = [b" ab abab ", b" b ", b" abcabcabcabc "]
    got = Counter()
    for size, parts, n in langid.parts_of(texts, (1, 2, 8), None):
        for p, k in zip(parts.tolist(), n.tolist()):
            got[p.to_bytes(8, "big")[:size]] += k
    assert got == Counter(t[i:i + k] for t in texts for k in (1, 2, 8)
                          for i in range(len(t) - k + 1))


def test_automaton_joins_states(spark):
    """States with the same continuations are one, so there are fewer states than known parts."""
    known = plain_known([b" abcab bcabca "], 1 << 15)
    by_size = [np.sort(np.array([int.from_bytes(p.ljust(8, b"\0"), "big") for p in known
                                 if len(p) == k], "uint64")) for k in range(1, 9)]
    codes = np.full(256, 4, "int16")
    codes[list(b" abc")] = range(4)
    table = langid.automaton(by_size, codes, 5)
    assert len(table) < len(known)


def test_pipeline_stage_keeps_by_cross_parsing(spark):
    """The language stage keeps the rows whose bits, by phrases of whole texts, are within the bound
    between all held-out rows of the language and the same rows shuffled."""
    one, two, junk = speech(5), speech(6), random.Random(7)
    rows = [(i, one(30 + i % 50), "x") for i in range(120)]
    rows += [(200 + i, two(30 + i % 50), "y") for i in range(120)]
    rows += [(400 + i, "".join(junk.choices("abcdefgh iß", k=300)), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    model = langid.count(docs.where(~langid.held_out("doc_id")))
    bound = {}
    for k, x in enumerate("xy"):
        own = [t for i, t, lang in rows if lang == x and i in held]
        mixed = [np.random.default_rng(zlib.crc32(t.encode())).permutation(langid.points(t))
                 for t in own]
        bound[x] = np.mean([np.median(model.bits(some)[:, k])
                            for some in ([langid.points(t) for t in own], mixed)])
    want = set()
    for i, t, _ in rows:
        bits = model.bits([langid.points(t)])[0]
        if bits.min() <= bound["xy"[int(bits.argmin())]]:
            want.add(i)
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == want and len([i for i in got if i < 400]) > 230
    assert not [i for i in got if i >= 400]
