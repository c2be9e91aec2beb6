"""WARC, chat formatting, packing and BPE against round trips, SQL and the library itself."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwatch.llm import bpe, chat, packing, tokens, warc

SF = "/root/testdata/sf0.001"


def oracle(name, sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return sorted((repr(sorted(zip(columns, r))) for r in got.fetchall()))


def rows_of(df):
    return sorted(repr(sorted(zip(df.columns, r))) for r in df.collect())


# WARC


def test_warc_query_equals_sql(spark):
    assert rows_of(warc.op1_warc(spark, SF)) == oracle("pages", warc.OP1_SQL)


def test_warc_revisits_nulls_and_repeats(spark, tmp_path):
    same, null = "x" * 2000, None
    pages = spark.createDataFrame(
        [(1, "u", same, 1), (2, "a\r\nWARC-Type: x", same, 2), (3, "u", same, 3),
         (3, "u", same, 3), (null, null, same, 4), (4, "u", "y", 5), (5, "u", "y", 6),
         (6, "u", null, 7), (7, "u", "é\r\n\r\n" * 400, 8)],
        "page_id long, url string, html string, payload int")
    archives = warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=500)
    assert archives.agg(F.sum("records")).first()[0] == 9
    got = warc.read_archives(archives).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"])
                   for r in got)
    assert kinds == [(0, "revisit", 3, 2000), (1, "revisit", 3, 2000), (2, "revisit", 3, 2000),
                     (3, "response", None, 2000), (3, "response", None, 2000),
                     (4, "response", None, 1), (5, "response", None, 1),
                     (6, "response", None, 0), (7, "response", None, 2400)]
    assert all(r["verified"] for r in got)
    for r in got:
        if r["payload"] is not None:
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"]


def test_warc_no_rows(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.read_archives(archives).count() == 0


def test_warc_reader_frames_members_and_finds_damage():
    data = b"".join(warc.record(i, f"u{i}", bytes([i]) * 3000, None) for i in range(1, 5))
    data += warc.record(9, "u", b"z" * 10, 4)
    read = list(warc.read_records(io.BytesIO(data)))
    assert [r.headers["warc-type"] for r in read] == ["response"] * 4 + ["revisit"]
    assert read[2].http[1] == bytes([3]) * 3000 and read[4].http[1] == b""
    for size in (1, 7, 1 << 20):
        assert len(list(warc.members(io.BytesIO(data), size))) == 5
    with pytest.raises(warc.ArchiveError):
        list(warc.read_records(io.BytesIO(data[:-5])))
    broken = zlib.decompress(warc.record(1, "u", b"abc", None), 31).replace(b"abc", b"abd")
    pack = zlib.compressobj(wbits=31)
    assert not next(warc.read_records(
        io.BytesIO(pack.compress(broken) + pack.flush()))).verified
    pack = zlib.compressobj(wbits=31)
    with pytest.raises(warc.ArchiveError):
        next(warc.read_records(io.BytesIO(pack.compress(broken[:-1]) + pack.flush())))


# Chat


def test_chat_query_equals_sql(spark):
    assert rows_of(chat.op6_chat_format(spark, SF)) == oracle("conversations", chat.OP6_SQL)


def test_chat_examples_read_back(spark):
    rows = [(1, 1, "user", "a<|b%3C|%\n", 0), (1, 2, "assistant", "<|im_start|>x", 0),
            (1, 2, "assistant", None, 0), (1, None, None, "%25<", 0), (1, 3, "user", "|", 0),
            (2, 1, "as%0A\nx", "|im_end|>", 0), (2, 2, "user", "<", 0),
            (None, 1, "assistant", "z", 0)]
    turns = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, formatted int")
    got = chat.format_chat(turns).select(
        "conv_id", "example", "target_turn", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    found = {(r["conv_id"], r["example"]): r for r in got.collect()}
    assert len(found) == 5
    first, second, tail = (found[1, i] for i in range(3))
    assert [(t["role"], t["text"]) for t in tail["turns"]] == [
        ("", "%25<"), ("user", "a<|b%3C|%\n"), ("assistant", ""),
        ("assistant", "<|im_start|>x"), ("user", "|")]
    assert (first["loss"], second["loss"], tail["loss"]) == ("", "<|im_start|>x", "")
    assert tail["target_turn"] is None and second["target_turn"] == 2
    assert [(t["role"], t["text"]) for t in found[2, 0]["turns"]] == [
        ("as%0A\nx", "|im_end|>"), ("user", "<")]
    assert found[None, 0]["loss"] == "z"
    assert chat.format_chat(turns.limit(0)).count() == 0


# Packing


def coded(text):
    ids = tokens.tokenizer(tokens.vocabulary_path()).encode(
        text or "", add_special_tokens=False).ids
    return np.array([*ids, packing.END_ID], "<u4")


def checked(pieces, docs, window=packing.WINDOW):
    """Each id of each document lies in one piece, sequences have no gaps."""
    left = {}
    for p in pieces:
        left.setdefault(p["doc_id"], []).append(p)
    for doc_id, text in docs:
        ids, at = coded(text), 0
        for p in sorted(left.pop(doc_id), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert zlib.crc32(ids[p["start"]:at].tobytes()) == p["ids_crc32"]
        assert at == len(ids)
    assert not left
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and {p["sequence_tokens"] for p in held} == {at}
    return sequences


def test_packing_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet")
            .select("doc_id", "text").collect()]
    pieces = packing.op2_packing(spark, SF).collect()
    sequences = checked(pieces, docs)
    stored = sum(held[0]["padded_tokens"] for held in sequences.values())
    assert stored <= 1.01 * sum(p["length"] for p in pieces)


def test_packing_nulls_empty_and_long(spark):
    docs = [(1, None), (2, ""), (3, "word " * 9000), (None, "a b"), (5, "\n\t")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, start int")
    sequences = checked(packing.pack(df.coalesce(1)).collect(), docs)
    assert sum(len(s) for s in sequences.values()) >= 5
    assert packing.pack(df.limit(0)).count() == 0


def test_sum_of_squares_takes_the_least_sum():
    random.seed(1)
    packer, level = packing.SumOfSquares(window=12, max_open=1000), {}
    for _ in range(300):
        size = random.randint(1, 12)
        before = {h: int(n) for h, n in enumerate(packer.counts) if n}
        best = packer.level_for(size)

        def total(h):
            after = dict(before)
            if h:
                after[h] -= 1
            if h + size < 12:
                after[h + size] = after.get(h + size, 0) + 1
            return sum(n * n for n in after.values())

        options = [h for h in (0, *before) if h + size <= 12]
        assert total(best) == min(map(total, options))
        list(packer.add((0, 0, np.zeros(size, "<u4"), size)))
        level[size] = level.get(size, 0) + 1
    held = [w for w in packer.close()]
    assert all(packing.padded(sum(len(p[2]) for p in w), 12) in (12, 8, 4, 2, 1) for w in held)


def test_packing_fills_up_when_many_windows_are_open():
    packer, out = packing.SumOfSquares(window=100, max_open=5), []
    for i in range(200):
        out += packer.add((i, 0, np.arange(51 + i % 7, dtype="<u4"), 60))
        assert packer.open <= 6
    out += packer.close()
    assert sum(len(p[2]) for w in out for p in w) == sum(51 + i % 7 for i in range(200))
    assert max(sum(len(p[2]) for p in w) for w in out) == 100


# BPE


def test_bpe_query_equals_library(spark):
    library = tokens.tokenizer(tokens.vocabulary_path())
    got = {r["doc_id"]: r for r in bpe.op10_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(
            " ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_leaves_over_the_cluster(spark):
    library = tokens.tokenizer(tokens.vocabulary_path())
    texts = [None, "", "  ", "ab" * 700, "It's <|endoftext|> " * 40, "漢字" * 300, "x"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, leaf=100, margin=2).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids
                   for i, t in enumerate(texts)}
    assert bpe.encode(docs.limit(0)).count() == 0


def tree_ids(encoder, text, leaf, margin):
    leaves = [(number, special, encoder.encode(part))
              for number, (special, normal) in enumerate(encoder.segments(text))
              for part in encoder.leaves(normal, leaf)]
    return bpe.join_segments(encoder, leaves, margin).tolist()


@pytest.mark.parametrize("symbols", [
    ["İ", "a", "b", "̇", "̸", "İa"], ["ᄀ", "ᅡ", "ᆨ", "x", "C", "#"], list("s'treldvm "),
    ["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "a", "'"], list("0١½²a'!"), list("漢字éがぎ"),
    list("abcthreinAZ'!.,<|>=~-19 éÉüß漢̸́") + ["<|endoftext|>", "'s", "'ll", "ing"],
    list("abcdethinerou") + ["ing", "the"], list("!'.-s"), ["é", "a"], ["a"]])
def test_bpe_tree_equals_library(symbols):
    random.seed(5)
    encoder = bpe.TreeEncoder(tokens.vocabulary_path())
    library = tokens.tokenizer(tokens.vocabulary_path())
    for _ in range(150):
        text = "".join(random.choices(symbols, k=random.randint(1, 300)))
        assert tree_ids(encoder, text, random.choice([9, 20, 60]), random.choice([1, 2, 8])) == \
            library.encode(text, add_special_tokens=False).ids


def test_word_encoder_equals_library():
    random.seed(7)
    symbols = list("abzAZ'!.,<|>=~-19 éÉüß÷×ñŁ…漢́ẞ \x1c") + [
        "<|endoftext|>", "'s", "'ll", "</w>"]
    texts = ["".join(random.choices(symbols, k=random.randint(1, 14))) for _ in range(20000)]
    path = tokens.vocabulary_path()
    for text, ids in zip(texts, tokens.word_encoder(path).encode_all(texts)):
        assert ids.tolist() == tokens.tokenizer(path).encode(text, add_special_tokens=False).ids
