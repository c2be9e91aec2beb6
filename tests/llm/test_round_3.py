import zlib

from pyspark.sql import functions as F

from postwatch.llm import langid
from test_round_2 import speech


def test_language_learns_rows_beyond_any_sample(spark):
    """Rows of x past the first SAMPLE_ROWS hashes speak otherwise; texts like them are x too."""
    one, two, other = speech(1), speech(2), speech(3)
    rows = [(i, one(40), "x") for i in range(400)] + [(1000 + i, two(40), "x") for i in range(400)]
    rows += [(2000 + i, other(40), "y") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rank = {r["doc_id"]: r["h"] for r in df.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    first = sorted((rank[i], i) for i, _, x in rows if x == "x" and i < 1000 and i not in held)
    cut = first[langid.SAMPLE_ROWS - 1][0]
    late = {i for i, _, _ in rows if 1000 <= i < 2000 and (i in held or rank[i] > cut)}
    kept = [r for r in rows if r[0] < 1000 or r[0] >= 2000 or r[0] in late]
    asked = [r for r in kept if r[0] in held and 1000 <= r[0] < 2000]
    assert len(asked) > 20 and any(rank[i] > cut for i in late - held)
    train = spark.createDataFrame(kept, "doc_id long, text string, lang string")

    model = langid.count(train.where(~langid.held_out("doc_id")))
    found = {r["doc_id"]: r["lang_pred"] for r in langid.judge(train, model).collect()}
    assert all(found[i] == "x" for i, _, _ in asked)
    left = {r["doc_id"] for r in langid.keep_known(train).collect()}
    assert {i for i, _, _ in asked} <= left
