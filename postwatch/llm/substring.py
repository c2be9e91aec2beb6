"""Removal of word sequences that an earlier document holds, with a compacted De Bruijn graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwatch.llm.common import materialize, spread_join, table, text_or_empty
from postwatch.operators.membership import maybe_in, membership
from postwatch.session import discard

WINDOW = 50
#: Words of an anchor: of the anchors in a window the one of smallest hash stands for it, so equal
#: windows have equal anchors and one row stands for some 17 neighbouring windows.
ANCHOR = 16
#: Words whose windows are computed at a time, but for a longer text, and words a task remembers.
SLICE_WORDS = 200_000
CACHE_WORDS = 1_000_000
#: Requests for parts of one text that a task answers together.
REQUESTS = 4096
LARGEST_ID = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

RUNS = "doc long, key long, start int, n int, a long, u1 long, u2 long, p long, q long"
EDGES = "doc long, key long, start int, n int, u1 long, u2 long, p long, q long"
DIGESTS = "doc long, key long, start int, words int, digest binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes().__getitem__, words), "uint64", len(words))


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    steps = np.full(1 << bits, base, "uint64")
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: int, count: int) -> np.ndarray:
    return _powers(base, max(18, count.bit_length()))[:count]


class Rolling:
    """Hashes of any runs of a sequence of hashes, two of 64 bits, from prefix sums of a polynomial
    modulo 2^64 each."""

    def __init__(self, hashes: np.ndarray):
        self.sums, size = [], len(hashes)
        for base, values in zip(BASES, (hashes, mix(hashes))):
            total = np.zeros(size + 1, "uint64")
            np.cumsum(values * powers(base, size), out=total[1:])
            self.sums.append(total)

    def of(self, starts: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        total, inverse = self.sums[which], pow(BASES[which], -1, 1 << 64)
        found = (total[starts + length] - total[starts]) * powers(inverse, len(total))[starts]
        return mix(found + np.uint64(which)).view("int64")


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, in steps that double."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def anchored_runs(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW,
                  anchor: int = ANCHOR) -> tuple[np.ndarray, ...] | None:
    """Runs of windows that share an anchor: places, counts, anchors, two content hashes, and the
    hashes of the first and the last window - 1 words.  hashes: the words of several documents one
    after the other; owner: their document, and no window crosses two."""
    count = len(hashes) - window + 1
    if count < 1:
        return None
    roll = Rolling(hashes)
    anchors = roll.of(np.arange(len(hashes) - anchor + 1), anchor)
    least = sliding_min(anchors, window - anchor + 1)
    whole = owner[window - 1:] == owner[:count]
    breaks = (least[1:] != least[:-1]) | (owner[1:count] != owner[:count - 1]) \
        | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(np.r_[True, breaks])
    n = np.diff(np.r_[starts, count])
    starts, n = starts[whole[starts]], n[whole[starts]]
    return (starts, n, least[starts], roll.of(starts, n + window - 1),
            roll.of(starts, n + window - 1, 1), roll.of(starts, window - 1),
            roll.of(starts + n, window - 1))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(rows, words) of some SLICE_WORDS words at a time: rows of the batch with their words."""
    for batch in batches:
        texts = batch.column("text")
        rows, words, size = [], [], 0
        for i in range(len(batch)):
            words.append(texts[i].as_buffer().to_pybytes().split())
            rows.append(i)
            size += len(words[-1])
            if size > SLICE_WORDS:
                yield batch, rows, words
                rows, words, size = [], [], 0
        if rows:
            yield batch, rows, words


def _owned(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    hashes = np.concatenate([word_hashes(w) for w in words]) if len(words) else np.empty(0)
    return hashes, owner, np.cumsum(sizes) - sizes


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _run_rows(window: int, anchor: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, words in _slices(batches):
            hashes, owner, begin = _owned(words)
            got = anchored_runs(hashes, owner, window, anchor)
            if got is None or not len(got[0]):
                continue
            starts, of = got[0], owner[got[0]]
            docs, keys = _longs(batch, "doc")[rows][of], _longs(batch, "key")[rows][of]
            yield _arrow([docs, keys, (starts - begin[of]).astype("int32"),
                          got[1].astype("int32"), *got[2:]], RUNS)

    return runs


def _arrow(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns],
                                      [c.split()[0] for c in schema.split(", ")])


def _window_rows(window: int):
    """One row for each window of the runs that are asked for."""
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, words in _slices(batches):
            for i, own in zip(rows, words):
                roll = Rolling(word_hashes(own))
                at = np.concatenate([np.arange(r["start"], r["start"] + r["n"])
                                     for r in batch.column("asked")[i].as_py()])
                fill = np.full(len(at), 1)
                yield _arrow([fill * batch.column("doc")[i].as_py(),
                              fill * batch.column("key")[i].as_py(),
                              at.astype("int32"), fill.astype("int32"),
                              roll.of(at, window), roll.of(at, window, 1),
                              roll.of(at, window - 1), roll.of(at + 1, window - 1)], EDGES)

    return edges


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each part of a text that is asked for."""
    for batch, rows, words in _slices(batches):
        for i, own in zip(rows, words):
            asked = batch.column("asked")[i].as_py()
            fill = np.full(len(asked), 1)
            yield _arrow([fill * batch.column("doc")[i].as_py(),
                          fill * batch.column("key")[i].as_py(),
                          np.array([r["start"] for r in asked], "int32"),
                          np.array([r["n"] for r in asked], "int32"),
                          [hashlib.sha256(b" ".join(own[r["start"]:r["start"] + r["n"]])).digest()
                           for r in asked]], DIGESTS)


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digest of each text without the spans of words that are to go."""
    for batch, rows, words in _slices(batches):
        removed, shas = [], []
        for i, own in zip(rows, words):
            keep = np.ones(len(own), bool)
            for span in batch.column("asked")[i].as_py() or ():
                keep[span["start"]:span["start"] + span["n"]] = False
            removed.append(int(len(own) - keep.sum()))
            left = own if not removed[-1] else [w for w, k in zip(own, keep) if k]
            shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield _arrow([batch.column("doc_id").take(pa.array(rows)),
                      np.array([len(w) for w in words], "int64"),
                      np.array(removed, "int64"), shas], RESULT)


class Graph:
    """Jobs over one table of texts (doc_id, doc, key, text), where (doc, key) names a document: its
    id, null as the largest, and a hash of id and text."""

    def __init__(self, rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR):
        self.rows, self.window, self.anchor = rows, window, anchor

    def asked(self, requests: DataFrame, how: str = "inner") -> DataFrame:
        """Texts with the list of (start, n) that requests (doc, key, start, n; a written table)
        have for them.  Only texts that may be asked for are shuffled; a text of very many
        requests is answered in parts."""
        sizes = requests.groupBy("doc", "key").agg(
            F.ceil(F.count("*") / REQUESTS).cast("int").alias("_parts"))
        lists = spread_join(requests, sizes, ["doc", "key"], ["start", "n"]).groupBy(
            "doc", "key", F.expr("pmod(xxhash64(start, n), _parts)")).agg(
            F.collect_list(F.struct("start", "n")).alias("asked"))
        wanted = maybe_in(self.rows, ["doc", "key"],
                          materialize(membership(requests, ["doc", "key"]), "substring-filter"))
        return wanted.join(lists, ["doc", "key"], how)

    def runs(self) -> DataFrame:
        """Runs of windows whose anchor stands in at least two documents, as written rows."""
        every = materialize(self.rows.select("doc", "key", "text").mapInArrow(
            _run_rows(self.window, self.anchor), RUNS), "substring-runs")
        shared = materialize(every.groupBy("a").agg(F.min("doc").alias("lo"),
                                                    F.max("doc").alias("hi"))
                             .where("lo < hi").select("a"), "substring-anchors")
        found = materialize(membership(shared, ["a"]), "substring-filter")
        kept = materialize(spread_join(maybe_in(every, ["a"], found), shared, ["a"],
                                       ["doc", "key", "start"], "left_semi"), "substring-shared")
        discard(every)
        return kept

    def edges(self) -> DataFrame:
        """The repeated edges where they stand: runs of windows that are the same as a whole, and
        single windows where runs of one anchor differ.  kind, doc, key, start, n, u1, u2 (content),
        p, q (nodes: the first and last window - 1 words), first (smallest document with them)."""
        runs, unit = self.runs(), ["a", "u1", "u2", "n"]
        same = materialize(runs.groupBy(*unit).agg(F.min("doc").alias("first"),
                                                   F.max("doc").alias("last")), "substring-same")
        several = same.groupBy("a").agg((F.count("*") > 1).alias("several"))
        judged = spread_join(same, several, ["a"], ["u1", "u2", "n"])
        placed = materialize(spread_join(runs, judged, unit, ["doc", "key", "start"]),
                             "substring-placed")
        # A run that a smaller document has whole goes whole.  Where a run stands first, its
        # windows may still stand in another run of its anchor.
        asked = materialize(placed.where("several AND doc = first").select(
            "doc", "key", "start", "n"), "substring-asked")
        windows = materialize(self.asked(asked).select("doc", "key", "text", "asked").mapInArrow(
            _window_rows(self.window), EDGES), "substring-windows")
        firsts = windows.groupBy("u1", "u2").agg(
            F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
        single = spread_join(windows, firsts, ["u1", "u2"], ["doc", "key", "start"])
        columns = ["doc", "key", "start", "n", "u1", "u2", "p", "q", "first"]
        return materialize(
            placed.where("first < last").select(F.lit(0).alias("kind"), *columns).unionByName(
                single.select(F.lit(1).alias("kind"), *columns)), "substring-edges")

    def spans(self) -> DataFrame:
        """doc, key, start, words of each repeated span, and src, src_key, src_start of the same
        words in the smallest document that has them.

        Edges whose node has one edge before it and one behind it, side by side in that document,
        are one path; a document's edges along one path are one span.  A row of windows in a
        document is held by one task, never those of a word sequence.
        """
        edges, unit = self.edges(), ["kind", "u1", "u2", "n"]
        source = edges.where("doc = first").groupBy(*unit, "p", "q", "first").agg(
            F.min(F.struct("key", "start")).alias("at"))
        source = materialize(source.select(
            *unit, "p", "q", F.col("first").alias("src"), F.col("at.key").alias("src_key"),
            F.col("at.start").alias("src_start")), "substring-source")
        into = source.groupBy("kind", F.col("q").alias("p")).agg(F.count("*").alias("ins"))
        out = source.groupBy("kind", "p").agg(F.count("*").alias("outs"))
        plain = into.join(out, ["kind", "p"]).where("ins = 1 AND outs = 1").select(
            "kind", "p", F.lit(True).alias("plain"))
        along = Window.partitionBy("kind", "src", "src_key").orderBy("src_start")
        goes_on = F.coalesce("plain", F.lit(False)) & (F.lag("q").over(along) == F.col("p")) & (
            F.lag(F.col("src_start") + F.col("n")).over(along) == F.col("src_start"))
        paths = spread_join(source, plain, ["kind", "p"], ["u1", "u2"], "left").withColumn(
            "_new", F.coalesce((~goes_on).cast("int"), F.lit(1))).withColumn(
            "path", F.sum("_new").over(along))
        paths = materialize(paths.select(*unit, "src", "src_key", "src_start", "path"),
                            "substring-paths")
        later = materialize(edges.where("doc > first"), "substring-later")
        found = spread_join(later, paths, unit, ["doc", "key", "start"])
        run = Window.partitionBy("doc", "key").orderBy("kind", "start")
        same = [F.lag(c).over(run).eqNullSafe(F.col(c))
                for c in ("kind", "src", "src_key", "path", "_line")]
        same.append(F.lag(F.col("start") + F.col("n")).over(run) == F.col("start"))
        starts = F.lit(True)
        for one in same:
            starts = starts & F.coalesce(one, F.lit(False))
        spans = (found.withColumn("_line", F.col("start") - F.col("src_start"))
                 .withColumn("_new", (~starts).cast("int"))
                 .withColumn("_span", F.sum("_new").over(run))
                 .groupBy("doc", "key", "_span", "src", "src_key").agg(
                     F.min("start").alias("start"), F.min("src_start").alias("src_start"),
                     (F.sum("n") + self.window - 1).cast("int").alias("words")))
        return materialize(spans.drop("_span"), "substring-spans")

    def verified(self, spans: DataFrame) -> DataFrame:
        """Spans whose words are the same in the document and in their source."""
        sources = spans.select(F.col("src").alias("doc"), F.col("src_key").alias("key"),
                               F.col("src_start").alias("start"), F.col("words").alias("n"))
        asked = spans.select("doc", "key", "start", F.col("words").alias("n")).unionByName(sources)
        asked = materialize(asked.distinct(), "substring-asked")
        digests = materialize(self.asked(asked).select("doc", "key", "text", "asked").mapInArrow(
            _digest_rows, DIGESTS).distinct(), "substring-digests")
        own = spans.join(digests, ["doc", "key", "start", "words"])
        theirs = digests.select(F.col("doc").alias("src"), F.col("key").alias("src_key"),
                                F.col("start").alias("src_start"), "words",
                                F.col("digest").alias("_same"))
        return materialize(
            spread_join(materialize(own, "substring-own"), theirs,
                        ["src", "src_key", "src_start", "words"], ["doc", "key", "start"])
            .where("digest = _same").select(
                "doc", "key", "start", F.col("words").alias("n"), "src", "src_key", "src_start"),
            "substring-verified")

    def kept(self, spans: DataFrame) -> DataFrame:
        """Every text without its verified spans; only texts that may have some are shuffled."""
        spans = spans.select("doc", "key", "start", "n")
        lists = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "n"))
                                                .alias("asked"))
        found = materialize(membership(spans, ["doc", "key"]), "substring-filter")
        some = maybe_in(self.rows, ["doc", "key"], found).join(lists, ["doc", "key"], "left")
        none = maybe_in(self.rows, ["doc", "key"], found, inside=False).withColumn(
            "asked", F.lit(None).cast("array<struct<start:int,n:int>>"))
        columns = ["doc_id", "text", "asked"]
        return some.select(columns).unionByName(none.select(columns)).mapInArrow(
            _kept_rows, RESULT)


def graph(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
          anchor: int = ANCHOR) -> Graph:
    number = F.col(doc_id).cast("long")
    rows = docs.select(number.alias("doc_id"),
                       F.coalesce(number, F.lit(LARGEST_ID)).alias("doc"),
                       F.xxhash64(number, text_or_empty(text)).alias("key"),
                       text_or_empty(text).alias("text"))
    return Graph(rows, window, min(anchor, window))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Spans of at least `window` words that a document with a smaller doc_id has too, verified:
    doc, key, start, n (words), and src, src_key, src_start of an earliest copy."""
    found = graph(docs, doc_id, text, window, anchor)
    return found.verified(found.spans())


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed and kept_sha256, the digest of the words
    that stay.  A word goes when it lies in `window` consecutive words that also stand in a document
    with a smaller doc_id; windows are judged on the input.

    Windows are edges between their first and last window - 1 words.  Neighbouring windows with one
    anchor are one row; rows whose anchor stands in a single document are left out, and only rows
    that differ under one anchor are taken apart into windows.  What repeats is compacted to paths,
    documents become spans of paths, and each span is compared with the words of its source.

    A null or blank text has no words.  A null doc_id is larger than any other, rows of one doc_id
    do not remove each other's words, other columns are ignored, no rows give no rows.  Windows are
    compared by 128 bits of hashes; a span that then differs from its source is not removed.
    """
    found = graph(docs, doc_id, text, window, anchor)
    return found.kept(found.verified(found.spans()))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda w: w <> '') AS ws
  FROM documents),
windows AS (
  SELECT doc_id, i, hash(array_to_string(ws[i:i + 49], ' ')) AS a,
         hash('x' || array_to_string(ws[i:i + 49], ' ')) AS b
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM texts)),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY a, b) < doc_id AS gone FROM windows),
removed AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM judged WHERE gone),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM texts),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS t
  FROM words ANTI JOIN removed USING (doc_id, k) GROUP BY 1)
SELECT t.doc_id, len(t.ws)::BIGINT AS n_words, (len(t.ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id)
"""
