"""BPE encoding of long texts by tree concatenation, and decoding."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm.common import table, text_or_empty
from postwatch.llm.tokens import tokenizer, vocabulary_path, word_encoder

#: Code points of a text that one task encodes at once; longer texts are halved down to this.
LEAF = 32_768
#: Tokens on each side of a join that are encoded again first; doubled until both sides agree.
MARGIN = 8
#: Code points before an end of text in which its pieces may depend on what follows (an apostrophe
#: and two letters), with some to spare.
OPEN_END = 8
#: Texts whose results are held at a time.
SLICE = 256
LEAF_FIELDS = "uid long, doc_id long, leaf int, segment int, special int, text string"
CODED = "doc_id long, ids array<int>, decoded string"
CODE_FIELDS = LEAF_FIELDS + ", codes binary"


@dataclass
class Encoded:
    """A text and its tokens: ids, the code points they cover, and whether each one begins a
    piece of the splitting pattern.  The ids are those of the text standing alone; places count from
    `base` before the text."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    heads: np.ndarray
    base: int = 0

    def part(self, lo: int, hi: int) -> "Encoded":
        return Encoded(self.text, self.ids[lo:hi], self.starts[lo:hi], self.ends[lo:hi],
                       self.heads[lo:hi], self.base)

    def packed(self) -> bytes:
        """The tokens for a shuffle: places as steps, which compress well."""
        steps = np.diff(self.starts, prepend=0), self.ends - self.starts, self.heads
        return zlib.compress(np.concatenate([self.ids.astype("<i4"), *steps]).astype("<i4")
                             .tobytes(), 1)

    @staticmethod
    def unpacked(text: str, codes: bytes) -> "Encoded":
        ids, gaps, sizes, heads = np.frombuffer(zlib.decompress(codes), "<i4").reshape(4, -1)
        starts = np.cumsum(gaps, dtype="int64")
        return Encoded(text, ids.astype("<u4"), starts, starts + sizes, heads.astype(bool))

    def moved(self, by: int) -> "Encoded":
        return Encoded(self.text, self.ids, self.starts + by, self.ends + by, self.heads,
                       self.base + by)


def joined(text: str, *parts: Encoded) -> Encoded:
    return Encoded(text, *(np.concatenate([getattr(p, name) for p in parts])
                           for name in ("ids", "starts", "ends", "heads")))


class TreeEncoder:
    """Encodes text that the library's normalizer has already dealt with.  Special tokens are taken
    out before, as the library does, so a text is a list of segments; what is cut, compared and
    joined is normalized, so no place moves and any code point may be the first of a leaf."""

    def __init__(self, path: str):
        whole = tokenizer(path)
        self.normalize = whole.normalizer.normalize_str if whole.normalizer else str
        self.special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
        self.splits = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
            if self.special else "(?!)")
        self.bare = _without_specials(path)

    def segments(self, text: str) -> Iterator[tuple[int, str]]:
        """(id of a special token or -1, normalized text) in order."""
        for part in self.splits.split(text):
            if part in self.special:
                yield self.special[part], ""
            elif part:
                yield -1, self.normalize(part)

    def encode(self, text: str) -> Encoded:
        """Tokens of a normalized text standing alone."""
        got = self.bare.encode(text, add_special_tokens=False)
        spans = np.array(got.offsets, "int64").reshape(-1, 2)
        heads = np.diff(np.array(got.word_ids, "int64"), prepend=-1) != 0
        return Encoded(text, np.array(got.ids, "<u4"), spans[:, 0], spans[:, 1], heads)

    def leaves(self, text: str, leaf: int = LEAF) -> list[str]:
        """A normalized text halved until no part is longer than `leaf`."""
        if len(text) <= leaf:
            return [text]
        half = len(text) // 2
        return self.leaves(text[:half], leaf) + self.leaves(text[half:], leaf)

    def tree(self, parts: list[Encoded], margin: int = MARGIN) -> Encoded:
        """Neighbours are joined in rounds until one is left."""
        while len(parts) > 1:
            pairs = [self.join(*parts[i:i + 2], margin) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(pairs) * 2:]
        return parts[0]

    def join(self, left: Encoded, right: Encoded, margin: int = MARGIN) -> Encoded:
        """Encoding of left.text + right.text: a window around the join is encoded again and grows
        until its tokens agree with those of both sides.

        On the left it starts where a piece of the splitting pattern starts for certain, or within
        a run of letters or symbols with two tokens that are the left side's too.  On the right it
        ends with a token that the right side has too and after which both go on alike.  So every
        two neighbouring tokens stand as in an encoding of their own, and pieces as in a scan of
        the whole text, which only the encoding of the whole text does.
        """
        size, text = len(left.text), left.text + right.text
        while True:
            lo = self._left_edge(left, len(left.ids) - margin)
            start = int(left.starts[lo]) if lo > 0 else 0
            inside = lo > 0 and not left.heads[lo]
            ends = size + int(right.ends[margin - 1]) if margin < len(right.ids) else len(text)
            window = self.encode(text[start:ends]).moved(start)
            if not inside or _agree(window, 0, left, lo, 0) and _agree(window, 1, left, lo + 1, 0):
                if inside:
                    window.heads[0] = False
                cut = (len(window.ids), len(right.ids)) if ends == len(text) else \
                    self._meet(window, right, size, ends)
                if cut:
                    return joined(text, left.part(0, lo), window.part(0, cut[0]),
                                  right.part(cut[1], len(right.ids)).moved(size))
            margin *= 2

    def _left_edge(self, left: Encoded, at: int) -> int:
        """First token of the window: whole code points before it, and the start of a piece or
        within a run, which an apostrophe may not begin."""
        while at > 0:
            start = left.starts[at]
            if start <= len(left.text) - OPEN_END and start >= left.ends[at - 1] and (
                    left.heads[at] or left.text[start] != "'"
                    and left.text[left.starts[_head(left, at)]] != "'"):
                return at
            at -= 1
        return 0

    def _meet(self, window: Encoded, right: Encoded, size: int,
              ends: int) -> tuple[int, int] | None:
        """Numbers of window tokens and of right tokens before a place where both agree: the last
        two tokens before it are the same and stand within one run, or the last one is the same and
        a piece ends with it."""
        places = {int(e): j for j, e in enumerate(right.ends)
                  if e <= ends - size and j + 1 < len(right.ids)}
        for i in range(len(window.ids) - 2, -1, -1):
            j = places.get(int(window.ends[i]) - size)
            if j is None or not _agree(window, i, right, j, size) \
                    or window.starts[i + 1] < window.ends[i] or right.starts[j + 1] < right.ends[j]:
                continue
            if window.heads[i + 1] and right.heads[j + 1]:
                if window.starts[i + 1] == right.starts[j + 1] + size \
                        and window.ends[i] <= ends - OPEN_END:
                    return i + 1, j + 1
            elif not window.heads[i + 1] and not right.heads[j + 1] and i > 0 and j > 0 \
                    and _agree(window, i - 1, right, j - 1, size) \
                    and not window.heads[i] and not right.heads[j] \
                    and self._in_run(window, i) and self._in_run(right, j):
                return i + 1, j + 1
        return None

    def _in_run(self, tokens: Encoded, at: int) -> bool:
        """Whether the token stands in a run: no apostrophe begins its piece."""
        return tokens.text[tokens.starts[_head(tokens, at)] - tokens.base] != "'"


def _head(tokens: Encoded, at: int) -> int:
    found = np.flatnonzero(tokens.heads[:at + 1])
    return int(found[-1]) if len(found) else 0


def _agree(window: Encoded, i: int, side: Encoded, j: int, by: int) -> bool:
    return i < len(window.ids) and j < len(side.ids) and window.ids[i] == side.ids[j] \
        and window.starts[i] == side.starts[j] + by and window.ends[i] == side.ends[j] + by


@lru_cache(maxsize=4)
def _without_specials(path: str):
    """The same pieces and merges for normalized text without special tokens."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return Tokenizer.from_str(json.dumps(spec | {
        "normalizer": None, "added_tokens": [], "truncation": None, "padding": None}))


@lru_cache(maxsize=4)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


def _encode_short(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(path)
        for batch in batches:
            for at in range(0, len(batch), SLICE):  # so that no task holds a batch of results
                part = batch.iloc[at:at + SLICE]
                ids = [x.astype("int32") for x in encoder.encode_all(part["text"])]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "ids": ids,
                                    "decoded": decode(ids, path)})

    return run


def decode(ids: list[np.ndarray], path: str) -> list[str]:
    """Texts of ids, special tokens included, as the library decodes them."""
    one = tokenizer(path).decode
    return [one(x.tolist(), skip_special_tokens=False) for x in ids]


def _split(path: str, leaf: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tree_encoder(path)
        for batch in batches:
            for row in batch.itertuples(index=False):
                parts = [(number, special, part)
                         for number, (special, text) in enumerate(encoder.segments(row.text))
                         for part in encoder.leaves(text, leaf)]
                yield pd.DataFrame({
                    "uid": row.uid, "doc_id": pd.array([row.doc_id] * len(parts), "Int64"),
                    "leaf": range(len(parts)), "segment": [p[0] for p in parts],
                    "special": [p[1] for p in parts], "text": [p[2] for p in parts]})

    return split


def _encode_leaves(path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tree_encoder(path)
        for batch in batches:
            yield batch.assign(codes=[encoder.encode(t).packed() for t in batch["text"]])

    return encode


def join_segments(encoder: TreeEncoder, leaves: list[tuple[int, int, Encoded]],
                  margin: int = MARGIN) -> np.ndarray:
    """Ids of a text from (segment, special id or -1, encoded leaf) in order."""
    out = []
    for _, group in groupby(leaves, key=lambda x: x[0]):
        group = list(group)
        special = group[0][1]
        out.append(np.array([special], "<u4") if special >= 0
                   else encoder.tree([x[2] for x in group], margin).ids)
    return np.concatenate(out) if out else np.empty(0, "<u4")


def _join_leaves(path: str, margin: int):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("leaf")
        leaves = [(r.segment, r.special, Encoded.unpacked(r.text, r.codes))
                  for r in rows.itertuples()]
        ids = [join_segments(tree_encoder(path), leaves, margin).astype("int32")]
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1].astype("Int64").array, "ids": ids,
                             "decoded": decode(ids, path)})

    return join


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
           leaf: int = LEAF, margin: int = MARGIN) -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, decoded, as the tokenizers library encodes
    the whole text without special tokens added, and decodes those ids.

    A text of at most `leaf` code points is encoded where it is read.  A longer one is normalized
    and halved anywhere; its leaves are dealt over the cluster and encoded, and one task per text
    joins them pair by pair.  What a task holds is bounded by one text.

    A null text counts as empty (no ids), a null doc_id stays null, repeated rows are encoded each,
    other columns are ignored.  No rows give no rows.
    """
    path = vocabulary_path(path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       text_or_empty(text).alias("text"))
    short = rows.where(F.length("text") <= leaf).mapInPandas(_encode_short(path), CODED)
    long = (rows.where(F.length("text") > leaf)
            .select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
            .mapInPandas(_split(path, leaf), LEAF_FIELDS)
            .repartition("uid", "leaf").mapInPandas(_encode_leaves(path), CODE_FIELDS)
            .groupBy("uid")
            .applyInPandas(_join_leaves(path, margin), CODED))
    return short.unionByName(long)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents", "doc_id", "text"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
