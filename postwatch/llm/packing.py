"""Sum-of-squares online packing of documents into token windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm.common import table
from postwatch.llm.tokens import vocabulary_path, word_encoder

WINDOW = 4096
END_ID = 2
#: Partly filled windows a task holds before it fills them up with cut pieces.
MAX_OPEN = 2048
COLUMNS = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, sequence_tokens long, padded_tokens long")

#: doc_id, first id's place in the document, ids, ids of the document
Piece = tuple[int | None, int, np.ndarray, int]


def padded(tokens: int, window: int = WINDOW) -> int:
    """Length of a sequence in storage: a power of two stays, all else is padded to the window."""
    return tokens if tokens & (tokens - 1) == 0 else window


class SumOfSquares:
    """Online packing (Csirik et al., J. ACM 2006): a piece goes to the fill level, or into a new
    window, for which the sum of the squared numbers of windows per level is least.  `counts` is
    the level array; an empty and a full window do not count."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open, self.open = window, max_open, 0
        self.counts = np.zeros(window + 1, "int64")
        self.levels: dict[int, list[list[Piece]]] = {}

    def level_for(self, size: int) -> int:
        counts, top = self.counts, self.window - size
        cost = 2 * (counts[size:] - counts[:top + 1]) + 2
        cost[top] -= 1  # a full window leaves the sum
        cost[0] = 0 if top == 0 else 2 * counts[size] + 1
        cost[1:][counts[1:top + 1] == 0] = np.iinfo("int64").max
        return top - int(np.argmin(cost[::-1]))  # of equal levels the fullest

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece of at most a window; windows that are complete come out."""
        size = len(piece[2])
        level = self.level_for(size)
        held = self._take(level) if level else []
        held.append(piece)
        if level + size == self.window:
            yield held
        else:
            self._put(level + size, held)
        if self.open > self.max_open:
            yield from self._fill()

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def _put(self, level: int, held: list[Piece]) -> None:
        self.counts[level] += 1
        self.open += 1
        self.levels.setdefault(level, []).append(held)

    def _fill(self) -> Iterator[list[Piece]]:
        """Fill the fullest windows with pieces of the emptiest, cutting the last one of each;
        one window at most stays open."""
        rest = [(level, held) for level in sorted(self.levels) for held in self.levels[level]]
        pieces = [p for _, held in rest for p in held][::-1]  # taken from the end: emptiest first
        self.levels.clear()
        self.counts[:] = 0
        self.open = 0
        total = sum(len(p[2]) for p in pieces)
        for _ in range(total // self.window):
            level, held = rest.pop()
            del pieces[:len(held)]
            while level < self.window:
                piece = pieces.pop()
                first, second = cut(piece, self.window - level)
                held = [*held, first]
                level += len(first[2])
                if second:
                    pieces.append(second)
            yield held
        if pieces:
            self._put(total % self.window, pieces[::-1])

    def close(self) -> Iterator[list[Piece]]:
        """All that is left; the last window comes out in powers of two, which need no padding."""
        yield from self._fill()
        for level, windows in self.levels.items():
            pieces = [p for held in windows for p in held][::-1]
            for bit in range(level.bit_length() - 1, -1, -1):
                room = level & (1 << bit)
                held = []
                while room:
                    first, second = cut(pieces.pop(), room)
                    held.append(first)
                    room -= len(first[2])
                    if second:
                        pieces.append(second)
                if held:
                    yield held


def cut(piece: Piece, room: int) -> tuple[Piece, Piece | None]:
    doc_id, start, ids, total = piece
    if len(ids) <= room:
        return piece, None
    return (doc_id, start, ids[:room], total), (doc_id, start + room, ids[room:], total)


def _packer(path: str, window: int, max_open: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = word_encoder(path), SumOfSquares(window, max_open)
        number = (TaskContext.get().partitionId() << 33) - 1

        def rows(held: list[Piece]) -> Iterator[tuple]:
            nonlocal number
            number += 1
            tokens, offset = sum(len(p[2]) for p in held), 0
            for doc_id, start, ids, total in held:
                yield (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total,
                       number, offset, tokens, padded(tokens, window))
                offset += len(ids)

        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"], encoder.encode_all(batch["text"])):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                ids = np.append(ids, np.uint32(END_ID))
                for start in range(0, len(ids), window):
                    piece = (doc_id, start, ids[start:start + window].copy(), len(ids))
                    for held in packer.add(piece):
                        out.extend(rows(held))
            yield _frame(out)
        yield _frame([row for held in packer.close() for row in rows(held)])

    return pack


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({n: "Int64" for n in names})


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
         window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece of a document in a sequence of at most `window` tokens.

    A document is its ids and the end id.  Whole windows of a long document are sequences of their
    own, the rest is placed by sum of squares within the task that reads the document; what is
    still open at the task's end is filled up with cut pieces.  Each id lies in one piece.  Nothing
    is shuffled; sequence_id holds the task's partition.

    A null text counts as empty: the end id alone.  A null doc_id stays null, repeated rows are
    documents of their own, other columns are ignored.  No rows give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(_packer(vocabulary_path(path), window, max_open), COLUMNS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
