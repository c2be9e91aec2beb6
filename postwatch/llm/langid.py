"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwatch.llm.common import fresh, materialize, table

#: Bounds of the training sample: rows per language, and symbols of the text learnt per language.
SAMPLE_ROWS = 200
SAMPLE_CHARS = 30_000
#: Parts of a language in which the sample's hashes are ranked first.
SAMPLE_PARTS = 64
#: Texts are parsed in blocks of this many symbols; a phrase ends at a block's end.
BLOCK = 256
#: Blocks that are parsed side by side.
LANES = 4096
UNKNOWN = "und"
SPACE, OTHER = 0, 1  # symbols of all that is no letter, and of letters that no sample holds
#: A table entry holds the next state and, above these bits, the phrases that end on the way.
STATE_BITS = 26
#: Symbols of a held-out row by which the bounds of keep_known are calibrated, from its start.
BOUND_CHARS = 4096
COLUMNS = ("doc_id long, lang_pred string, score double, phrases map<string,long>, symbols long, "
           "bits double")


def symbols(text: str, codes: np.ndarray) -> np.ndarray:
    """Lower-cased letters as symbols, each run of anything else as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found = codes[np.minimum(points, len(codes) - 1)]
    blank = found == SPACE
    keep = ~blank
    keep[1:] |= keep[:-1]
    return found[keep]


def letter_codes(texts: list[str]) -> np.ndarray:
    """Symbol of each code point: letters of the texts from 2 on, other letters 1, the rest 0."""
    known = {c: i + 2 for i, c in enumerate(sorted({c for t in texts for c in t.lower()
                                                    if c.isalpha()}))}
    codes = np.zeros(0x110001, "int32")
    codes[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
    for letter, code in known.items():
        codes[ord(letter)] = code
    return codes


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of text (Blumer et al. 1985)."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            after = moves[at][c]
            if length[after] == length[at] + 1:
                link[new] = after
            else:
                copy = len(moves)
                moves.append(dict(moves[after]))
                length.append(length[at] + 1)
                link.append(link[after])
                while at >= 0 and moves[at].get(c) == after:
                    moves[at][c] = copy
                    at = link[at]
                link[after] = link[new] = copy
        last = new
    return moves


def parse_table(text: np.ndarray, alphabet: int) -> np.ndarray:
    """[state, symbol] -> next state and ended phrases.  A phrase is the longest part of the rest
    that the text holds, or one symbol that it does not hold."""
    moves = suffix_automaton(text)
    root = moves[0]
    single = np.array([root.get(c, 1 << STATE_BITS) for c in range(alphabet)], "int32")
    out = np.tile(single + (1 << STATE_BITS), (len(moves), 1))  # the phrase before ends too
    out[0] = single
    for state, to in enumerate(moves):
        for c, after in to.items():
            out[state, c] = after
    return out


@dataclass
class Model:
    """Languages, symbol codes and one table: each language's states follow the one's before."""

    languages: list[str]
    codes: np.ndarray
    entries: np.ndarray
    bases: np.ndarray
    alphabet: int
    length: int | np.ndarray  # symbols learnt, by language

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] -> number of phrases."""
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // BLOCK) for t in texts])
        out = np.zeros((len(texts), len(self.languages)), "int64")
        if not len(owner):
            return out
        first = np.r_[0, np.cumsum([len(t) for t in texts])]
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        starts = first[owner] + BLOCK * number
        sizes = np.minimum(BLOCK, first[owner + 1] - starts)
        every = np.concatenate(texts)
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), LANES):
            some = order[at:at + LANES]
            np.add.at(out, owner[some], self._parse(every, starts[some], sizes[some]))
        return out

    def _parse(self, every: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Blocks, longest first, step by step through all tables at once."""
        state = np.zeros((len(starts), len(self.languages)), "int64")
        count = np.zeros_like(state)
        mask = (1 << STATE_BITS) - 1
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step))  # sizes above step
            symbol = every[starts[:live] + step]
            entry = self.entries[(state[:live] + self.bases) * self.alphabet + symbol[:, None]]
            state[:live] = entry & mask
            count[:live] += entry >> STATE_BITS
        return count + (state > 0)

    def absent(self, text: np.ndarray) -> np.ndarray:
        """Number of the text's symbols that each language's sample does not hold at all."""
        roots = self.entries.reshape(-1, self.alphabet)[self.bases]
        return (roots == 1 << STATE_BITS) @ np.bincount(text, minlength=self.alphabet)

    def entropies(self, phrases: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Bits per symbol by language.  A phrase costs the bits of a place in the language's own
        sample or of a symbol of the alphabet, so phrases of a small sample, which are shorter, are
        cheaper; a symbol that the sample does not hold costs the same in every language."""
        length = np.broadcast_to(self.length, len(self.languages))
        places, strange = np.log2(length + self.alphabet), self.absent(text)
        return ((phrases - strange) * places + strange * places.max()) / max(1, len(text))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` different texts of each language, in the order of a hash of id and text.

    The hashes are chosen first, without the texts (top-k in each task before the shuffle).  Then
    the texts of at most `rows` hashes a language are read, copies of a text combined in each task."""
    parts = F.pmod("_hash", F.lit(SAMPLE_PARTS))
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("_hash"))
    chosen = usable.select("lang", "_hash").distinct()
    for keys in (["lang", parts], ["lang"]):  # by parts first: no task ranks all of a language
        order = Window.partitionBy(*keys).orderBy("_hash")
        chosen = chosen.withColumn("_rank", F.row_number().over(order)).where(
            F.col("_rank") <= rows)
    return usable.join(F.broadcast(chosen), ["lang", "_hash"]).groupBy("lang", "_rank").agg(
        F.min("text").alias("text"))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """Model of the languages of docs (doc_id, text, lang); None when no row can be learnt from.

    The driver gets at most `rows` texts of each language and learns `chars` symbols of each, or as
    many as there are.  No language's sample depends on another's.
    """
    texts: dict[str, list[str]] = {}
    for row in sorted(sample(docs, rows).collect()):
        texts.setdefault(row["lang"], []).append(row["text"])
    texts = {lang: kept for lang, kept in texts.items() if any(c.isalpha() for t in kept
                                                               for c in t)}
    if not texts:
        return None
    codes = letter_codes([t for kept in texts.values() for t in kept])
    coded = {lang: symbols(" ".join(kept), codes)[:chars] for lang, kept in sorted(texts.items())}
    alphabet = int(codes.max()) + 1
    tables = [parse_table(x, alphabet) for x in coded.values()]
    bases = np.cumsum([0, *(len(t) for t in tables)])[:-1]
    return Model(list(coded), codes, np.concatenate(tables).ravel(), bases, alphabet,
                 np.array([len(x) for x in coded.values()]))


def _judged(m: Model, texts: list[str | None]) -> pd.DataFrame:
    some = [t is not None and any(map(str.isalpha, t)) for t in texts]
    coded = [symbols(t, m.codes) if ok else m.codes[:0] for t, ok in zip(texts, some)]
    rows = []
    for ok, own, found in zip(some, coded, m.phrases(coded)):
        if not ok:
            rows.append((UNKNOWN, 0.0, {}, 0, 0.0))
            continue
        bits = m.entropies(found, own)
        share = np.exp2(bits.min() - bits)
        rows.append((m.languages[int(bits.argmin())], float(1 / share.sum()),
                     dict(zip(m.languages, found.tolist())), len(own), float(bits.min())))
    return pd.DataFrame(rows, columns=["lang_pred", "score", "phrases", "symbols", "bits"])


def _predict(model):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = _judged(model.value, batch["text"].tolist())
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return predict


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, phrases (by language), symbols, bits (per
    symbol, of the winner).

    The text's letters are parsed whole, in blocks, into the longest phrases that each language's
    sample holds; the language with the fewest bits (phrases, normalized by the length of its own
    sample and of the text) wins, of equal ones the first in order.  score is its share when each language weighs two to
    the minus its bits per symbol.

    A null text or one without a letter is `und` with score 0, and so is every text when the model
    is None (nothing to learn from).  Letters that no sample holds are phrases of their own.  A
    null doc_id stays null, repeated rows are predicted alike, no rows give no rows.  The table is
    broadcast: at most 2 states per learnt symbol, 4 bytes per state and letter.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.create_map().cast("map<string,bigint>").alias("phrases"),
                           F.lit(0).cast("long").alias("symbols"), F.lit(0.0).alias("bits"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInPandas(_predict(sent), COLUMNS)


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = count(docs.where(~held_out("doc_id")))
    return judge(docs, model).select("doc_id", held_out("doc_id").alias("held_out"),
                                       "lang_pred", "score", "symbols")


def bounds(held: DataFrame, model: Model, rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Most bits per symbol of a text in each language, from labelled rows that fit did not see:
    halfway between the median of the language's own rows and of the same rows with their symbols
    shuffled, so other languages have no part in it.  A language without such rows gets the mean
    bound of the others, and none if no language has any.

    The driver gets at most `rows` texts of each language and parses BOUND_CHARS symbols of each.
    """
    texts: dict[str, list[np.ndarray]] = {}
    for row in sorted(sample(held, rows).collect()):
        if row["lang"] in model.languages and any(map(str.isalpha, row["text"])):
            texts.setdefault(row["lang"], []).append(
                symbols(row["text"], model.codes)[:BOUND_CHARS])
    random, found = np.random.default_rng(0), {}
    for lang, own in texts.items():
        k = model.languages.index(lang)
        middle = [np.median([model.entropies(n, t)[k]
                             for t, n in zip(some, model.phrases(some))])
                  for some in (own, [random.permutation(t) for t in own])]
        found[lang] = float(np.mean(middle))
    rest = float(np.mean(list(found.values()))) if found else math.inf
    return {lang: found.get(lang, rest) for lang in model.languages}


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows of docs in a language that is clearly known: not `und`, and no more bits per symbol
    than the bound of the language.  Each row is judged for itself where it is read, also without a
    doc_id; rows without one are dealt to training and calibration by a hash of their text.  A null
    text, or one without a letter, is `und`; without labelled rows every text is.  All columns stay
    as they are; no rows give no rows."""
    labelled = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text", "lang")
    model = count(labelled.where(~held_out("doc_id")))
    if model is None:
        return docs.where(F.lit(False))
    sent = docs.sparkSession.sparkContext.broadcast(
        (model, limits(labelled.where(held_out("doc_id")), model)))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        model, most = sent.value
        found = pd.concat([_scored(model, texts.iloc[at:at + LANES].tolist())
                           for at in range(0, len(texts), LANES)], ignore_index=True)
        return (found["lang_pred"] != UNKNOWN) & (
            found["bits"] <= found["lang_pred"].map(most).fillna(math.inf))

    verdict = fresh(docs, "_known")
    return docs.withColumn(verdict, known("text")).where(verdict).drop(verdict)


_letters: np.ndarray | None = None
#: A language knows the parts that are found at one in PLACES of its training places or more, so
#: its automaton is bounded whatever the number of rows.
PLACES = 1 << 15
#: Most bytes of a part: parts are counted exactly, as longs.
ORDER = 8
#: Lengths counted in one pass over the training rows; longer parts consist of known shorter ones.
PASSES = ((1, 2, 3), (4, 5), (6, 7, 8))
#: Places sorted at once while counting.
SLICE = 1 << 21
#: With fewer texts left than this, each is parsed by itself to its end.
TAIL = 16
COUNTED = "lang string, size int, part long, n long"


def points(text: str) -> np.ndarray:
    """Lower-cased letters by code point, each run of anything else as one 0."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)] + [False])
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.where(_letters[np.minimum(found, 0x110000)], found, 0)
    keep = found != 0
    keep[1:] |= keep[:-1]
    return found[keep]


def spelled(symbols: np.ndarray) -> bytes:
    """Symbols in UTF-8 with a space before, between and after words."""
    text = np.where(symbols == 0, 32, symbols).astype("<u4").tobytes().decode(
        "utf-32-le", "surrogatepass").rstrip(" ")
    return b" " + text.encode("utf-8", "surrogatepass") + b" "


def first(parts: np.ndarray, size: int) -> np.ndarray:
    """The first bytes of parts (bytes of a long from the highest, zeros behind)."""
    return parts & np.uint64((0xFFFFFFFFFFFFFFFF << 8 * (ORDER - size)) & 0xFFFFFFFFFFFFFFFF)


def member(parts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each part is in the sorted array."""
    if not len(known):
        return np.zeros(len(parts), bool)
    return known[np.minimum(np.searchsorted(known, parts), len(known) - 1)] == parts


def parts_of(texts: list[bytes], sizes: tuple[int, ...], known: np.ndarray | None
             ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """size, parts, numbers: how often each part of the texts of these sizes is found.  Given
    known parts one shorter than the first size, only parts that consist of them."""
    every = np.frombuffer(b"\0".join(texts) + bytes(ORDER), "uint8")
    for at in range(0, len(every) - ORDER, SLICE):
        some = every[at:min(at + SLICE, len(every) - ORDER) + ORDER - 1]
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(some, ORDER))
        ordered = np.sort(windows.view(">u8").ravel().astype("uint64"))
        for size in sizes:
            parts = first(ordered, size)
            starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
            n, parts = np.diff(np.r_[starts, len(parts)]), parts[starts]
            # No zero byte: the part does not go beyond its text.
            ok = np.ones(len(parts), bool)
            for i in range(size):
                ok &= (parts >> np.uint64(8 * (ORDER - 1 - i))) & np.uint64(255) != 0
            n, parts = n[ok], parts[ok]
            if known is not None:
                below = sizes[0] - 1
                for i in range(size - below + 1):
                    ok = member(first(parts << np.uint64(8 * i), below), known)
                    n, parts = n[ok], parts[ok]
            yield size, parts, n


@dataclass
class Automata:
    """Languages and one table: the smallest automaton of each one's known parts (its suffix
    automaton without rare parts), each language's states behind those of the one before."""

    languages: list[str]
    codes: np.ndarray  # of a byte; the last code is of bytes that no language knows
    alphabet: int
    entries: np.ndarray  # [state, code]: next state and, above STATE_BITS, the phrases that end
    bases: np.ndarray
    places: np.ndarray  # bits of a phrase, by language

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] -> number of phrases of whole texts (codes).  A phrase is the longest
        part of the rest that the language knows, or one byte that it does not know."""
        out = np.zeros((len(texts), len(self.languages)), "int64")
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for at in range(0, len(order), LANES):
            some = order[at:at + LANES]
            out[some] = self._parse([texts[i] for i in some])
        return out

    def _parse(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts, longest first, step by step through all tables at once."""
        sizes = np.array([len(t) for t in texts])
        starts, every = np.r_[0, np.cumsum(sizes)[:-1]], np.concatenate(texts)
        state = np.zeros((len(texts), len(self.languages)), "int64")
        count = np.zeros_like(state)
        mask, step = (1 << STATE_BITS) - 1, 0
        live = len(texts)
        while live >= TAIL:
            live = int(np.searchsorted(-sizes, -step))  # sizes above step
            symbol = every[starts[:live] + step]
            entry = self.entries[(state[:live] + self.bases) * self.alphabet + symbol[:, None]]
            state[:live] = entry & mask
            count[:live] += entry >> STATE_BITS
            step += 1
        table = memoryview(self.entries)
        for i in range(live):
            rest = every[starts[i] + step:starts[i] + sizes[i]].tolist()
            for k, base in enumerate(self.bases.tolist()):
                at, n = int(state[i, k]), 0
                for c in rest:
                    entry = table[(at + base) * self.alphabet + c]
                    at = entry & mask
                    n += entry >> STATE_BITS
                state[i, k], count[i, k] = at, count[i, k] + n
        return count + (state > 0)

    def bits(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] -> bits per symbol of texts (points).  A phrase costs the bits of one
        of the language's places; a byte that it does not know costs the same in every language."""
        coded = [self.codes[np.frombuffer(spelled(t), "uint8")] for t in texts]
        roots = self.entries.reshape(-1, self.alphabet)[self.bases] == 1 << STATE_BITS
        strange = np.array([roots @ np.bincount(t, minlength=self.alphabet) for t in coded])
        strange = strange.reshape(len(texts), len(self.languages))
        total = (self.phrases(coded) - strange) * self.places + strange * self.places.max()
        return total / np.array([len(t) for t in texts]).reshape(-1, 1)


def automaton(known: list[np.ndarray], codes: np.ndarray, alphabet: int) -> np.ndarray:
    """[state, code] -> next state and ended phrases, of known parts by size (from 1 on, each with
    all its own parts).  States from which the same goes on are one; state 0 is the start."""
    one = 1 << STATE_BITS
    number = lambda p, size: codes[((p >> np.uint64(8 * (ORDER - size)))
                                    & np.uint64(255)).astype("int64")]
    rows = [np.full((1, alphabet), -1, "int32")]  # state 1: nothing goes on
    states, total = np.zeros(0, "int64"), 2
    for size in range(len(known) - 1, -1, -1):  # parts of this size, by those one longer
        own = known[size - 1] if size else np.zeros(1, "uint64")
        moves = np.full((len(own), alphabet), -1, "int32")
        longer = known[size]
        at = np.searchsorted(own, first(longer, size)) if size else np.zeros(len(longer), "int64")
        moves[at, number(longer, size + 1)] = states if len(states) else 1
        if not size:
            break
        states = np.ones(len(own), "int64")
        inner = (moves >= 0).any(axis=1)
        if inner.any():
            unique, which = np.unique(moves[inner], axis=0, return_inverse=True)
            states[inner] = total + which.ravel()
            rows.append(unique)
            total += len(unique)
    single = np.where(moves[0] < 0, one, moves[0])
    table = np.concatenate([moves, *rows])
    table = np.where(table < 0, single + one, table).astype("int32")
    table[0] = single
    return table


def count(docs: DataFrame) -> Automata | None:
    """Automata of every row of docs (doc_id, text, lang) with a lang and a letter; None when there
    is none.  Spark counts the parts of whole texts exactly, pass by pass; the driver gets at most
    PLACES parts of each size and language, whatever the number of rows."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    spark, known, least = docs.sparkSession, {}, None
    for sizes in PASSES:
        found = usable.mapInPandas(_counted(spark, sizes, known), COUNTED).groupBy(
            "lang", "size", "part").agg(F.sum("n").alias("n"))
        if least is None:
            found = materialize(found, "language-parts")
            total = {r["lang"]: r["n"] for r in found.where("size = 1").groupBy("lang").agg(
                F.sum("n").alias("n")).collect()}
            if not total:
                return None
            least = F.broadcast(spark.createDataFrame(
                [(lang, -(-n // PLACES)) for lang, n in total.items()], "lang string, least long"))
        kept = found.join(least, "lang").where("n >= least").select(
            "lang", "size", "part").toPandas()
        for (lang, size), part in kept.groupby(["lang", "size"])["part"]:
            known[lang, size] = np.sort(part.to_numpy("int64").view("uint64"))
    languages = sorted(total)
    letters = np.unique(np.concatenate([known[x, 1] for x in languages]) >> np.uint64(56))
    codes = np.full(256, len(letters), "int16")
    codes[letters.astype("int64")] = np.arange(len(letters))
    none = np.zeros(0, "uint64")
    tables = [automaton([known.get((x, k), none) for k in range(1, ORDER + 1)], codes,
                        len(letters) + 1) for x in languages]
    bases = np.cumsum([0, *(len(t) for t in tables)])[:-1]
    places = np.log2([min(total[x], PLACES) + len(letters) for x in languages])
    return Automata(languages, codes, len(letters) + 1, np.concatenate(tables).ravel(), bases,
                    places)


def _counted(spark: SparkSession, sizes: tuple[int, ...], known: dict):
    below = {lang: parts for (lang, size), parts in known.items() if size == sizes[0] - 1}
    sent = spark.sparkContext.broadcast(below)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, "uint64")
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                own = [spelled(x) for x in map(points, texts) if len(x)]
                before = sent.value.get(lang, none) if sizes[0] > 1 else None
                for size, parts, n in parts_of(own, sizes, before):
                    yield pd.DataFrame({"lang": lang, "size": size, "part": parts.view("int64"),
                                        "n": n})

    return counted


def _scored(m: Automata, texts: list[str | None]) -> pd.DataFrame:
    own = [points(t) if t is not None else np.zeros(0, "<u4") for t in texts]
    some = [i for i, x in enumerate(own) if len(x)]
    out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "symbols": [len(x) for x in own],
                        "bits": 0.0})
    if some:
        bits = m.bits([own[i] for i in some])
        least = bits.min(axis=1)
        out.loc[some, "lang_pred"] = [m.languages[k] for k in bits.argmin(axis=1)]
        out.loc[some, "score"] = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
        out.loc[some, "bits"] = least
    return out


def judge(docs: DataFrame, model: Automata | None, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, symbols, bits (per symbol, of the
    winner).  Whole texts are parsed into the longest parts that each language knows.  The language
    of fewest bits wins, of equal ones the first in order; score is its share when each weighs two
    to the minus its bits.  A null text or one without a letter is `und` with score 0, and every
    text is when the model is None."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0).cast("long").alias("symbols"), F.lit(0.0).alias("bits"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), LANES):
                some = batch.iloc[at:at + LANES]
                out = _scored(sent.value, some["text"].tolist())
                out.insert(0, "doc_id", some["doc_id"].array)
                yield out

    return rows.mapInPandas(predict, "doc_id long, lang_pred string, score double, symbols long, "
                                     "bits double")


def limits(held: DataFrame, model: Automata) -> dict[str, float]:
    """Most bits per symbol of a text in each language, from every labelled row that the model
    did not see: halfway between the exact median of the language's own rows and of the same rows
    with their symbols shuffled.  A language without such rows gets the mean bound of the others,
    and none if no language has any."""
    sent = held.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in (whole.iloc[at:at + LANES] for whole in batches
                      for at in range(0, len(whole), LANES)):
            place = batch["lang"].map({x: k for k, x in enumerate(m.languages)})
            own = [points(t) for t in batch["text"]]
            some = [i for i, k in enumerate(place) if k == k and len(own[i])]
            if not some:
                continue
            at = (np.arange(len(some)), place.to_numpy()[some].astype("int64"))
            mixed = [np.random.default_rng(zlib.crc32(batch["text"].iloc[i].encode(
                "utf-8", "surrogatepass"))).permutation(own[i]) for i in some]
            yield pd.DataFrame({"lang": batch["lang"].to_numpy()[some],
                                "own": m.bits([own[i] for i in some])[at],
                                "mixed": m.bits(mixed)[at]})

    found = held.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(
        measured, "lang string, own double, mixed double").groupBy("lang").agg(
        ((F.median("own") + F.median("mixed")) / 2).alias("bound")).collect()
    found = {r["lang"]: r["bound"] for r in found}
    rest = float(np.mean(list(found.values()))) if found else math.inf
    return {lang: found.get(lang, rest) for lang in model.languages}
