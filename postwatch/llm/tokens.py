"""Token ids of texts with a public word vocabulary, for tasks that see many texts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Words and parts of words a worker remembers before it starts again (some 150 bytes each), and
#: their most bytes.
CACHE_WORDS = 600_000
CACHE_BYTES = 64
#: Parts that go to the library in one call.
BATCH = 1024
#: Bytes of texts whose new words are gathered at a time.
LEARN_BYTES = 1 << 21
#: Words that may be cut without changing their ids: of characters up to U+027F and dashes and
#: quotes, none of which composes with a neighbour.  Not U+0130, which becomes i and a mark that
#: goes with the symbols after it.  They are cut between a letter and an ASCII symbol that is no
#: apostrophe (letters: a-z and those from U+00C0 to U+027F, lower-cased ASCII).
LETTER = (rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]"
          rb"|[\xc5-\xc9][\x80-\xbf])")
SYMBOL = rb"[!-&(-/:-@\[-`{-~]"
PLAIN = re.compile(rb"(?:[\x00-\x7f]|[\xc2\xc3][\x80-\xbf]|" + LETTER + rb"|\xe2\x80[\x90-\xbf])*")
LETTERS = re.compile(LETTER + rb"+")
CUTS = re.compile(rb"(?<=[a-z])(?=" + SYMBOL + rb")"
                  rb"|(?<=[\xc3-\xc9][\x80-\xbf])(?<!\xc3[\x97\xb7])(?=" + SYMBOL + rb")"
                  rb"|(?<=" + SYMBOL + rb")(?=" + LETTER + rb")")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer without truncation and padding; one per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordEncoder:
    """Encodes texts word by word.  The vocabulary's pieces never cross white space and its
    normalizer does not either, so the ids of a text are those of its words in order; a word that
    is new is cut at its symbols, so that its letters are looked up without their punctuation."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in special)
                                  or b"(?!)")
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _library(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([p.decode() for p in parts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _letters(self, parts: list[bytes]) -> list[bytes]:
        """Parts of letters only are one piece each, so one text holds them all."""
        got = self.tokenizer.encode(b" ".join(parts).decode(), add_special_tokens=False)
        piece = np.array(got.word_ids)
        ends = np.flatnonzero(np.diff(piece, append=-1)) + 1
        if len(ends) != len(parts):
            return self._library(parts)
        ids, cuts = np.array(got.ids, "<u4").tobytes(), (4 * ends).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def _cut(self, word: bytes) -> list[bytes]:
        if word.isalnum():  # ASCII only
            return [word.lower()]
        if b"<|" in word and self.special.search(word) or not (
                word.isascii() or PLAIN.fullmatch(word)):
            return [word]
        return CUTS.split(word.lower())

    def learn(self, texts: Iterable[list[bytes]]) -> None:
        """Encode the short words of texts that are not known yet, in batches."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        seen: set[bytes] = set().union(*texts)
        seen.difference_update(self.words)
        cut = self._cut
        fresh = {word: cut(word) for word in seen if len(word) <= CACHE_BYTES}
        parts = self.parts
        new = {p for pieces in fresh.values() for p in pieces if p not in parts}
        letters = [p for p in new if p.isalpha() or LETTERS.fullmatch(p)]
        others = list(new.difference(letters))
        for some, call in ((letters, self._letters), (others, self._library)):
            for at in range(0, len(some), BATCH):
                parts.update(zip(some[at:at + BATCH], call(some[at:at + BATCH])))
        self.words.update((w, parts[p[0]] if len(p) == 1 else b"".join([parts[x] for x in p]))
                          for w, p in fresh.items())

    def encode(self, split: list[bytes]) -> np.ndarray:
        """Ids of the words of a text."""
        words = self.words
        try:
            return np.frombuffer(b"".join(map(words.__getitem__, split)), "<u4")
        except KeyError:
            parts = [words[w] if w in words else self._library([w])[0] for w in split]
            return np.frombuffer(b"".join(parts), "<u4")

    def encode_all(self, texts: Iterable[str | None]) -> Iterable[np.ndarray]:
        """Ids of each text; null counts as empty."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            coded = (text or "").encode()
            size += len(coded)
            held.append(coded.split())  # kept, so that a word is hashed once
            if size > LEARN_BYTES:
                yield from self._learnt(held)
                held, size = [], 0
        yield from self._learnt(held)

    def _learnt(self, texts: list[list[bytes]]) -> Iterable[np.ndarray]:
        self.learn(texts)
        return map(self.encode, texts)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
