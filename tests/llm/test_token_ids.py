"""Token ids against the tokenizers library where lower-casing and composing change lengths."""

import random

import pytest

from postwatch.llm.tokens import WordEncoder, tokenizer, vocabulary_path

SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters whose lower case or composition has another length, and marks that join what they follow.
HARD = list("İıǅŉßſKÅΣς가각각ẞﬁ½²٣一") + ["İ", "é", "́", "̇", "̸"]


@pytest.fixture(scope="module")
def path():
    return vocabulary_path()


def check(path, words):
    encoder, library = WordEncoder(path), tokenizer(path)
    words = [w for w in words if w.strip()]
    want = library.encode_batch(words, add_special_tokens=False)
    got = list(encoder.encode_all(words))
    assert [w for w, a, b in zip(words, want, got) if a.ids != b.tolist()] == []


def test_every_letter_before_and_after_every_symbol(path):
    letters = [chr(c) for c in range(0xA0, 0x300)]
    check(path, [w for a in letters for s in SYMBOLS for w in (a + s, s + a, f"x{a}{s}y{s}{a}")])


def test_random_words_of_hard_letters(path):
    random.seed(11)
    pool = [*HARD, *HARD, *SYMBOLS, *"abcstdlrevmABCST0123", "'s", "'LL", "don't"]
    check(path, ["".join(random.choices(pool, k=random.randrange(1, 30))) for _ in range(100_000)])


def test_upper_case_turkish(path):
    check(path, ["İ.", "CEMİYETİ,", "(İ)", "Lİ-x", "a" * 20 + "İ.", "a" * 80 + "İ."])
