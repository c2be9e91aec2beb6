"""Text folding, fingerprints and the small string rules shared by all operators."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns decide fingerprints, so they must not change.
GENDER_MARKER = r"\s*[\(\[]?\s*[hfm]\s*/\s*[hfm]\s*[\)\]]?\s*"
TRAILING_PUNCTUATION = ".,;:!?"
TIER_SUFFIX = r"\s*\(p[1-3]\)$"

# White space as Python's re and str.strip see it; Java's (?U)\s lacks the four separators.
SPACE = r"[\s\x1c-\x1f]"
_HANGUL = range(0xAC00, 0xD7A4)


def _decomposed(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


@functools.cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, expansions): translate() arguments for one-to-one folds followed by deletions,
    and the characters that decompose to several.  Built from the Unicode database by rule."""
    single, deleted, several = {}, [], {}
    for code in range(0x80, 0x30000):
        if 0xD800 <= code < 0xE000 or code in _HANGUL:
            continue
        char = chr(code)
        if char.lower() != char:
            continue  # lower() runs first
        folded = _decomposed(char)
        if folded == char:
            continue
        if not folded:
            deleted.append(char)
        elif len(folded) == 1:
            single[char] = folded
        else:
            several[char] = folded
    return "".join(single) + "".join(deleted), "".join(single.values()), several


def _char_class(chars: list[str], gap: int = 64) -> str:
    """Regex class body that covers the characters.  Ranges closer than `gap` are joined: a short
    class keeps plans small, and a character caught needlessly is only looked up in vain."""
    ranges = []
    for code in sorted(map(ord, chars)):
        if ranges and code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


@functools.cache
def _expandable() -> str:
    return _char_class([*fold_tables()[2], *map(chr, _HANGUL)])


def _expand(folded: Column) -> Column:
    """Replace characters that decompose to several; only rows that hold one get here."""
    several = fold_tables()[2]
    # Two literals that fold to one constant map; a literal per entry would bloat every plan.
    table = F.map_from_arrays(
        F.split(F.lit("\n".join(several)), "\n"),
        F.split(F.lit("\n".join(several.values())), "\n"),
    )

    def jamo(char: Column) -> Column:
        # Hangul syllables decompose by arithmetic: lead, vowel and optional tail.
        index = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
        tail = index % 28
        codes = F.array(
            0x1100 + (index / 588).cast("int"),
            0x1161 + ((index % 588) / 28).cast("int"),
        )
        codes = F.when(tail > 0, F.array_append(codes, 0x11A7 + tail)).otherwise(codes)
        parts = F.transform(
            codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")
        )
        return F.array_join(parts, "")

    def one(char: Column) -> Column:
        return (
            F.when(char <= "\x7f", char)
            .when(char.between("가", "힣"), jamo(char))
            .otherwise(F.coalesce(F.element_at(table, char), char))
        )

    return F.array_join(F.transform(F.split(folded, ""), one), "")


def fold(col: Column) -> Column:
    """Lower case, compatibility decomposition, combining marks dropped."""
    source, target, _ = fold_tables()
    folded = F.translate(F.lower(col), source, target)
    # Comparing lengths tells plain ASCII, the common case, without a regex.
    return F.when(
        (F.octet_length(folded) > F.length(folded))
        & folded.rlike(f"[[^\\x00-\\x7f]&&[{_expandable()}]]"),
        _expand(folded),
    ).otherwise(folded)


def normalize(col: Column) -> Column:
    """Comparable form of a title, company or place: folded, gender marker removed, spaces
    collapsed, trailing punctuation dropped."""
    # What follows a run of spaces is never a space, so the runs need no backtracking.
    marker = "(?U)" + GENDER_MARKER.replace(r"\s*", SPACE + "*+")
    text = F.regexp_replace(fold(col), marker, " ")
    text = F.trim(F.regexp_replace(text, f"(?U){SPACE}++", " "))
    return F.trim(F.rtrim(text, F.lit(TRAILING_PUNCTUATION)))


def normalize_py(text: str) -> str:
    """normalize() for driver-side parameters (a handful of targets or labels)."""
    text = re.sub(GENDER_MARKER, " ", "".join(map(_decomposed, text.lower())))
    return re.sub(r"\s+", " ", text).strip().rstrip(TRAILING_PUNCTUATION).strip()


def fingerprint(company: Column, title: Column) -> Column:
    """Content key of a posting: SHA-256 of the normalized company and title."""
    return F.sha2(F.concat(normalize(company), F.lit("|"), normalize(title)), 256)


def clean_employer(col: Column) -> Column:
    """Employer as typed by hand: keep what stands before an em dash, drop a tier suffix."""
    head = F.trim(F.split(normalize(col), "—")[0])
    return F.trim(F.regexp_replace(head, TIER_SUFFIX, ""))


def strip(col: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(col, f"(?U)^{SPACE}+|{SPACE}+$", "")


def clean(col: Column) -> Column:
    """Trimmed text; null for missing, NaN, NaT and blank values."""
    text = strip(col.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "nat"), text)


def or_default(col: Column, default: str) -> Column:
    """The text, or the default when null or empty."""
    return F.when(F.length(col) > 0, col).otherwise(F.lit(default))
