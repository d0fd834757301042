"""Whitespace stripping, folding and the three text analyzers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters a Python ``str.strip`` removes, as a regex class.
BLANK = (
    r"[\t\n\x0b\f\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

#: Lowercase letters that fold to two ASCII letters.
TWO_LETTER_FOLDS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ǆ": "dz", "ǉ": "lj", "ǌ": "nj"}

#: Lowercase letters without a decomposition that fold to one ASCII letter.
ONE_LETTER_FOLDS = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n", "ĸ": "q", "ſ": "s"}


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode decomposition."""
    table = dict(ONE_LETTER_FOLDS)
    for start, stop in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for ch in map(chr, range(start, stop)):
            base = unicodedata.normalize("NFD", ch)[0]
            if ch == ch.lower() and base != ch and base.isascii() and base.isalpha():
                table[ch] = base
    return "".join(table), "".join(table.values())


FOLD_FROM, FOLD_TO = _fold_table()


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` only removes spaces)."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def beyond_ascii(c: Column) -> Column:
    """Whether text holds a character of more than one byte; two lengths tell it sooner than a pattern."""
    return F.octet_length(c) != F.char_length(c)


def fold(c: Column) -> Column:
    """ASCII folding of lowercased text; text that is ASCII already is left untouched."""
    folded = F.translate(c, FOLD_FROM, FOLD_TO)
    for letter, pair in TWO_LETTER_FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(pair))
    return F.when(beyond_ascii(c), folded).otherwise(c)


# Word segmentation after Unicode UAX #29: runs of letters, marks, digits and
# connectors; `.` `'` `:` join letters, `.` `'` `,` `;` join digits; every Han or
# Hiragana character stands alone. ASCII comes first in each class, since that is
# what nearly every character of folded text is.
_JOINERS = (
    r"(?:[.:'\x{b7}\x{2018}\x{2019}](?<=[a-z\p{L}\p{M}].)(?=[a-z\p{L}])"
    r"|[.,;'\x{2018}\x{2019}](?<=[0-9\p{Nd}].)(?=[0-9\p{Nd}]))"
)
_ALONE = r"\x{3040}-\x{309f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"


def _words(run: str) -> str:
    return rf"{run}(?:{_JOINERS}{run})*+"


WORD = _words(r"[a-z0-9_\p{L}\p{M}\p{N}\p{Pc}]++")
WORD_OR_IDEOGRAPH = rf"[{_ALONE}]|" + _words(rf"[a-z0-9_\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}&&[^{_ALONE}]]++")


def analyze(c: Column) -> Column:
    """Word tokens, lowercased and folded. Null gives no tokens.

    Folding turns letters into letters, so it may come before the words are cut.
    """

    def cut(text: Column) -> Column:
        return F.when(
            beyond_ascii(text) & text.rlike(f"[{_ALONE}]"), F.regexp_extract_all(text, F.lit(WORD_OR_IDEOGRAPH), 0)
        ).otherwise(F.regexp_extract_all(text, F.lit(WORD), 0))

    tokens = once(F.lower(c), lambda low: once(fold(low), cut))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def letter_digit_tokens(c: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nd}]+"), 0)
    return F.coalesce(tokens, F.array().cast("array<string>"))


#: Characters of the longest prefix that a token is found by.
LONGEST_PREFIX = 20


def prefix_count(tokens: Column) -> Column:
    """How many prefixes the tokens have: the length of a field that is searched by prefixes."""
    return F.aggregate(tokens, F.lit(0), lambda n, t: n + F.least(F.lit(LONGEST_PREFIX), F.length(t)))


def edge_ngrams(c: Column, longest: int = LONGEST_PREFIX) -> Column:
    """All prefixes of 1..longest characters of each letter/digit token."""
    return F.flatten(
        F.transform(
            letter_digit_tokens(c),
            lambda t: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), F.length(t))), lambda n: F.substring(t, F.lit(1), n)
            ),
        )
    )


def letter_tokens(c: Column) -> Column:
    """Runs of letters, lowercased; digits separate tokens and are dropped."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), 0), F.array().cast("array<string>"))
