"""Tokenisation as Column expressions: no Python runs per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# --------------------------------------------------------------- fixed values
# A word is a run of letters and digits in any script.
WORD = r"[\p{L}\p{N}]+"
# Scripts written without spaces: kana, CJK ideographs, compatibility forms, half-width kana.
UNSPACED = "[぀-ヿ㐀-䶿一-鿿豈-﫿･-ﾟ]"
# ----------------------------------------------------------- end fixed values

# Where an ASCII identifier changes case: lower|Upper, UPPER|Upper+lower, Upper|digit.
CASE_CHANGE = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Z])(?=[0-9])"
HAS_CASE_CHANGE = r"[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[A-Z][0-9]"
# Either of these, or an unspaced script: a scan stops at capitals only, not at every letter.
NEEDS_PIECES = r"[A-Z](?:(?<=[a-z0-9][A-Z])|[A-Z][a-z]|[0-9])|" + UNSPACED


def _accent_table() -> tuple[str, str]:
    """Latin letters that are a plain ASCII letter plus combining marks."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            accented.append(letter)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()


def _empty() -> Column:
    return F.array().cast("array<string>")


def _pieces(word: Column) -> Column:
    """What a word adds besides itself: identifier parts, or character bigrams."""
    lowered = F.lower(word)
    parts = F.filter(
        F.transform(F.split(word, CASE_CHANGE), lambda p: F.lower(p)),
        lambda p: F.length(p) > 1,
    )
    bigrams = F.transform(
        F.sequence(F.lit(1), F.length(lowered) - 1),
        lambda i: F.substring(lowered, i, F.lit(2)),
    )
    return (
        F.when(word.rlike("^[A-Za-z0-9]+$") & word.rlike(HAS_CASE_CHANGE), parts)
        .when(word.rlike(UNSPACED) & (F.length(lowered) > 1), bigrams)
        .otherwise(_empty())
    )


def tokens(text: Column) -> Column:
    """Every token of ``text`` in order, duplicates kept.

    Most text has neither identifiers nor unspaced scripts; one scan of the
    string decides that, and such rows skip the per-word branch.
    """
    safe = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(safe, F.lit(WORD), F.lit(0))
    expanded = F.flatten(
        F.transform(words, lambda w: F.concat(F.array(F.lower(w)), _pieces(w)))
    )
    plain = F.transform(words, lambda w: F.lower(w))
    return F.when(safe.rlike(NEEDS_PIECES), expanded).otherwise(plain)


def token_set(text: Column) -> Column:
    """Ordered-distinct tokens."""
    return F.array_distinct(tokens(text))


def expand(text: Column) -> Column:
    """Ordered-distinct tokens joined by one space."""
    return F.array_join(token_set(text), " ")


def fold(token: Column) -> Column:
    """Strip diacritics from one token, as the index does on both sides; ASCII passes through."""
    return F.when(_ascii(token), token).otherwise(F.translate(token, ACCENTED, PLAIN))


def _ascii(text: Column) -> Column:
    """Whether every character is one byte."""
    return F.octet_length(text) == F.length(text)


def fold_all(text: Column, array: Column) -> Column:
    """Fold an array of tokens; ASCII rows, judged on ``text``, pass through."""
    return F.when(_ascii(F.coalesce(text, F.lit(""))), array).otherwise(F.transform(array, lambda t: fold(t)))


def query_terms(text: Column) -> Column:
    """Index terms a query probes: distinct tokens longer than one char, folded."""
    kept = F.filter(token_set(text), lambda t: F.length(t) > 1)
    return fold_all(text, kept)


def slugify(text: Column, fallback: str = "project") -> Column:
    """Lower-case, runs of other characters to one dash, trimmed."""
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.when(trimmed == "", F.lit(fallback)).otherwise(trimmed)


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap of two arrays; zero when either is empty."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    union = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right)) - shared
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(shared / union)
