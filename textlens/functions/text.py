"""Tokens, n-grams and text formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word runs with Unicode letters and digits. Java's own \w is ASCII-only.
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# The white space a plain string split separates on (fixed values).
BLANK_PATTERN = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text) -> Column:
    """Lower-case word runs; an empty array for a null text."""
    words = F.regexp_extract_all(F.lower(_column(text)), F.lit(WORD_PATTERN), 0)
    return F.coalesce(words, F.array().cast("array<string>"))


def n_tokens(tokens) -> Column:
    return F.size(_column(tokens))


def ws_tokens(text) -> Column:
    """Blank-separated pieces; null for a null text."""
    return F.filter(F.split(_column(text), BLANK_PATTERN), lambda piece: piece != "")


def n_ws_tokens(text) -> Column:
    """Number of blank-separated pieces; null for a null text, not -1 or 0."""
    text = _column(text)
    return F.when(text.isNotNull(), F.size(ws_tokens(text)))


def ngrams(tokens, n: int) -> Column:
    """Contiguous n-grams of one document, joined by a blank, stop words kept.

    Row-local. To count them, ``operators.lexical.explode_ngrams`` is cheaper: it
    never builds the array of joined strings.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    tokens = _column(tokens)
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    grams = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(tokens, i, F.lit(n))))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def inject_keyword(keyword, text) -> Column:
    """'[keyword] text', with missing parts as empty strings."""
    blank = F.lit("")
    return F.concat(
        F.lit("["),
        F.coalesce(_column(keyword), blank),
        F.lit("] "),
        F.coalesce(_column(text), blank),
    )


def preview(text, length: int = 120) -> Column:
    return F.substring(_column(text), 1, length)


def is_missing(column, na_values: tuple[str, ...] = ()) -> Column:
    """Null, or one of the spellings that a source uses for null."""
    column = _column(column)
    missing = column.isNull()
    if na_values:
        missing = missing | F.coalesce(column.isin(list(na_values)), F.lit(False))
    return missing
