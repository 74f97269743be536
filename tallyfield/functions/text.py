"""Text normalisation and label formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for "missing" in name columns.
NULL_TOKENS = ("Nan", "None", "nan", "NONE", "")

# Fixed value: symbols removed from names.
SYMBOLS = "*?#@!"

# Indian digit groups as (lower bound, divisor, short suffix, spaced suffix).
DIGIT_GROUPS = (
    (1e7, 1e7, "Cr", " Cr"),
    (1e5, 1e5, "L", " L"),
    (1e3, 1e3, "K", " K"),
)

_BREAK = "\u0001 "
_SPACES = " \t\n\r\u000b\u000c"
_PLAIN = "abcdefghijklmnopqrstuvwxyz "
_DIGITS = "0123456789"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(_SPACES))


def only(c: Column, characters: str) -> Column:
    """True when a text holds nothing but the given characters."""
    return F.translate(c, characters, "") == ""


def title_case(c: Column) -> Column:
    """Capitalise every run of letters (``north-east`` -> ``North-East``).

    ``initcap`` starts a word only after a space, which settles plain names.
    In others a marker is put in front of every letter that follows a
    non-letter and taken out afterwards.
    """
    small = F.lower(c)
    marked = F.regexp_replace(small, r"([^\p{L}])(?=\p{L})", "$1" + _BREAK)
    return F.when(only(small, _PLAIN), F.initcap(small)).otherwise(
        F.replace(F.initcap(marked), F.lit(_BREAK), F.lit(""))
    )


def null_tokens(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Turn spellings of "missing" into null."""
    return F.when(~c.isin(*tokens), c)


def is_missing_name(c: Column, strict: bool = False) -> Column:
    """True when ``normalize_text`` gives null.

    Title-casing turns a text into a token exactly when its lower case is one,
    so rows can be tested before any name is rewritten.
    """
    tokens = sorted({t.lower() for t in NULL_TOKENS})
    bare = strip(F.lower(c))
    missing = c.isNull() | bare.isin(*tokens)
    if strict:
        missing = missing | strip(F.translate(bare, SYMBOLS, "")).isin(*tokens)
    return missing


def normalize_text(c: Column, strict: bool = False) -> Column:
    """Trim, title-case, null the missing tokens, then drop symbols and trim.

    Tokens are tested before symbols go, so ``'*'`` ends as an empty string;
    ``strict=True`` tests them once more at the end.
    """
    return F.when(
        ~is_missing_name(c, strict), strip(F.translate(title_case(strip(c)), SYMBOLS, ""))
    )


def valid_pincode(c: Column) -> Column:
    """Keep exactly six digits, otherwise null."""
    trimmed = strip(c)
    return F.when((F.length(trimmed) == 6) & only(trimmed, _DIGITS), trimmed)


def is_numeric_name(c: Column) -> Column:
    """True for names that are only digits once dots are removed."""
    return F.regexp_replace(c, r"\.", "").rlike("^[0-9]+$")


def format_indian(c: Column, decimals: int = 1, spaced: bool = False) -> Column:
    """Format with Indian digit groups: ``12.3K``, ``4.5L``, ``1.2Cr``."""
    out = F.format_string("%.0f", c.cast("double"))
    for bound, divisor, short, wide in reversed(DIGIT_GROUPS):
        text = F.format_string(f"%.{decimals}f{wide if spaced else short}", c / F.lit(divisor))
        out = F.when(c >= F.lit(bound), text).otherwise(out)
    return out


def milestone_label(c: Column) -> Column:
    """Short label of a milestone: ``25M`` from a million up, else ``K``."""
    return F.when(c >= 1_000_000, F.format_string("%.0fM", c / F.lit(1e6))).otherwise(
        F.format_string("%.0fK", c / F.lit(1e3))
    )


def truncate_label(c: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(c, 1, n)
