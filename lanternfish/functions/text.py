"""Text as Column expressions: words, tokens, windows, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space (a fixed value: what splits words).
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
TOKEN = r"[\p{L}\p{N}_]+"
PREVIEW_WORDS = 40


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def windows(words_: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of size words joined by spaces; empty for no words."""
    stride = size - overlap
    if stride < 1:
        raise ValueError(f"overlap ({overlap}) must be smaller than the window ({size})")
    starts = F.sequence(F.lit(0), F.size(words_) - 1, F.lit(stride))
    return F.when(F.size(words_) > 0, F.transform(starts, lambda s: F.array_join(F.slice(words_, s + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def preview(content: Column, most: int = PREVIEW_WORDS) -> Column:
    """The first words of content, with ... where the limit was reached."""
    first = F.slice(words(content), 1, most)
    return F.concat(F.array_join(first, " "), F.when(F.size(first) >= most, F.lit("...")).otherwise(F.lit("")))


def fingerprint(secret: Column, length: int = 12) -> Column:
    """A short digest that names a secret without giving it away."""
    return F.left(F.sha2(secret, 256), F.lit(length))


def text_id(*parts: Column) -> Column:
    """A reproducible 32-digit id of some columns; unlike uuid() it survives recomputation."""
    return F.left(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(32))
