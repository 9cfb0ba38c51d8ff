"""Scalar text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of licence lines.
LICENSE_PHRASES = ("permission is hereby granted", "without warranty", "mit license", "apache license", "all rights reserved", "copyright", "licensed under", "redistribution and use")


def count(text: str, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def lines(text: str) -> Column:
    """Newlines and one; 0 if empty."""
    return F.when(F.length(text) == 0, 0).otherwise(count(text, "\n") + 1).cast("long")


def estimated_tokens(text: str) -> Column:
    """floor(ascii/4 + 1.5 cjk + 3 emoji + other/2), 1 at least, 0 if empty."""
    ascii_, cjk, emoji = count(text, r"[\x{00}-\x{7F}]"), count(text, r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"), count(text, r"[\x{1F300}-\x{1FAFF}]")
    other = F.length(text) - ascii_ - cjk - emoji
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(ascii_ / 4 + cjk * 1.5 + emoji * 3 + other / 2))).cast("long")


def word_parts(name: str) -> Column:
    """Lower-case words of snake, camel and Pascal names and of phrases."""
    parted = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(parted), "[^a-z0-9]+"), lambda w: w != "")


def is_license(line: str) -> Column:
    return F.rlike(F.lower(line), F.lit("|".join(LICENSE_PHRASES)))


def normalized(line: str) -> Column:
    """Runs of blanks as one, ends trimmed."""
    return F.trim(F.regexp_replace(line, r"[ \t\r]+", " "))
