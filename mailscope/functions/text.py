"""Text predicates and counts, built on Spark's own regular expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters outside the Unicode separator class and the ASCII line controls.
WORD_PATTERN = r"[^\t\n\f\r\p{Z}]+"


SPECIAL = re.compile(r"[.^$*+?()\[\]{}\\]")


def literals(pattern: str) -> list[str] | None:
    """The alternatives of a pattern made of plain words, None for any other pattern."""
    words = list(dict.fromkeys(pattern.split("|")))
    return words if all(words) and not SPECIAL.search(pattern) else None


def contains(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs anywhere; NULL for NULL text.

    Plain words are looked up one by one in the stored bytes, up to the first hit. A regular expression
    would first decode the text and then try every alternative at every position.
    """
    words = literals(pattern)
    if words is None:
        return F.rlike(text, F.lit(pattern))
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def flag(text: Column, pattern: str) -> Column:
    """1 / 0 for a match, NULL for NULL text (a CASE expression would turn NULL into 0)."""
    return contains(text, pattern).cast("int")


def occurrences(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches."""
    words = literals(pattern)
    if words is None or len(words) > 1:
        return F.regexp_count(text, F.lit(pattern))
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(words[0]), F.lit("")))
    return (removed / len(words[0].encode())).cast("int")


def first_position(text: Column, pattern: str) -> Column:
    """1-based start of the first match, NULL when there is none."""
    return F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0))


def word_count(text: Column) -> Column:
    return occurrences(text, WORD_PATTERN)


def strip_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def text_key(text: Column) -> Column:
    """A fixed-width stand-in for a long body in grouping keys; NULL stays NULL."""
    return F.sha2(text, 256)


def any_of(columns: Sequence[Column]) -> Column:
    """Whether at least one of several non-negative numbers is above zero; NULLs count as zero."""
    return F.greatest(*[F.coalesce(c, F.lit(0)) for c in columns], F.lit(0)) > 0
