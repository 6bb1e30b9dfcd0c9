"""What counts as a word in all operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is the space and the five control characters from tab to carriage return, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as LONG; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
