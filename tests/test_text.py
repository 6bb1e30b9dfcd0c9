from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from mailscope.functions import text

TEXTS = ["", "aaa", "the cat and the hat", "naïve – 10-K", "SEC sec", "a.b", "RE: x", " two words\n", "aab aab", None]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "t string")


@pytest.mark.parametrize("pattern", ["the|and", "aa", "10-K|ï", "a.b", "^RE:", "SEC|fear", "a|", "–", "[0-9]", "1[0-9]"])
def test_matches_as_a_regular_expression(df, pattern):
    found = df.select("t", text.contains(F.col("t"), pattern), text.flag(F.col("t"), pattern)).collect()
    for t, hit, flag in found:
        expected = None if t is None else re.search(pattern, t) is not None
        assert hit == expected and flag == (None if t is None else int(expected))


@pytest.mark.parametrize("pattern", ["aa", "the", "ï", "a|the", "[a-c]"])
def test_counts_as_a_regular_expression(df, pattern):
    for t, n in df.select("t", text.occurrences(F.col("t"), pattern)).collect():
        assert n == (None if t is None else len(re.findall(pattern, t)))


def test_plain_words_need_no_regular_expression():
    assert text.literals("deal|losing money|10-K|deal") == ["deal", "losing money", "10-K"]
    assert text.literals("jeff.x|y") is None and text.literals("a||b") is None and text.literals("1[0-9]$") is None


def test_words_and_positions(df):
    rows = df.select("t", text.word_count(F.col("t")), text.first_position(F.col("t"), "b")).collect()
    assert {r[0]: r[1] for r in rows} == {
        "": 0, "aaa": 1, "the cat and the hat": 5, "naïve – 10-K": 3, "SEC sec": 2, "a.b": 1, "RE: x": 2,
        " two words\n": 2, "aab aab": 2, None: None,
    }
    assert {r[0]: r[2] for r in rows if r[2]} == {"a.b": 3, "aab aab": 3}
