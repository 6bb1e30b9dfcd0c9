"""Small corpora with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and word train model token data paper river stone green seven light under table cloud" .split()


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    made = [pick.choice(WORDS) + "".join(pick.choice("aeiourstln") for _ in range(pick.randint(0, 4))) for _ in range(words)]
    return " ".join(w if (i + 1) % 11 else w + ".\n" for i, w in enumerate(made)).replace("\n ", "\n")


def awkward() -> list[tuple]:
    """Null, empty and blank texts, nulls in every column, repeated rows, a long text, odd characters."""
    long = prose(99, 30_000)
    texts = [
        (1, prose(1, 120), "en", "a"), (2, None, "en", "a"), (3, "", "de", "b"), (4, " \n\t ", None, "b"), (5, "one", "fr", None),
        (6, prose(6, 80), None, None), (6, prose(6, 80), None, None), (None, prose(7, 60), "en", "c"), (None, None, None, None),
        (8, long, "de", "a"), (9, "é́ ñ x 日本 \U0001f600 ok", "es", "c"), (10, prose(1, 120), "en", "a"),
        (11, "12 34 !!", "en", "b"), (12, prose(12, 55) + "\n" + prose(12, 55), "fr", "b"), (-5, prose(13, 90), "fr", "z"),
    ]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


def corpus(spark, rows=None, **extra):
    """A frame of documents; `extra` adds columns, to clash with names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, DOCUMENTS)
    return df.withColumns({name: F.lit(value) for name, value in extra.items()}) if extra else df


#: Names that operators use inside.
CLASHES = {
    "size": 1, "src": 2, "start": "x", "fp": 3, "row": 4, "it": 5, "_q": 6, "_s": 7, "key": 8, "shard": "y", "target": 9,
    "_words": 1, "_linked": 2, "node": 3, "component": 4, "kept": True, "score": 0.5, "held_out": False, "first": 1,
}
