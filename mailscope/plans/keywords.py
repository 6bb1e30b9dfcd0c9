"""How often the searched words occur in subjects and bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.functions import text
from mailscope.sources.tables import Sources


def _by_word(df: DataFrame, by: Sequence[str], counts: Sequence[F.Column], config: CorpusConfig) -> DataFrame:
    """Sum one column per word in a single pass, then turn the sums into rows ``(position, word, freq)``."""
    sums = df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"w{i}") for i, c in enumerate(counts)])
    rows = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(word).alias("word"), F.col(f"w{i}").alias("freq"))
        for i, word in enumerate(config.words)
    ]
    return sums.select(*by, F.inline(F.array(*rows)))


def subject_frequency(pairs: DataFrame, by: Sequence[str], config: CorpusConfig) -> DataFrame:
    """Occurrences of each word in the subjects of distinct pairs; an equal subject is searched once."""
    subjects = pairs.groupBy(*by, "subject").agg(F.count("*").alias("n"))
    counts = [F.col("n") * text.occurrences(F.col("subject"), word) for word in config.words]
    return _by_word(subjects, by, counts, config)


def word_hits(sources: Sources, config: CorpusConfig) -> DataFrame:
    """Which words each body contains: ``(text_key, hits)``. The bodies themselves never move."""
    body = F.col("reference")
    hits = F.array(*[text.contains(body, word) for word in config.words])
    found = sources.references.where(body.isNotNull())
    return found.select(text.text_key(body).alias("text_key"), hits.alias("hits")).distinct()


def text_frequency(pairs: DataFrame, by: Sequence[str], sources: Sources, config: CorpusConfig) -> DataFrame:
    """Distinct pairs whose body contains each word, times the weight of a body hit.

    The published counts find start and end of a match and count both, hence a weight of 2. The join
    keeps the one row without a body, which counts nothing: an inner join would push a filter into
    ``pairs`` and so keep its shuffle from being shared with the subjects.
    """
    bodies = pairs.groupBy(*by, "text_key").agg(F.count("*").alias("n"))
    weighted = bodies.join(word_hits(sources, config), "text_key", "left")
    counts = [
        F.when(F.col("hits")[i], F.col("n") * config.text_hit_weight).otherwise(0) for i in range(len(config.words))
    ]
    return _by_word(weighted, by, counts, config)


def total_frequency(pairs: DataFrame, by: Sequence[str], sources: Sources, config: CorpusConfig) -> DataFrame:
    """Subject and body frequencies added up, one row per position in the word list."""
    both = subject_frequency(pairs, by, config).unionByName(text_frequency(pairs, by, sources, config))
    return both.groupBy(*by, "position", "word").agg(F.sum("freq").alias("freq"))


def monthly_pairs(exchange: DataFrame) -> DataFrame:
    """Distinct subject-body pairs per month; whose mails they are makes no difference."""
    return exchange.select("year_month", "subject", "text_key").distinct()


def keyword_subject(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    return subject_frequency(monthly_pairs(exchange), [], config)


def keyword_text(exchange: DataFrame, sources: Sources, config: CorpusConfig) -> DataFrame:
    return text_frequency(monthly_pairs(exchange), [], sources, config)


def keyword_positions(sources: Sources, config: CorpusConfig) -> DataFrame:
    """Per word of the list: bodies that have it, and where it first occurs, on average and at the earliest; one pass."""
    body, words = F.col("reference"), list(dict.fromkeys(config.words))
    places = [F.struct(F.lit(w).alias("word"), text.first_position(body, w).alias("place")) for w in words]
    found = sources.references.where(body.isNotNull()).select(F.inline(F.array(*places)))
    return found.groupBy("word").agg(
        F.count("place").alias("n_bodies"), F.avg("place").alias("mean_first"), F.min("place").alias("earliest")
    )


def _topical(exchange: DataFrame, by: Sequence[str], config: CorpusConfig) -> DataFrame:
    """Distinct subject-body pairs per group, of months in which the group has any topic.

    A group's sums are not all zero exactly if one of its pairs has a flag set. Groups and rows come
    from one shuffled set of pairs, so the exchange table is read once.
    """
    months = ["year_month", *by]
    topical = text.any_of([F.col(flag) for flag in config.topic_flags]).cast("int").alias("topical")
    pairs = exchange.select(*months, "subject", "text_key", topical).distinct()
    active = pairs.groupBy(*months).agg(F.sum("topical").alias("flagged")).where(F.col("flagged") > 0)
    kept = pairs.alias("p").join(active.drop("flagged"), months)
    return kept.select(*by, "subject", "text_key").distinct()


def topical_pairs(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Distinct subject-body pairs of months with any topic; the same for both sides."""
    return _topical(exchange, [], config)


def keyword_total(exchange: DataFrame, sources: Sources, config: CorpusConfig) -> DataFrame:
    return total_frequency(topical_pairs(exchange, config), [], sources, config)


def topical_status_pairs(
    exchange: DataFrame, side: str, config: CorpusConfig, statuses: Sequence[str] | None = None
) -> DataFrame:
    """Distinct (status, subject, body) of months in which the status, one of those listed, has any topic."""
    status = f"status_{side}"
    return _topical(exchange.where(F.col(status).isin(list(statuses or config.statuses))), [status], config)


def keyword_status_total(
    exchange: DataFrame, side: str, sources: Sources, config: CorpusConfig, statuses: Sequence[str] | None = None
) -> DataFrame:
    pairs = topical_status_pairs(exchange, side, config, statuses)
    return total_frequency(pairs, [f"status_{side}"], sources, config)


def top_words(frequency: DataFrame, by: Sequence[str], k: int, config: CorpusConfig) -> DataFrame:
    """The k most frequent words of each group that reach the minimum frequency.

    A group has one row per position of the word list, which bounds the window.
    """
    frequent = frequency.where(F.col("freq") >= config.min_word_frequency)
    order = [F.desc("freq"), F.col("word"), F.col("position")]
    if not by:
        return frequent.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return frequent.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_top_status(
    exchange: DataFrame, side: str, sources: Sources, config: CorpusConfig, k: int = 10
) -> DataFrame:
    return top_words(keyword_status_total(exchange, side, sources, config), [f"status_{side}"], k, config)
