"""Topics in subjects and bodies: flags, monthly sums, and their statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.functions.text import any_of
from mailscope.operators.cleaning import month_start
from mailscope.operators.describe import describe, describe_weighted


def distinct_mails(
    rows: DataFrame, by: Sequence[str], config: CorpusConfig, more_flags: Sequence[str] = ()
) -> DataFrame:
    """Distinct combinations of ``by``, subject and body with their topic flags, and ``more_flags`` of the kind.

    Bodies stay out: their key tells them apart. The flags depend on subject and body alone, so they are
    picked up by an aggregate rather than grouped by; where nobody reads them, no text is searched.
    """
    flags = [F.max(flag).alias(flag) for flag in [*config.topic_flags, *more_flags]]
    return rows.groupBy(*by, "subject", "text_key").agg(*flags)


def topic_mails(exchange: DataFrame, side: str, config: CorpusConfig) -> DataFrame:
    """Distinct mails of one side with their topic flags."""
    status = f"status_{side}"
    return distinct_mails(exchange, ["date", side, status], config).select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        month_start(F.col("date")).alias("year_month"),
        side, status, "subject", "text_key", *config.topic_flags,
    )


def topic_sums(
    mails: DataFrame, by: Sequence[str], config: CorpusConfig, more: Sequence[F.Column] = ()
) -> DataFrame:
    """Mails per topic and group, and ``more`` aggregates; the sum over nothing but NULLs is 0."""
    sums = [F.coalesce(F.sum(flag), F.lit(0)).alias(f"sum_{flag}") for flag in config.topic_flags]
    return mails.groupBy(*by).agg(*sums, *more)


def any_topic(config: CorpusConfig) -> F.Column:
    return any_of([F.col(c) for c in config.topic_sums])


def long_topics(sums: DataFrame, by: Sequence[str], config: CorpusConfig) -> DataFrame:
    return sums.unpivot(list(by), config.topic_sums, "topic_email", "value")


def select_topics(
    long: DataFrame,
    config: CorpusConfig,
    start: dt.date | None = None,
    end: dt.date | None = None,
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Months from ``start`` to ``end``, both included, and topics by their display label."""
    if start is not None:
        long = long.where(F.col("year_month") >= F.lit(start))
    if end is not None:
        long = long.where(F.col("year_month") <= F.lit(end))
    if labels is not None:
        long = long.where(F.col("topic_email").isin(config.topics_labelled(list(labels))))
    return long


def monthly_distinct_mails(exchange: DataFrame, side: str, config: CorpusConfig) -> DataFrame:
    mails = topic_mails(exchange, side, config)
    return mails.groupBy("year_month").agg(F.count("*").alias("nb_email"))


def topic_months(exchange: DataFrame, side: str, config: CorpusConfig) -> DataFrame:
    """Topic sums per month, wide, of months with any topic at all."""
    return topic_sums(topic_mails(exchange, side, config), ["year_month"], config).where(any_topic(config))


def topic_months_long(exchange: DataFrame, side: str, config: CorpusConfig, **choice) -> DataFrame:
    long = long_topics(topic_months(exchange, side, config), ["year_month"], config)
    return select_topics(long, config, **choice)


def topic_groups_long(
    mails: DataFrame, group: str, config: CorpusConfig, value: str | None = None, **choice
) -> DataFrame:
    """Topic sums per month and group, long; of one group value when given."""
    kept = mails.where(F.col(group).isNotNull() if value is None else F.col(group) == value)
    by = ["year_month", group]
    return select_topics(long_topics(topic_sums(kept, by, config), by, config), config, **choice)


def topic_status_long(
    exchange: DataFrame, side: str, config: CorpusConfig, status: str | None = None, **choice
) -> DataFrame:
    return topic_groups_long(topic_mails(exchange, side, config), f"status_{side}", config, status, **choice)


def topic_year_stats(exchange: DataFrame, config: CorpusConfig, side: str = "sender") -> DataFrame:
    """Statistics per year of the monthly topic sums, long.

    A month counts as often as it has distinct subject-body pairs. That number and the sums come
    from one grouping; the weighted statistics then run on one row per month.
    """
    mails = topic_mails(exchange, side, config)
    weight = F.count_distinct(F.struct("subject", "text_key")).alias("pairs")
    sums = [F.coalesce(F.sum(flag), F.lit(0)).alias(f"sum_{flag}") for flag in config.topic_flags]
    months = mails.groupBy("year", "year_month").agg(weight, *sums)
    stats = describe_weighted(months, ["year"], config.topic_sums, "pairs", digits=2).drop("n")
    return stats.unpivot(["year"], [c for c in stats.columns if c != "year"], "topics", "values")


def word_count_stats(exchange: DataFrame) -> DataFrame:
    """Words per distinct body-subject pair: statistics of both lengths, and bodies missing."""
    pairs = exchange.select("text_key", "subject", "email_words", "subject_words").distinct()
    long = pairs.unpivot([], ["email_words", "subject_words"], "text", "words")
    return describe(long.withColumn("n_missing", F.col("words").isNull()), ["text"], "words", extra=["n_missing"])


def body_share(exchange: DataFrame) -> DataFrame:
    """Rows with a body, and their share of all rows in percent."""
    held = F.count_if(F.col("text_key").isNotNull())
    return exchange.agg(held.alias("n"), (F.try_divide(held, F.count("*")) * 100).alias("pct"))
