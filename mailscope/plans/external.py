"""Exchanges without any internal address, and their subjects inside the organisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.functions.text import any_of, contains
from mailscope.operators.sharing import read_columns, read_whole
from mailscope.plans.topics import distinct_mails, long_topics, topic_sums

CONVERSATION = ["date", "subject"]


def internal_counts(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Internal senders and recipients per conversation, that is per day and subject."""
    return exchange.groupBy(*CONVERSATION).agg(
        F.count_if(contains(F.col("sender"), config.internal_pattern)).alias("sum_sender"),
        F.count_if(contains(F.col("recipient"), config.internal_pattern)).alias("sum_recipient"),
    )


def with_internal_counts(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Every row with the internal counts of its conversation.

    Counting first and joining back lets map tasks combine and lets adaptive execution split a
    conversation that holds much of the data; a window would sort it all in one task.
    """
    return exchange.join(internal_counts(exchange, config), CONVERSATION)


def chosen_columns(exchange: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns, all read by every use: counting conversations and taking their rows then share their inputs."""
    return read_columns(exchange.select(*columns))


def external_exchanges(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Rows of conversations without an internal address."""
    only = internal_counts(exchange, config).where((F.col("sum_sender") == 0) & (F.col("sum_recipient") == 0))
    return exchange.join(only.select(*CONVERSATION), CONVERSATION, "left_semi")


def internal_exchanges(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Rows of all other conversations."""
    other = internal_counts(exchange, config).where((F.col("sum_sender") != 0) | (F.col("sum_recipient") != 0))
    return exchange.join(other.select(*CONVERSATION), CONVERSATION, "left_semi")


def external_count(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Number of rows of external conversations, without joining back."""
    sized = exchange.groupBy(*CONVERSATION).agg(
        F.count("*").alias("rows"),
        F.count_if(
            contains(F.col("sender"), config.internal_pattern) | contains(F.col("recipient"), config.internal_pattern)
        ).alias("internal"),
    )
    return sized.agg(F.coalesce(F.sum(F.when(F.col("internal") == 0, F.col("rows"))), F.lit(0)).alias("n"))


def _company_mails(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Distinct external mails that name the company in subject or body.

    Whether they do follows from subject and body, so it is an aggregate of the mail: a condition on it stays above
    the grouping, and what is below is the same for other uses of the exchanges.
    """
    outside = external_exchanges(exchange, config)
    named = ["subject_company", "email_company"]
    mails = distinct_mails(outside, ["date", "year_month", "sender", "recipient"], config, named)
    return mails.where((F.col("subject_company") == 1) | (F.col("email_company") == 1))


def external_topics(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Topic sums per month, wide, of external mails that name the company."""
    return topic_sums(_company_mails(exchange, config), ["year_month"], config)


def external_topics_long(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    return long_topics(external_topics(exchange, config), ["year_month"], config)


def external_subjects(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Subjects naming the company in external mails, with the sums of their month, if it has a subject topic.

    Subjects and sums come from the same grouping by month and subject, so the mails are read once.
    """
    mails = _company_mails(exchange, config)
    sums = topic_sums(mails, ["year_month", "subject"], config, [F.max("subject_company").alias("subject_company")])
    subjects = read_whole(sums, config.topic_sums)
    months = subjects.groupBy("year_month").agg(*[F.sum(c).alias(c) for c in config.topic_sums])
    topical = months.where(any_of([F.col(c) for c in config.subject_sums]))
    chosen = subjects.where(F.col("subject_company") == 1).select(F.col("year_month").alias("month"), "subject")
    # Months are never missing; a plain equality would look for missing ones down to the messages, in this use only.
    return chosen.join(topical, F.col("month").eqNullSafe(F.col("year_month"))).drop("month")


def external_subject_overlap(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Internal rows whose subject is among :func:`external_subjects`; one row per month of the subject."""
    shown = ["date", "sender", "recipient", "subject", "text_key"]
    read = chosen_columns(exchange, [*shown, "year_month", "subject_company", "email_company", *config.topic_flags])
    return internal_exchanges(read, config).select(*shown).join(external_subjects(read, config), "subject")
