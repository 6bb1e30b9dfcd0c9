"""Mails of a shortlist of persons, each under several addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.functions.labels import relabel
from mailscope.functions.text import contains
from mailscope.operators.describe import describe
from mailscope.plans.topics import topic_groups_long, topic_mails


def person_column(side: str) -> str:
    return f"email_label_{side}"


def person_label(side: str, config: CorpusConfig) -> F.Column:
    """The label of a row's address if it is on the shortlist, NULL otherwise; an address without one is its own."""
    label = relabel(F.col(side), config.persons.get(side, {}))
    return F.when(contains(F.col(side), config.person_shortlist), label)


def person_mails(exchange: DataFrame, side: str, config: CorpusConfig) -> DataFrame:
    """Distinct mails of the shortlist, with the person's label; an address without one is its own."""
    listed = exchange.where(contains(F.col(side), config.person_shortlist))
    return topic_mails(listed, side, config).withColumn(person_column(side), person_label(side, config))


def person_year_stats(exchange: DataFrame, side: str, config: CorpusConfig) -> DataFrame:
    """Distinct subject-body pairs per person and year, described per person."""
    person = person_column(side)
    pairs = person_mails(exchange, side, config).select("year", person, "subject", "text_key").distinct()
    yearly = pairs.groupBy("year", person).agg(F.count("*").alias("nb_email"))
    return describe(yearly, [person], "nb_email", digits=2)


def person_monthly(exchange: DataFrame, side: str, config: CorpusConfig, person: str | None = None) -> DataFrame:
    """Mails per person and month."""
    column = person_column(side)
    mails = person_mails(exchange, side, config)
    if person is not None:
        mails = mails.where(F.col(column) == person)
    return mails.groupBy(column, "year", "month").agg(F.count("*").alias("n"))


def person_topics(
    exchange: DataFrame, side: str, config: CorpusConfig, person: str | None = None, **choice
) -> DataFrame:
    """Topic sums per month and person, long."""
    return topic_groups_long(person_mails(exchange, side, config), person_column(side), config, person, **choice)
