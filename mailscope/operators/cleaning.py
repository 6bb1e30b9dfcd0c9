"""Cleaning steps on the source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig


def clean_employees(employees: DataFrame, config: CorpusConfig) -> DataFrame:
    """Turn the missing-status sentinel into NULL and leave out the unused alias columns."""
    return employees.withColumn("status", F.nullif("status", F.lit(config.missing_status))).drop("email2", "email4")


def in_period(date: Column, config: CorpusConfig) -> Column:
    return date.between(F.lit(config.period_start), F.lit(config.period_end))


def clean_messages(messages: DataFrame, config: CorpusConfig) -> DataFrame:
    """Keep the messages of the study period; ``message_id`` repeats ``mid`` and goes."""
    return messages.where(in_period(F.col("date"), config)).drop("message_id")


def complete_messages(messages: DataFrame) -> DataFrame:
    """Leave out messages without sender, subject or date."""
    return messages.dropna(subset=["sender", "subject", "date"])


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def share(value: Column, total: Column, digits: int | None = None) -> Column:
    fraction = value / total
    return fraction if digits is None else F.round(fraction, digits)
