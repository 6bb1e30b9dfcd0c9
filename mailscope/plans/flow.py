"""Who writes to whom, by status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.functions.labels import relabel

PAIR = ("status_sender", "status_recipient")


def flow_daily(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Rows per day between merged statuses, where both are known."""
    known = exchange.dropna(subset=list(PAIR)).select(
        "date", "year", *[relabel(F.col(c), config.status_groups).alias(c) for c in PAIR]
    )
    return known.groupBy("date", *PAIR, "year").agg(F.count("*").alias("number_exchange"))


def _between(flow: DataFrame, *keys: str) -> DataFrame:
    across = flow.where(F.col(PAIR[0]) != F.col(PAIR[1]))
    return across.groupBy(*keys, *PAIR).agg(F.sum("number_exchange").alias("sum"))


def flow_by_year(flow: DataFrame, year: int | None = None) -> DataFrame:
    """Yearly flow between different statuses."""
    chosen = flow if year is None else flow.where(F.col("year") == year)
    return _between(chosen, "year").orderBy("year", *PAIR)


def flow_all_years(flow: DataFrame) -> DataFrame:
    """Flow between different statuses over the whole period."""
    return _between(flow).orderBy(*PAIR)


def presence(flow: DataFrame, labels: list[str], year: int | None = None) -> DataFrame:
    """Which statuses wrote to which at all: one row per sender status, 0/1 per recipient status.

    The labels are named by the caller: finding them out would cost a job, and the columns would
    depend on the data.
    """
    chosen = flow if year is None else flow.where(F.col("year") == year)
    pairs = chosen.where(F.col(PAIR[0]) != F.col(PAIR[1])).select(*PAIR).distinct()
    return pairs.groupBy(PAIR[0]).pivot(PAIR[1], labels).count().na.fill(0, labels)
