"""Tables prepared once and shared by analyses: counts by year that can be refreshed year by year, and sources laid out
for their joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.operators.aliases import counted_directory, status_directory
from mailscope.operators.cleaning import clean_employees
from mailscope.plans.topics import topic_mails, topic_sums
from mailscope.sources.tables import Sources

# --- counts by year

SIDES = ("sender", "recipient")


def daily_counts(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Rows per day and pair of statuses; sums of them are the daily volumes of either side."""
    return exchange.groupBy("year", "date", "status_sender", "status_recipient").agg(F.count("*").alias("n"))


def _topic_counts(side: str) -> Callable[[DataFrame, CorpusConfig], DataFrame]:
    def counts(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
        """Distinct mails and topic sums per month and status. Mails are distinct by day, so months and years add up."""
        by = ["year", "year_month", f"status_{side}"]
        return topic_sums(topic_mails(exchange, side, config), by, config, [F.count("*").alias("n")])

    return counts


#: Name and content of each table; all have `year` and a count `n`.
TABLES: dict[str, Callable[[DataFrame, CorpusConfig], DataFrame]] = {
    "daily": daily_counts, **{f"topics_{side}": _topic_counts(side) for side in SIDES},
}


def save_counts(exchange: DataFrame, config: CorpusConfig, path: str, years: Sequence[int] | None = None) -> None:
    """Write the tables, by year; with ``years``, only these, computed from their rows only and put in place of the old.

    An empty row of each of these years goes along, so that what is left of a year without rows is nothing.
    """
    rows = exchange if years is None else exchange.where(F.col("year").isin(list(years)))
    for name, counted in TABLES.items():
        table = counted(rows, config)
        if years is not None:
            empty = exchange.sparkSession.createDataFrame([(int(y), 0) for y in years], "year int, n long")
            table = table.unionByName(empty, allowMissingColumns=True)
        write = table.write.mode("overwrite").option("partitionOverwriteMode", "static" if years is None else "dynamic")
        write.partitionBy("year").parquet(f"{path}/{name}")


def saved_counts(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").where("n > 0")


def saved_daily_volume(daily: DataFrame, side: str) -> DataFrame:
    """:func:`mailscope.plans.volume.daily_volume` from the saved counts."""
    status = f"status_{side}"
    known = daily.where(F.col(status).isNotNull())
    return known.groupBy("date", status).agg(F.sum("n").alias("email_count"))


def saved_topic_months(topics: DataFrame, config: CorpusConfig) -> DataFrame:
    """:func:`mailscope.plans.topics.topic_sums` per month, from the saved counts of one side."""
    return topics.groupBy("year_month").agg(*[F.sum(c).alias(c) for c in config.topic_sums])


# --- sources laid out for their joins

BUCKETED = ("messages", "recipients", "references")


def save_bucketed(sources: Sources, config: CorpusConfig, prefix: str, path: str, buckets: int) -> None:
    """Save the sources as tables named ``prefix_…`` under ``path``, bucketed and sorted by ``mid``, and with them the status
    directory, so that lookups need no join of the staff list with itself."""
    for name in BUCKETED:
        write = getattr(sources, name).write.mode("overwrite").bucketBy(buckets, "mid").sortBy("mid")
        write.option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")
    directory = counted_directory if config.match_blank else status_directory
    for name, table in (("employees", sources.employees), ("directory", directory(clean_employees(sources.employees, config), config))):
        table.write.mode("overwrite").option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")


def bucketed_sources(spark: SparkSession, prefix: str) -> tuple[Sources, DataFrame]:
    """The saved sources and the saved directory, for ``build_exchange(sources, config, directory, co_located=True)``.

    Joins on ``mid`` then read matching buckets; where the directory is small enough for Spark to broadcast it, nothing is
    shuffled at all. A hot ``mid`` stays in its bucket: lay sources out so only where messages have few recipients each.
    """
    tables = {name: spark.table(f"{prefix}_{name}") for name in (*BUCKETED, "employees")}
    return Sources(**tables), spark.table(f"{prefix}_directory")
