"""One address against its status group and against everyone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.operators.describe import box_statistics, describe, in_range
from mailscope.operators.density import density
from mailscope.operators.sharing import read_whole
from mailscope.operators.significance import group_moments, welch_t

Range = tuple[float, float] | None

EVERYONE = "All"


def _status_source(config: CorpusConfig) -> str:
    return f"{config.focus_status} status"


def _sources(*entries: tuple[F.Column, F.Column]) -> F.Column:
    """Rows ``(source, email_count)`` of the entries whose count is positive."""
    rows = F.array(*[F.struct(s.alias("source"), n.alias("email_count")) for s, n in entries])
    return F.inline(F.filter(rows, lambda r: r["email_count"] > 0))


def _counts(exchange: DataFrame, side: str, config: CorpusConfig, *keys: str) -> DataFrame:
    """All rows, and those of the status group, per day and address."""
    in_status = F.col(f"status_{side}") == config.focus_status
    counts = exchange.groupBy("date", side, *keys).agg(F.count("*").alias("n"), F.count_if(in_status).alias("n_status"))
    return read_whole(counts, ["n", "n_status"])


def sent_counts(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """``(source, date, subject, email_count)``: rows per day, sender and subject.

    The three groups overlap, so each count is made once and handed to every group it belongs to.
    """
    counts = _counts(exchange, "sender", config, "subject")
    focus = F.when(F.col("sender") == config.focus_address, F.col("n")).otherwise(0)
    return counts.select(
        "date",
        "subject",
        _sources(
            (F.lit(config.focus_label), focus),
            (F.lit(_status_source(config)), F.col("n_status")),
            (F.lit(EVERYONE), F.col("n")),
        ),
    )


def received_counts(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """``(source, date, email_count)``: rows per day and recipient, but per day only for the status group."""
    counts = _counts(exchange, "recipient", config)
    focus = F.when(F.col("recipient") == config.focus_address, F.col("n")).otherwise(0)
    persons = counts.select("date", _sources((F.lit(config.focus_label), focus), (F.lit(EVERYONE), F.col("n"))))
    group = (
        counts.groupBy("date")
        .agg(F.sum("n_status").alias("email_count"))
        .where(F.col("email_count") > 0)
        .withColumn("source", F.lit(_status_source(config)))
    )
    return persons.unionByName(group)


def side_counts(exchange: DataFrame, side: str, config: CorpusConfig) -> DataFrame:
    return (sent_counts if side == "sender" else received_counts)(exchange, config)


def compare_stats(exchange: DataFrame, side: str, config: CorpusConfig) -> DataFrame:
    return describe(side_counts(exchange, side, config), ["source"], "email_count")


def compare_box(exchange: DataFrame, side: str, config: CorpusConfig, value_range: Range = None) -> DataFrame:
    counts = in_range(side_counts(exchange, side, config), "email_count", value_range)
    return box_statistics(counts, ["source"], "email_count")


def compare_welch(exchange: DataFrame, side: str, config: CorpusConfig, value_range: Range = None) -> DataFrame:
    """t-tests of the address against its status group and against everyone."""
    moments = group_moments(side_counts(exchange, side, config), "source", "email_count", value_range)
    return welch_t(moments, config.focus_label)


def compare_density(
    exchange: DataFrame, side: str, config: CorpusConfig, points: int = 512, value_range: Range = None
) -> DataFrame:
    return density(side_counts(exchange, side, config), "source", "email_count", points, value_range)
