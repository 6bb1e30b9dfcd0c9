"""How much is exchanged: key figures and volumes by period, status and address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.functions.text import contains
from mailscope.operators.cleaning import clean_employees
from mailscope.operators.describe import box_statistics, describe, in_range
from mailscope.operators.density import density
from mailscope.operators.rank import with_share
from mailscope.operators.significance import anova, group_moments, pairwise_t

Range = tuple[float, float] | None


def kpis(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """The key figures, one row.

    Five distinct counts side by side would copy every row five times. Rows are reduced to distinct
    exchanges instead, with and without their statuses, and the counts read off the reduced rows. The
    shares relate to direct exchanges, as published, so they can pass 100 %.
    """
    mail = ["sender", "recipient", "subject", "text_key"]
    is_direct = F.coalesce(F.col("rtype") == config.direct_rtype, F.lit(False))
    known = F.col("status_sender").isNotNull() | F.col("status_recipient").isNotNull()
    with_statuses = exchange.groupBy(*mail, "status_sender", "status_recipient").agg(F.max(is_direct).alias("direct"))
    mails = with_statuses.groupBy(*mail).agg(F.max("direct").alias("direct"), F.count_if(known).alias("known"))
    counts = mails.agg(
        F.count_distinct("sender").alias("senders"),
        F.count_distinct("recipient").alias("recipients"),
        F.count_if("direct").alias("direct_exchanges"),
        F.count_if(contains(F.col("subject"), config.reply_pattern)).alias("replies"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("known_status"),
    )
    direct = F.col("direct_exchanges")
    return counts.select(
        "*",
        F.round(F.try_divide(F.col("replies") * 100, direct), 2).alias("reply_pct"),
        F.round(F.try_divide(F.col("known_status") * 100, direct), 2).alias("known_status_pct"),
    )


def internal_pairs(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Number of distinct sender-recipient pairs with an internal address on either side."""
    internal = contains(F.col("sender"), config.internal_pattern) | contains(
        F.col("recipient"), config.internal_pattern
    )
    return exchange.where(internal).select("sender", "recipient").distinct().agg(F.count("*").alias("pairs"))


def generic_rows(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Number of rows with a shared mailbox, judged by its name, on either side."""
    generic = contains(F.col("sender"), config.generic_pattern) | contains(F.col("recipient"), config.generic_pattern)
    return exchange.agg(F.count_if(generic).alias("n"))


def external_share(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Distinct external addresses per side, as count and percent, in one row."""
    addresses = exchange.select("sender", "recipient").unpivot([], ["sender", "recipient"], "side", "address").distinct()
    external = ~contains(F.col("address"), config.internal_pattern)
    columns = []
    for side in ("sender", "recipient"):
        of_side = F.col("side") == side
        count = F.count_if(of_side & external)
        percent = F.round(F.try_divide(count, F.count_if(of_side)) * 100).cast("int")
        columns += [
            count.alias(f"sum_ext_{side}"),
            F.concat(percent.cast("string"), F.lit("%")).alias(f"pct_ext_{side}"),
        ]
    return addresses.agg(*columns)


def employee_status_share(employees: DataFrame, config: CorpusConfig, show_missing: bool = True) -> DataFrame:
    """Employees per status and their share, smallest first."""
    staff = clean_employees(employees, config).select("status")
    if not show_missing:
        staff = staff.where(F.col("status").isNotNull())
    return with_share(staff.groupBy("status").agg(F.count("*").alias("n"))).orderBy("perc", "status")


def monthly_volume(exchange: DataFrame) -> DataFrame:
    return exchange.groupBy("year", "month").agg(F.count("*").alias("n"))


def daily_volume(exchange: DataFrame, side: str) -> DataFrame:
    """Rows per day and known status of one side."""
    status = f"status_{side}"
    known = exchange.where(F.col(status).isNotNull())
    return known.groupBy("date", status).agg(F.count("*").alias("email_count"))


def daily_status_stats(exchange: DataFrame, side: str) -> DataFrame:
    return describe(daily_volume(exchange, side), [f"status_{side}"], "email_count")


def daily_status_box(exchange: DataFrame, side: str, value_range: Range = None) -> DataFrame:
    daily = in_range(daily_volume(exchange, side), "email_count", value_range)
    return box_statistics(daily, [f"status_{side}"], "email_count")


def daily_status_anova(exchange: DataFrame, side: str, value_range: Range = None) -> DataFrame:
    """Do the daily volumes differ between statuses? Axis limits, if given, apply before the test."""
    return anova(group_moments(daily_volume(exchange, side), f"status_{side}", "email_count", value_range))


def daily_status_pairwise(exchange: DataFrame, side: str) -> DataFrame:
    return pairwise_t(group_moments(daily_volume(exchange, side), f"status_{side}", "email_count"))


def daily_status_density(
    exchange: DataFrame, side: str, points: int = 512, value_range: Range = None
) -> DataFrame:
    return density(daily_volume(exchange, side), f"status_{side}", "email_count", points, value_range)


def monthly_status_volume(exchange: DataFrame, side: str, status: str | None = None) -> DataFrame:
    """Rows per status and month, of one status or of all."""
    column = F.col(f"status_{side}")
    kept = exchange.where(column.isNotNull() if status is None else column == status)
    return kept.groupBy(f"status_{side}", "year", "month").agg(F.count("*").alias("n"))


def yearly_status_stats(exchange: DataFrame, side: str) -> DataFrame:
    """Distinct mails per person and year, described per year and status."""
    status = f"status_{side}"
    mails = (
        exchange.where(F.col(status).isNotNull())
        .select("year", "sender", status, "subject", "text_key", "recipient")
        .distinct()
    )
    per_person = mails.groupBy("year", status, side).agg(F.count("*").alias("nb_email"))
    return describe(per_person, ["year", status], "nb_email", digits=2)
