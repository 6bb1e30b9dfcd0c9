"""Mails per active person, and how many persons are active, per day and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.operators.density import density
from mailscope.operators.describe import box_statistics, describe, describe_weighted
from mailscope.operators.sharing import read_whole
from mailscope.operators.significance import anova, weighted_moments


def sent_ratio(exchange: DataFrame) -> DataFrame:
    """Per day and sender status: rows sent, distinct senders, and their ratio."""
    known = exchange.where(F.col("status_sender").isNotNull())
    return (
        known.groupBy("date", "status_sender")
        .agg(F.count("*").alias("nb_send"), F.count_distinct("sender").alias("nb_sender_per_gp"))
        .withColumn("ratio_nb_email", F.col("nb_send") / F.col("nb_sender_per_gp"))
    )


def _received(exchange: DataFrame) -> DataFrame:
    """Rows per day, both statuses and recipient, of recipients with a status."""
    known = exchange.where(F.col("status_recipient").isNotNull())
    grouped = known.groupBy("date", "status_sender", "status_recipient", "recipient")
    return read_whole(grouped.agg(F.count("*").alias("n")), ["n"])


def received_ratio(exchange: DataFrame, by: str = "sender") -> DataFrame:
    """Rows received per distinct recipient, for each day, recipient status and recipient.

    The published figures group by the status of the sender, NULL included, and report by the
    status of the recipient; ``by="recipient"`` groups by the status reported. ``n`` counts rows.
    """
    received = _received(exchange)
    group = f"status_{by}"
    # Several recipient statuses can share a group, so persons are counted across them.
    ratio = received.groupBy("date", group).agg(
        F.sum("n").alias("nb_received"), F.count_distinct("recipient").alias("nb_received_per_gp")
    )
    left, right = received.alias("l"), ratio.alias("r")
    same = (F.col("l.date") == F.col("r.date")) & F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}"))
    return left.join(right, same).select(
        "l.date", "l.status_recipient", "l.recipient", "n", "nb_received", "nb_received_per_gp",
        (F.col("nb_received") / F.col("nb_received_per_gp")).alias("ratio_nb_email"),
    )


def per_person_ratio_stats(exchange: DataFrame, side: str, by: str = "sender") -> DataFrame:
    """Statistics of the ratio per status; each day weighs as often as it has active persons."""
    if side == "sender":
        # One row per day, status and sender would repeat the ratio once per distinct sender.
        return describe_weighted(sent_ratio(exchange), ["status_sender"], ["ratio_nb_email"], "nb_sender_per_gp")
    rows = received_ratio(exchange, by).drop("n").distinct()
    return describe(rows, ["status_recipient"], "ratio_nb_email")


def _ratio_rows(exchange: DataFrame, side: str, by: str) -> tuple[DataFrame, str]:
    """The ratio of every row, with equal rows of a status counted, and the column that counts them."""
    if side == "sender":
        return sent_ratio(exchange), "nb_send"
    counted = received_ratio(exchange, by).groupBy("status_recipient", "ratio_nb_email").agg(F.sum("n").alias("n"))
    return counted, "n"


def per_person_ratio_anova(exchange: DataFrame, side: str, by: str = "sender") -> DataFrame:
    """Analysis of variance of the ratio between statuses, over all rows."""
    rows, weight = _ratio_rows(exchange, side, by)
    return anova(weighted_moments(rows, f"status_{side}", "ratio_nb_email", weight))


def per_person_ratio_box(exchange: DataFrame, side: str, by: str = "sender") -> DataFrame:
    rows, weight = _ratio_rows(exchange, side, by)
    return box_statistics(rows, [f"status_{side}"], "ratio_nb_email", weight)


def per_person_ratio_density(exchange: DataFrame, side: str, points: int = 512, by: str = "sender") -> DataFrame:
    rows, weight = _ratio_rows(exchange, side, by)
    return density(rows, f"status_{side}", "ratio_nb_email", points, weight=weight)


def extreme_days(exchange: DataFrame, status: str, k: int | None = 10, ratio: float | None = None) -> DataFrame:
    """The senders of one status on its days of the highest ratio, or of one given ratio."""
    days = sent_ratio(exchange.where(F.col("status_sender") == status))
    if ratio is not None:
        days = days.where(F.col("ratio_nb_email") == ratio)
    elif k is not None:
        days = days.orderBy(F.desc("ratio_nb_email"), "date").limit(k)
    return days


def extreme_day_senders(exchange: DataFrame, status: str, k: int | None = 10, ratio: float | None = None) -> DataFrame:
    """As :func:`extreme_days`, with one row per sender active on such a day."""
    senders = exchange.where(F.col("status_sender") == status).select("date", "sender").distinct()
    return senders.join(extreme_days(exchange, status, k, ratio), "date").select(
        "date", "status_sender", "sender", "nb_send", "nb_sender_per_gp", "ratio_nb_email"
    )


def active_people(exchange: DataFrame) -> DataFrame:
    """Per side, day and status (NULL is a status here): rows and distinct persons."""
    both = exchange.select(
        "date",
        F.inline(
            F.array(
                F.struct(F.lit("sender").alias("side"), F.col("status_sender").alias("status"), F.col("sender").alias("person")),
                F.struct(F.lit("recipient").alias("side"), F.col("status_recipient").alias("status"), F.col("recipient").alias("person")),
            )
        ),
    )
    return both.groupBy("side", "date", "status").agg(
        F.count("*").alias("n"), F.count_distinct("person").alias("persons")
    )


def active_people_stats(exchange: DataFrame) -> DataFrame:
    """Active senders and recipients per day and status, described over all rows, in one row."""
    stats = describe_weighted(active_people(exchange), ["side"], ["persons"], "n")
    wanted = [
        F.max(F.when(F.col("side") == side, F.col(name))).alias(f"nb_{side}_per_group_{name}")
        for side in ("sender", "recipient")
        for name in ("mean", "median", "sd", "min", "q1", "q3", "max")
    ]
    return stats.agg(*wanted)


def _people_by_status(exchange: DataFrame, side: str) -> DataFrame:
    return active_people(exchange).where((F.col("side") == side) & F.col("status").isNotNull())


def active_people_by_status(exchange: DataFrame, side: str) -> DataFrame:
    """Active persons of one side, described per known status over all rows."""
    return describe_weighted(_people_by_status(exchange, side), ["status"], ["persons"], "n")


def active_people_box(exchange: DataFrame, side: str) -> DataFrame:
    return box_statistics(_people_by_status(exchange, side), ["status"], "persons", "n")


def active_people_density(exchange: DataFrame, side: str, points: int = 512) -> DataFrame:
    return density(_people_by_status(exchange, side), "status", "persons", points, weight="n")
