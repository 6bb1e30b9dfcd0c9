"""The most active addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.operators.rank import first_rows, first_value, top, with_share

EXCHANGE_KEY = ("sender", "subject", "recipient")


def _top_with_share(mails: DataFrame, address: str, k: int, digits: int) -> DataFrame:
    counts = mails.groupBy(address).agg(F.count("*").alias("n"))
    return with_share(top(counts, k, address), of=counts, digits=digits, label_digits=digits - 2)


def top_senders(exchange: DataFrame, k: int = 10, digits: int = 3) -> DataFrame:
    """Addresses with most distinct exchanges sent, and their share of all."""
    return _top_with_share(exchange.select(*EXCHANGE_KEY).distinct(), "sender", k, digits)


def top_recipients_filter_first(exchange: DataFrame, config: CorpusConfig, k: int = 10, digits: int = 4) -> DataFrame:
    """Direct recipients of most distinct exchanges, among direct ones."""
    direct = exchange.where(F.col("rtype") == config.direct_rtype)
    return _top_with_share(direct.select(*EXCHANGE_KEY).distinct(), "recipient", k, digits)


def top_recipients_dedupe_first(exchange: DataFrame, config: CorpusConfig, k: int = 10, digits: int = 3) -> DataFrame:
    """The same with exchanges reduced first: one counts if its first row is a direct one."""
    is_direct = F.coalesce(F.col("rtype") == config.direct_rtype, F.lit(False))
    direct = first_value(exchange, EXCHANGE_KEY, is_direct, "rid").where("first")
    return _top_with_share(direct, "recipient", k, digits)


def first_exchanges(exchange: DataFrame) -> DataFrame:
    """The first row of each sender, subject and recipient, with the key of its body."""
    columns = ["rid", "date", "year", "month", "status_sender", "rtype", "status_recipient", "text_key"]
    return first_rows(exchange.select(*EXCHANGE_KEY, *columns), EXCHANGE_KEY, "rid")


def address_status(exchange: DataFrame, address: str) -> DataFrame:
    """The status of one sender address, one row."""
    return exchange.where(F.col("sender") == address).agg(F.max("status_sender").alias("status_sender"))
