"""Resolving addresses to staff through several alias columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig

ALIAS_COLUMNS = ("email_id", "email2", "email3", "email4")


def _usable(address: Column) -> Column:
    return address.isNotNull() & (address != "")


def _alias(employees: DataFrame, column: str, config: CorpusConfig, *extra: str) -> DataFrame:
    aliases = employees.select(F.col(column).alias("address"), *extra)
    return aliases if config.match_blank else aliases.where(_usable(F.col("address")))


def same_address(left: Column, right: Column, config: CorpusConfig) -> Column:
    """Address equality; with ``match_blank`` a missing address equals a missing one."""
    return left.eqNullSafe(right) if config.match_blank else left == right


def status_directory(employees: DataFrame, config: CorpusConfig) -> DataFrame:
    """``(address, status)``: the status by primary address, else by third address.

    One lookup in it gives the same rows as a lookup by primary address followed by one by third
    address and a coalesce, repeated aliases included, so the large side is joined once, not twice.
    """
    primary = _alias(employees, "email_id", config, "status").alias("p")
    third = _alias(employees, "email3", config, "status").alias("t")
    return primary.join(third, same_address(F.col("p.address"), F.col("t.address"), config), "full").select(
        F.coalesce("p.address", "t.address").alias("address"), F.coalesce("p.status", "t.status").alias("status")
    )


def counted_directory(employees: DataFrame, config: CorpusConfig) -> DataFrame:
    """``(address, status, copies)``: :func:`status_directory` with equal rows counted and never written out.

    Where missing addresses match each other, half of all aliases meet under one key, and the directory has as many rows
    of it as there are pairs. Counted by status first, a key has a row per pair of statuses at most.
    """
    sides = []
    for name, column in (("p", "email_id"), ("t", "email3")):
        held = _alias(employees, column, config, "status").groupBy("address", "status")
        sides.append(held.agg(F.count("*").alias("copies")).alias(name))
    met = sides[0].join(sides[1], same_address(F.col("p.address"), F.col("t.address"), config), "full").select(
        F.coalesce("p.address", "t.address").alias("address"), F.coalesce("p.status", "t.status").alias("status"),
        (F.coalesce("p.copies", F.lit(1)) * F.coalesce("t.copies", F.lit(1))).alias("copies"),
    )
    return met.groupBy("address", "status").agg(F.sum("copies").alias("copies"))


def with_status(
    df: DataFrame, address: str, directory: DataFrame, output: str, config: CorpusConfig, copies: str | None = None
) -> DataFrame:
    """Left-join the status of ``address`` as ``output``, and of a counted directory the number of rows as ``copies``.

    No broadcast is forced: the staff list grows with the organisation. Spark broadcasts it when its
    size is below the threshold; otherwise the join shuffles, and adaptive execution splits the
    partition of a dominant address.
    """
    lookup = directory.select(
        F.col("address").alias("_address"), F.col("status").alias(output), *([F.col("copies").alias(copies)] if copies else [])
    )
    found = df.join(lookup, same_address(F.col(address), F.col("_address"), config), "left").drop("_address")
    return found.withColumn(copies, F.coalesce(copies, F.lit(1))) if copies else found


#: Copies of a row that one task writes one after the other; more are spread.
COPIES = 1024


def replicated(df: DataFrame, copies: Column, key: str) -> DataFrame:
    """Every row as many times as ``copies`` says. Rows of very many copies go out from many tasks, by ``key`` and salt."""
    counted = df.withColumn("_copies", copies)
    many = counted.where(F.col("_copies") > COPIES).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {COPIES}")))
    )
    rest = F.least(F.lit(COPIES), F.col("_copies") - F.col("_salt") * COPIES)
    spread = many.withColumn("_copies", rest).repartition(key, "_salt").drop("_salt")
    both = counted.where(F.col("_copies").between(1, COPIES)).unionAll(spread)
    times = F.sequence(F.lit(1), F.col("_copies").cast("int"))
    return both.withColumn("_copy", F.explode(times)).drop("_copy", "_copies")


def alias_counts(
    employees: DataFrame, config: CorpusConfig, columns: Sequence[str] = ALIAS_COLUMNS
) -> DataFrame:
    """Per address, how many staff rows carry it in each alias column, and how many of these with a status."""
    long = employees.select("status", *columns).unpivot("status", list(columns), "alias_column", "address")
    if not config.match_blank:
        long = long.where(_usable(F.col("address")))
    held = {c: F.col("alias_column") == c for c in columns}
    return long.groupBy("address").agg(
        *[F.count_if(held[c]).alias(f"n_{c}") for c in columns],
        *[F.count_if(held[c] & F.col("status").isNotNull()).alias(f"known_{c}") for c in columns],
    )
