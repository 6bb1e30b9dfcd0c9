"""Profile of the four sources, and checks along the way to the exchange table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.operators.aliases import ALIAS_COLUMNS, alias_counts, same_address
from mailscope.operators.cleaning import clean_employees, clean_messages, complete_messages
from mailscope.operators.quantiles import column_quantiles
from mailscope.plans.people import person_label
from mailscope.sources.tables import Sources


def tables(sources: Sources) -> dict[str, DataFrame]:
    return {
        "employees": sources.employees,
        "messages": sources.messages,
        "recipients": sources.recipients,
        "references": sources.references,
    }


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def dimensions(sources: Sources) -> DataFrame:
    """Rows and columns of each source."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables(sources).items()
    ]
    return reduce(DataFrame.unionByName, parts)


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and NULLs per column, in one pass."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["n_rows"], list(columns), "column", "n_missing")


def all_missing_values(sources: Sources) -> DataFrame:
    """Type, rows and NULLs of every column of every source, one pass per source."""
    parts = []
    for name, df in tables(sources).items():
        kinds = F.create_map(*[F.lit(x) for kind in column_types(df).items() for x in kind])
        parts.append(missing_values(df, df.columns).select(
            F.lit(name).alias("table"), "column", kinds[F.col("column")].alias("type"), "n_rows", "n_missing"
        ))
    return reduce(DataFrame.unionByName, parts)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range, mean and exact quartiles of numeric columns, identifiers and fractions included.

    One pass for the simple figures of all columns, one per level of the quantiles.
    """
    figures = {
        "n": F.count, "n_missing": lambda c: F.count_if(F.col(c).isNull()), "min": lambda c: F.min(c).cast("double"),
        "mean": lambda c: F.avg(c).cast("double"), "max": lambda c: F.max(c).cast("double"),
    }
    wide = df.agg(*[F.struct(*[f(c).alias(name) for name, f in figures.items()]).alias(c) for c in columns])
    simple = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), f"{c}.*") for c in columns])))
    quartiles = column_quantiles(df, columns, (0.25, 0.5, 0.75)).toDF("column", "q1", "median", "q3")
    both = simple.unionByName(quartiles, allowMissingColumns=True)
    shown = ("n", "n_missing", "min", "q1", "median", "mean", "q3", "max")
    return both.groupBy("column").agg(*[F.max(c).alias(c) for c in shown])


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """Range, mean and quartiles of a date column, as days; a fraction of a day is cut off."""
    days = F.unix_date(column)
    quartiles = F.percentile(days, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    numbers = df.agg(
        F.count(column).alias("n"),
        F.count_if(F.col(column).isNull()).alias("n_missing"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.avg(days).alias("mean"),
        quartiles.alias("q"),
    )

    def as_date(day: F.Column) -> F.Column:
        return F.date_from_unix_date(F.floor(day).cast("int"))

    return numbers.select(
        F.lit(column).alias("column"), "n", "n_missing", "min", as_date(F.col("q")[0]).alias("q1"),
        as_date(F.col("q")[1]).alias("median"), as_date(F.col("mean")).alias("mean"), as_date(F.col("q")[2]).alias("q3"),
        "max",
    )


def category_profile(df: DataFrame, columns: Sequence[str], k: int = 6) -> DataFrame:
    """The k most frequent levels of each column, the rest as one row, NULLs as another.

    The rank filter becomes a limit in every task before rows of a column meet.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "level")
    levels = long.groupBy("column", "level").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "level"))
    top = levels.where(F.col("level").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)
    rows = levels.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
    )
    shown = top.groupBy("column").agg(F.sum("n").alias("shown"))
    rest = rows.join(shown, "column", "left").select(
        "column",
        F.inline(
            F.array(
                F.struct(F.lit("other").alias("kind"), (F.col("known") - F.coalesce("shown", F.lit(0))).alias("n")),
                F.struct(F.lit("missing").alias("kind"), F.col("missing").alias("n")),
            )
        ),
    )
    return top.select("column", F.lit("level").alias("kind"), "level", "n").unionByName(
        rest.where(F.col("n") > 0), allowMissingColumns=True
    )


def blank_aliases(employees: DataFrame) -> DataFrame:
    """Blank, missing and filled values of the alias columns."""
    long = employees.unpivot([], list(ALIAS_COLUMNS), "alias_column", "address")
    address = F.col("address")
    return long.groupBy("alias_column").agg(
        F.count_if(address == "").alias("n_blank"),
        F.count_if(address.isNull()).alias("n_missing"),
        F.count_if(address != "").alias("n_filled"),
        F.count_distinct(F.when(address != "", address)).alias("n_distinct"),
    )


def years_out_of_period(messages: DataFrame, config: CorpusConfig) -> DataFrame:
    year = F.year("date")
    outside = messages.where((year < config.period_start.year) | (year > config.period_end.year))
    return outside.groupBy(year.alias("year")).agg(F.count("*").alias("n"))


def repeated_ids(messages: DataFrame) -> DataFrame:
    """``(message_id, mid)`` pairs that occur more than once."""
    return messages.groupBy("message_id", "mid").agg(F.count("*").alias("n")).where(F.col("n") != 1)


def ids_with_several_mids(messages: DataFrame) -> DataFrame:
    """Message ids that belong to more than one ``mid``, which is what makes them redundant or not."""
    mids = messages.groupBy("message_id").agg(F.count_distinct("mid").alias("n_mid"))
    return mids.where(F.col("n_mid") > 1)


def alias_coverage(sources: Sources, config: CorpusConfig) -> DataFrame:
    """How many rows each alias column would match, per side.

    Rows are counted per address before the join, so a frequent address is one row in it.
    """
    aliases = alias_counts(sources.employees, config)
    parts = []
    for side, addresses in (("sender", sources.messages.select(F.col("sender").alias("a"))),
                            ("recipient", sources.recipients.select(F.col("rvalue").alias("a")))):
        counts = addresses.groupBy("a").agg(F.count("*").alias("n"))
        matched = counts.join(aliases, same_address(F.col("a"), F.col("address"), config))
        sums = matched.agg(
            *[F.coalesce(F.sum(F.col("n") * F.col(f"n_{c}")), F.lit(0)).alias(c) for c in ALIAS_COLUMNS]
        )
        parts.append(sums.select(F.lit(side).alias("side"), *ALIAS_COLUMNS))
    both = parts[0].unionByName(parts[1])
    return both.unpivot(["side"], list(ALIAS_COLUMNS), "alias_column", "n")


def joined(sources: Sources, config: CorpusConfig) -> DataFrame:
    """Recipients with their message and body, all recipients kept, before incomplete rows go."""
    sent = clean_messages(sources.messages, config)
    bodies = sources.references.select("mid", "reference")
    return sources.recipients.join(sent, "mid", "left").join(bodies, "mid", "left")


def incomplete_rows(sources: Sources, config: CorpusConfig) -> DataFrame:
    """Joined rows without sender, subject or date."""
    missing = F.col("sender").isNull() | F.col("subject").isNull() | F.col("date").isNull()
    return joined(sources, config).where(missing).select("mid", "rtype", "rvalue", "sender", "date", "subject", "reference")


def _lookups(employees: DataFrame, config: CorpusConfig) -> DataFrame:
    """``(address, copies)``: how many rows a lookup of the status makes of one with this address."""
    aliases = alias_counts(clean_employees(employees, config), config, ("email_id", "email3"))
    copies = F.greatest("n_email_id", F.lit(1)) * F.greatest("n_email3", F.lit(1))
    return aliases.select("address", copies.alias("copies"))


def row_preservation(sources: Sources, config: CorpusConfig) -> DataFrame:
    """Rows before and after each joining step, worked out without joining.

    A join on ``mid`` makes, of each ``mid``, the product of its rows on both sides (a left join keeps rows that match
    nothing). So each source is counted per ``mid``, rows weighing as many as their status lookup makes of them; the
    counts meet in one grouping, and the steps are sums of products. Each source is read once. A missing ``mid`` matches
    nothing.
    """
    lookups = _lookups(sources.employees, config)

    def weighed(df: DataFrame, address: str) -> DataFrame:
        found = df.join(lookups, same_address(F.col(address), F.col("address"), config), "left")
        return found.withColumn("copies", F.coalesce("copies", F.lit(1)))

    def counted(df: DataFrame, **counts: F.Column) -> DataFrame:
        names = ("received", "received_copies", "sent", "complete", "sent_copies", "bodies")
        return df.select("mid", *[counts.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    one = F.lit(1)
    whole = (F.col("sender").isNotNull() & F.col("subject").isNotNull() & F.col("date").isNotNull()).cast("int")
    received = weighed(sources.recipients.select("mid", "rvalue"), "rvalue")
    sent = weighed(clean_messages(sources.messages, config), "sender")
    sides = [
        counted(received, received=one, received_copies=F.col("copies")),
        counted(sent, sent=one, complete=whole, sent_copies=whole * F.col("copies")),
        counted(sources.references, bodies=one),
    ]
    long = reduce(DataFrame.unionAll, sides)
    of_mid = long.groupBy("mid").agg(*[F.sum(c).alias(c) for c in long.columns[1:]])
    known = F.col("mid").isNotNull()

    def matching(column: str, least: int) -> F.Column:
        return F.when(known, F.greatest(F.col(column), F.lit(least))).otherwise(least)

    bodies = matching("bodies", 1)
    rows = {
        "received": F.col("received"),
        "joined": F.col("received") * matching("sent", 1) * bodies,
        "complete": F.col("received") * matching("complete", 0) * bodies,
        "looked_up": F.col("received_copies") * matching("sent_copies", 0) * bodies,
    }
    totals = of_mid.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in rows.items()])
    steps = [("message_join", "received", "joined"), ("status_lookup", "complete", "looked_up")]
    return totals.select(F.inline(F.array(*[
        F.struct(
            F.lit(step).alias("step"), F.col(before).alias("rows_before"), F.col(after).alias("rows_after"),
            (F.col(before) == F.col(after)).alias("preserved"),
        )
        for step, before, after in steps
    ])))


def text_period(sources: Sources, config: CorpusConfig) -> DataFrame:
    """First and last day with a body, and the rows that have one."""
    held = complete_messages(joined(sources, config)).where(F.col("reference").isNotNull())
    return held.agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n")
    )


def match_counts(sources: Sources, config: CorpusConfig) -> DataFrame:
    """Rows with a status after every lookup, in the order primary, third, combined; sender first.

    A repeated alias multiplies rows at each lookup. Instead of carrying the copies, the counts are
    worked out from how many staff rows share an address, with and without status.
    """
    complete = complete_messages(joined(sources, config)).select("sender", "rvalue")
    pairs = complete.groupBy("sender", "rvalue").agg(F.count("*").alias("rows"))
    aliases = alias_counts(clean_employees(sources.employees, config), config, ("email_id", "email3"))
    parts: dict[str, F.Column] = {}
    copies = F.lit(1)
    for side, address in (("sender", "sender"), ("recipient", "rvalue")):
        held = aliases.select(
            F.col("address").alias(f"{side}_address"),
            F.col("n_email_id").alias(f"{side}_p"),
            F.col("known_email_id").alias(f"{side}_pk"),
            F.col("n_email3").alias(f"{side}_t"),
            F.col("known_email3").alias(f"{side}_tk"),
        )
        pairs = pairs.join(held, same_address(F.col(address), F.col(f"{side}_address"), config), "left")
        p, pk, t, tk = (F.coalesce(F.col(f"{side}_{x}"), F.lit(0)) for x in ("p", "pk", "t", "tk"))
        p, t = F.greatest(p, F.lit(1)), F.greatest(t, F.lit(1))
        parts[f"{side}_primary"] = copies * pk
        parts[f"{side}_third"] = copies * p * tk
        parts[f"{side}_combined"] = copies * (pk * t + (p - pk) * tk)
        copies = copies * p * t
    counts = pairs.agg(*[F.coalesce(F.sum(F.col("rows") * c), F.lit(0)).alias(name) for name, c in parts.items()])
    return counts.unpivot([], list(parts), "step", "n")


def selector_values(exchange: DataFrame, config: CorpusConfig) -> DataFrame:
    """Choices offered to a reader: statuses, persons, and first and last month, per side.

    All selectors are expanded in one pass, and map tasks already leave few values of each; a missing month
    stands for a table without rows.
    """
    values = {f"status_{side}": F.col(f"status_{side}") for side in ("sender", "recipient")}
    values |= {f"person_{side}": person_label(side, config) for side in ("sender", "recipient")}
    wide = exchange.select(*[v.alias(name) for name, v in values.items()], F.col("year_month").cast("string").alias("month"))
    long = wide.unpivot([], [*values, "month"], "selector", "value").where(F.col("value").isNotNull()).distinct()
    none = exchange.sparkSession.range(1).select(F.lit("month"), F.lit(None).cast("string"))
    month = F.col("selector") == "month"
    groups = long.unionAll(none).groupBy("selector", F.when(~month, F.col("value")).alias("choice"))
    bounds = groups.agg(F.min("value").alias("first"), F.max("value").alias("last"))

    def rows(**named: F.Column) -> F.Column:
        return F.array(*[F.struct(F.lit(n).alias("selector"), v.alias("value")) for n, v in named.items()])

    choice = F.array(F.struct("selector", F.col("choice").alias("value")))
    months = rows(first_month=F.col("first"), last_month=F.col("last"))
    return bounds.select(F.inline(F.when(month, months).otherwise(choice))).orderBy("selector", "value")
