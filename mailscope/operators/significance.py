"""Significance tests from per-group counts, means and variances.

What a test cannot say - no rows, one group, groups without spread - is NULL, never an error.

Spark reduces the data to one row per group; a test then needs nothing else. The groups are the
levels of a category, so the array they are gathered in holds a handful of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscope.functions.distributions import f_upper_tail, t_two_sided
from mailscope.operators.describe import describe_weighted, in_range

Range = tuple[float, float] | None


def group_moments(df: DataFrame, group: str, value: str, value_range: Range = None) -> DataFrame:
    """``(group, n, mean, variance)``; NULL groups and values are left out."""
    kept = in_range(df, value, value_range).dropna(subset=[group, value])
    return kept.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance")
    )


def weighted_moments(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """:func:`group_moments` of an aggregated table whose rows each stand for ``weight`` rows."""
    stats = describe_weighted(df.dropna(subset=[group, value]), [group], [value], weight)
    return stats.select(F.col(group).alias("group"), "n", "mean", (F.col("sd") * F.col("sd")).alias("variance"))


def _gathered(moments: DataFrame) -> DataFrame:
    # A group of one value has no variance and adds nothing to the spread within groups.
    entry = F.struct("group", "n", "mean", F.coalesce("variance", F.lit(0.0)).alias("variance"))
    return moments.agg(F.array_sort(F.collect_list(entry)).alias("g"))


def _total(groups: Column, term) -> Column:
    return F.aggregate(groups, F.lit(0.0), lambda acc, g: acc + term(g))


def anova(moments: DataFrame) -> DataFrame:
    """One-way analysis of variance: ``f, df_between, df_within, p``."""
    g = F.col("g")
    sized = _gathered(moments).select(
        "g",
        _total(g, lambda x: x["n"]).alias("total"),
        (F.size(g) - 1).cast("double").alias("df_between"),
        _total(g, lambda x: (x["n"] - 1) * x["variance"]).alias("within"),
        F.try_divide(_total(g, lambda x: x["n"] * x["mean"]), _total(g, lambda x: x["n"])).alias("grand"),
    )
    spread = sized.select(
        "df_between",
        (F.col("total") - F.size("g")).alias("df_within"),
        "within",
        _total(F.col("g"), lambda x: x["n"] * (x["mean"] - F.col("grand")) * (x["mean"] - F.col("grand"))).alias("between"),
    )
    f = F.try_divide(
        F.try_divide(F.col("between"), F.col("df_between")), F.try_divide(F.col("within"), F.col("df_within"))
    )
    return spread.select(f.alias("f"), "df_between", "df_within").withColumn(
        "p", f_upper_tail("f", "df_between", "df_within")
    )


def pairwise_t(moments: DataFrame) -> DataFrame:
    """t-tests of all pairs of groups with a pooled deviation and Bonferroni-adjusted ``p``."""
    g = F.col("g")
    pooled = _gathered(moments).select(
        "g",
        _total(g, lambda x: x["n"] - 1).alias("df"),
        _total(g, lambda x: (x["n"] - 1) * x["variance"]).alias("within"),
        (F.size(g) * (F.size(g) - 1) / 2).alias("tests"),
    )
    pairs = F.flatten(
        F.transform(
            g,
            lambda first, i: F.transform(
                F.slice(g, i + 2, F.size(g)), lambda second: F.struct(first.alias("a"), second.alias("b"))
            ),
        )
    )
    each = pooled.withColumn("deviation", F.sqrt(F.try_divide(F.col("within"), F.col("df")))).select(
        "df", "tests", "deviation", F.explode(pairs).alias("pair")
    )
    a, b = F.col("pair.a"), F.col("pair.b")
    t = F.try_divide(a["mean"] - b["mean"], F.col("deviation") * F.sqrt(1 / a["n"] + 1 / b["n"]))
    return (
        each.select(a["group"].alias("group_a"), b["group"].alias("group_b"), t.alias("t"), "df", "tests")
        .withColumn("p", t_two_sided("t", "df"))
        .withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * F.col("tests")))
        .drop("tests")
    )


def welch_t(moments: DataFrame, reference: str) -> DataFrame:
    """Two-sample t-tests, unequal variances, of the ``reference`` group against every other group."""
    g = F.col("g")
    each = _gathered(moments.where(F.col("variance").isNotNull())).select(
        F.get(F.filter(g, lambda x: x["group"] == reference), F.lit(0)).alias("a"),
        F.explode(F.filter(g, lambda x: x["group"] != reference)).alias("b"),
    ).where(F.col("a").isNotNull())
    a, b = F.col("a"), F.col("b")
    ea, eb = a["variance"] / a["n"], b["variance"] / b["n"]
    squared = (ea + eb) * (ea + eb)
    return each.select(
        a["group"].alias("group_a"),
        b["group"].alias("group_b"),
        F.try_divide(a["mean"] - b["mean"], F.sqrt(ea + eb)).alias("t"),
        F.try_divide(squared, ea * ea / (a["n"] - 1) + eb * eb / (b["n"] - 1)).alias("df"),
    ).withColumn("p", t_two_sided("t", "df"))
