"""Statistics and tests against worked values."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from mailscope.functions.distributions import f_upper_tail, log_gamma, t_two_sided
from mailscope.operators.density import density
from mailscope.operators.describe import box_statistics, describe, describe_many, describe_weighted
from mailscope.operators.quantiles import column_quantiles, exact_quantiles, grouped_quantiles, order_key
from mailscope.operators.significance import anova, group_moments, pairwise_t, weighted_moments, welch_t
from tests.conftest import rows


def frame(spark, groups):
    return spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g string, v double")


@pytest.fixture(scope="module")
def small(spark):
    return frame(spark, {"one": [5], "two": [1, 2], "four": [1, 2, 3, 10]})


def test_describe(small):
    found = {r["g"]: r for r in describe(small, ["g"], "v").collect()}
    four = found["four"]
    assert (four["n"], four["mean"], four["median"], four["min"], four["q1"], four["q3"], four["max"]) == (
        4, 4.0, 2.5, 1.0, 1.75, 4.75, 10.0
    )
    assert four["sd"] == pytest.approx(4.082483, abs=1e-6)
    assert found["one"]["sd"] is None


def test_weighted_rows_equal_repeated_rows(spark):
    weighted = spark.createDataFrame([("a", 1.5, 3), ("a", 4.0, 2), ("a", 9.0, 0), ("b", 2.0, 1)], "g string, v double, w long")
    repeated = frame(spark, {"a": [1.5, 1.5, 1.5, 4.0, 4.0], "b": [2.0]})
    left = {r["g"]: r.asDict() for r in describe_weighted(weighted, ["g"], ["v"], "w").collect()}
    right = {r["g"]: r.asDict() for r in describe(repeated, ["g"], "v").collect()}
    assert left.keys() == right.keys()
    for g, row in right.items():
        for name, value in row.items():
            assert left[g][name] == (pytest.approx(value) if isinstance(value, float) else value)
    one, other = weighted_moments(weighted, "g", "v", "w"), group_moments(repeated, "g", "v")
    assert rows(one.select("group", "n", F.round("variance", 9))) == rows(other.select("group", "n", F.round("variance", 9)))


def test_describe_many_names(small):
    df = describe_many(small.withColumn("w", F.col("v") * 2), [], ["v", "w"])
    assert df.columns[:3] == ["v_mean", "v_median", "v_sd"] and df.columns[-1] == "w_max"
    assert df.first()["w_max"] == 20.0


def test_box(spark):
    df = frame(spark, {"a": [1, 2, 3, 4, 5, 30], "b": [7]})
    assert rows(box_statistics(df, ["g"], "v")) == [
        ("a", 6, 1.0, 2.25, 3.5, 4.75, 5.0), ("b", 1, 7.0, 7.0, 7.0, 7.0, 7.0)
    ]


@pytest.mark.parametrize(
    ("t", "df", "p"),
    # Critical values of published tables, and the normal limit.
    [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.750, 30, 0.01), (1.959964, 1e9, 0.05), (0.0, 5, 1.0),
     (-2.228, 10, 0.05), (1.0, 1, 0.5)],
)
def test_t_tail(spark, t, df, p):
    found = spark.range(1).select(t_two_sided(f"{float(t)}D", f"{float(df)}D")).first()[0]
    assert found == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize(
    ("f", "a", "b", "p"),
    [(4.965, 1, 10, 0.05), (3.326, 5, 10, 0.05), (5.636, 5, 10, 0.01), (1.0, 8, 8, 0.5), (2.2141, 5, 1e7, 0.05),
     (0.0, 3, 9, 1.0)],
)
def test_f_tail(spark, f, a, b, p):
    found = spark.range(1).select(f_upper_tail(f"{float(f)}D", f"{float(a)}D", f"{float(b)}D")).first()[0]
    assert found == pytest.approx(p, abs=2e-5)


def test_tails_without_arguments(spark):
    missing = "CAST(NULL AS DOUBLE)"
    row = spark.range(1).select(t_two_sided(missing, "3D"), f_upper_tail(missing, "1D", "2D")).first()
    assert tuple(row) == (None, None)


def test_log_gamma(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.5, 10.0, 12345.5)], "x double")
    for x, value in df.select("x", log_gamma("x")).collect():
        assert value == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


GROUPS = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}


def test_anova(spark):
    # Sums of squares 84 between and 68 within: F(2, 15) = 9.264706.
    row = anova(group_moments(frame(spark, GROUPS), "g", "v")).first()
    assert (row["df_between"], row["df_within"]) == (2.0, 15.0)
    assert row["f"] == pytest.approx(42 / (68 / 15))
    assert row["p"] == pytest.approx(0.0023987773, abs=1e-9)


def test_anova_leaves_out_values_beyond_the_axis(spark):
    clipped = {g: [x for x in v if x <= 9] for g, v in GROUPS.items()}
    one = anova(group_moments(frame(spark, GROUPS), "g", "v", (0, 9))).first()
    other = anova(group_moments(frame(spark, clipped), "g", "v")).first()
    assert one["f"] == pytest.approx(other["f"]) and one["df_within"] == other["df_within"]


def test_anova_of_one_group(spark):
    row = anova(group_moments(frame(spark, {"a": [1, 2, 3]}), "g", "v")).first()
    assert row["f"] is None and row["p"] is None


def test_pairwise(spark):
    found = {(r["group_a"], r["group_b"]): r for r in pairwise_t(group_moments(frame(spark, GROUPS), "g", "v")).collect()}
    assert sorted(found) == [("a", "b"), ("a", "c"), ("b", "c")]
    deviation = math.sqrt(68 / 15)
    assert found["a", "b"]["t"] == pytest.approx((5 - 9) / (deviation * math.sqrt(2 / 6)))
    assert found["a", "b"]["df"] == 15.0
    assert found["a", "b"]["p_adjusted"] == pytest.approx(3 * found["a", "b"]["p"])
    assert found["b", "c"]["p_adjusted"] == 1.0


def test_welch(spark):
    values = {
        "x": [27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4],
        "y": [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.4, 30.0],
        "z": [1.0, 2.0],
    }
    found = {r["group_b"]: r for r in welch_t(group_moments(frame(spark, values), "g", "v"), "x").collect()}
    assert sorted(found) == ["y", "z"]
    mx, my = (sum(values[g]) / 15 for g in "xy")
    vx, vy = (sum((u - m) ** 2 for u in values[g]) / 14 for g, m in (("x", mx), ("y", my)))
    se = vx / 15 + vy / 15
    assert found["y"]["t"] == pytest.approx((mx - my) / math.sqrt(se))
    assert found["y"]["df"] == pytest.approx(se**2 / ((vx / 15) ** 2 / 14 + (vy / 15) ** 2 / 14))
    assert 0 < found["y"]["p"] < 0.05


def test_density_covers_one(spark):
    df = frame(spark, {"a": [1, 1, 2, 2, 2, 3, 5, 8], "flat": [4, 4, 4]})
    curve = density(df, "g", "v", points=200).orderBy("point").collect()
    assert {r["g"] for r in curve} == {"a"} and len(curve) == 200
    step = curve[1]["x"] - curve[0]["x"]
    assert sum(r["density"] for r in curve) * step == pytest.approx(1.0, abs=5e-3)


def test_density_is_near_the_direct_sum(spark):
    """Within the stated error, also where a few values lie many bandwidths away from the rest."""
    pick = random.Random(4)
    groups = {"a": [pick.randint(0, 30) for _ in range(300)], "b": [pick.gauss(0, 1) for _ in range(200)] + [500.0, 2000.0]}
    for r in density(frame(spark, {g: list(map(float, v)) for g, v in groups.items()}), "g", "v", points=64).collect():
        values = groups[r["g"]]
        n, mean = len(values), sum(values) / len(values)
        quartiles = [sorted(values)[int(p * (n - 1))] * (1 - p * (n - 1) % 1) + sorted(values)[int(p * (n - 1)) + 1] * (p * (n - 1) % 1) for p in (0.25, 0.75)]
        deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1))
        width = 0.9 * min(deviation, (quartiles[1] - quartiles[0]) / 1.34) * n**-0.2
        direct = sum(math.exp(-0.5 * ((r["x"] - v) / width) ** 2) for v in values) / (n * width * math.sqrt(2 * math.pi))
        assert abs(r["density"] - direct) <= 1 / (8 * 32**2) / (width * math.sqrt(2 * math.pi)) * 1.01


def test_density_is_the_direct_sum(spark):
    values = [0.0, 1.0, 1.0, 2.5, 4.0, 7.0, 7.0, 7.25, 500.0]
    curve = density(frame(spark, {"a": values, None: values}), "g", "v", points=50).collect()
    quartiles, mean = (1.0, 7.0), sum(values) / 9
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / 8)
    width = 0.9 * min(deviation, (quartiles[1] - quartiles[0]) / 1.34) * 9**-0.2
    assert sorted((r["g"] is None, r["point"]) for r in curve) == [(g, p) for g in (False, True) for p in range(50)]
    for r in curve:
        direct = sum(math.exp(-0.5 * ((r["x"] - v) / width) ** 2) for v in values) / (9 * width * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(direct, rel=1e-9, abs=1e-15)


def test_density_puts_no_group_in_order(spark):
    curve = density(spark.range(1000).selectExpr("id % 2 AS g", "id AS v"), "g", "v")
    assert "Window" not in curve._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "values", [[7], [1, 2, 3, 10], [-5, -5, -5, 0, 9, 10**15, 3 * 10**15, None], list(range(0, 700000, 7)), [3] * 50 + [4] * 3]
)
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = exact_quantiles(df, "x", shares).first()
    expected = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in shares]))).first()[0]
    assert list(found) == pytest.approx(expected)


def test_exact_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.range(0).withColumnRenamed("id", "x"), "x", [0.5]).first()[0] is None


@pytest.mark.parametrize("df", [1e9, 1e11])
def test_tails_at_huge_degrees_of_freedom(spark, df):
    one = spark.createDataFrame([(1.0, df, 4.0)], "x double, df double, four double")
    f, t = one.select(f_upper_tail("x", "four", "df"), t_two_sided("x", "df")).first()
    assert f == pytest.approx(3 * math.exp(-2), abs=1e-9)
    assert t == pytest.approx(math.erfc(math.sqrt(0.5)), abs=1e-9)


@pytest.mark.parametrize("df", [2.0, 30.0, 1e3, 1e7])
def test_equal_degrees_of_freedom_give_a_half(spark, df):
    one = spark.createDataFrame([(1.0, df)], "f double, df double")
    assert one.select(f_upper_tail("f", "df", "df")).first()[0] == pytest.approx(0.5, abs=1e-9)


@pytest.mark.parametrize("values", [[], [("a", 1.0)], [("a", 1.0), ("a", 2.0)], [("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)]])
def test_tests_of_flat_and_empty_groups_are_null(spark, values):
    moments = group_moments(spark.createDataFrame(values, "g string, v double"), "g", "v")
    assert [r.f for r in anova(moments).collect()] == [None]
    assert all(r.t is None and r.p is None for r in pairwise_t(moments).collect())
    assert all(r.t is None and r.p is None for r in welch_t(moments, "a").collect())


SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
ODD = [
    0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308,
    math.inf, -math.inf, math.nan, 0.1, 0.1 + 2**-56, 1 - 2**-53, 1.0, 1 + 2**-52, 2.0, 2**52 + 0.5, -1e-310, 1e22, math.pi,
]


def test_keys_of_doubles_sort_as_they_do(spark):
    pick = random.Random(1)
    drawn = [struct.unpack("<d", struct.pack("<Q", pick.getrandbits(64)))[0] for _ in range(5000)]
    values = ODD + drawn + [2.0**e * f for e in range(-1074, 1024) for f in (1.0, 1 - 2**-53, 1.5)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    keys = df.select("x", order_key(F.col("x"), df.schema["x"].dataType).alias("key")).collect()
    ordered = sorted(keys, key=lambda r: r.key)
    for a, b in zip(ordered, ordered[1:]):
        if math.isnan(b.x):
            continue
        assert a.x < b.x if a.key < b.key else a.x == b.x
    assert math.isnan(ordered[-1].x)


@pytest.mark.parametrize("values", [[1.5], [0.1, 0.2, 0.4], [v for v in ODD if math.isfinite(v)], [1 / n for n in range(1, 3000)]])
def test_exact_quantiles_of_fractions(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    expected = df.agg(F.percentile("x", F.array(*map(F.lit, SHARES)))).first()[0]
    assert list(exact_quantiles(df, "x", SHARES).first()) == expected


def test_quantiles_of_columns_of_several_types(spark):
    df = spark.range(-500, 1500).selectExpr(
        "id", "cast(id / 7 as decimal(18, 6)) AS d", "cast(id * id % 301 as smallint) AS s", "cast(id / 3 as float) AS f",
        "date_add(date'2000-01-01', cast(id % 50 as int)) AS day",
    )
    columns = ["id", "d", "s", "f", "day"]
    found = {r["column"]: list(r)[1:] for r in column_quantiles(df, columns, SHARES).collect()}
    for c in columns:
        x = F.unix_date(c) if c == "day" else F.col(c).cast("double")
        assert found[c] == pytest.approx(df.agg(F.percentile(x, F.array(*map(F.lit, SHARES)))).first()[0])
    with pytest.raises(TypeError):
        exact_quantiles(spark.range(1).selectExpr("cast(id as decimal(38, 10)) AS x"), "x", [0.5])


def test_rows_of_a_column_do_not_meet_in_one_task(spark):
    """Identifiers share their first bits; joins without size estimates may not bring them together."""
    df = spark.range(0, 200_000, numPartitions=8)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        found = column_quantiles(df, ["id"], (0.25, 0.5))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert tuple(found.first()) == ("id", 49999.75, 99999.5)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_grouped_quantiles(spark):
    df = spark.range(20_000).selectExpr(
        "nullif(id % 7, 6) AS g", "if(id % 11 = 0, null, (id * 7919 % 10007) / 8) AS v", "id % 4 AS w"
    )
    shares = F.array(*map(F.lit, SHARES))
    for weight in (None, "w"):
        exact = F.percentile("v", shares) if weight is None else F.percentile("v", shares, F.col("w"))
        expected = {r.g: r.q for r in df.groupBy("g").agg(exact.alias("q")).collect()}
        found = {r.g: list(r)[1:] for r in grouped_quantiles(df, ["g"], "v", SHARES, weight).collect()}
        assert found == expected and None in found


def test_quantiles_hold_no_group_in_one_task(spark):
    """A hot group of ten million distinct values: no task reads as many rows as it has, nor a tenth of them."""
    from pyspark.sql.functions import spark_partition_id

    df = spark.range(0, 10_500_000, numPartitions=8).selectExpr("if(id % 21 = 0, 'cold', 'hot') AS g", "id * 2.5D AS v")
    live = grouped_quantiles(df, ["g"], "v", (0.25, 0.5))
    found = {r.g: (r.q0, r.q1) for r in live.collect()}
    kept = [i for i in range(0, 10_500_000, 21)]
    assert found["cold"] == (kept[len(kept) // 4 - 1] * 2.5 * 0.25 + kept[len(kept) // 4] * 2.5 * 0.75, sum(kept[len(kept) // 2 - 1 : len(kept) // 2 + 1]) * 1.25)
    position = (10_000_000 - 1) / 2
    low, high = (int(position) // 20 * 21 + int(position) % 20 + 1, (int(position) + 1) // 20 * 21 + (int(position) + 1) % 20 + 1)
    assert found["hot"][1] == (low + high) * 1.25
    first = df.select("g", order_key(F.col("v"), df.schema["v"].dataType).alias("_key")).groupBy(
        "g", F.shiftright("_key", 48), spark_partition_id()
    ).count()
    assert first.count() < 10_000  # what leaves the map tasks of the first level
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "percentile" not in plan
