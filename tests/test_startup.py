"""Saved counts and bucketed sources against what they stand for."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from mailscope.plans import startup, topics, volume
from mailscope.plans.exchange import EXCHANGE_COLUMNS, build_exchange
from mailscope.sources import testbed
from mailscope.sources.tables import Sources
from tests.conftest import SF_DIR, rows
from tests.test_plans import final_plan, settings

TESTBED = testbed.TESTBED


@pytest.fixture(scope="module")
def table(spark):
    return build_exchange(testbed.testbed_sources(spark, SF_DIR), TESTBED)


def contents(spark, path):
    return {name: rows(df.select(*sorted(df.columns))) for name in startup.TABLES for df in [startup.saved_counts(spark, path, name)]}


def test_saved_counts_give_the_same_analyses(spark, table, tmp_path):
    path = str(tmp_path)
    startup.save_counts(table, TESTBED, path)
    daily = startup.saved_counts(spark, path, "daily")
    for side in startup.SIDES:
        assert rows(startup.saved_daily_volume(daily, side)) == rows(volume.daily_volume(table, side))
        saved = startup.saved_topic_months(startup.saved_counts(spark, path, f"topics_{side}"), TESTBED)
        direct = topics.topic_sums(topics.topic_mails(table, side, TESTBED), ["year_month"], TESTBED)
        assert rows(saved) == rows(direct.select(*saved.columns))
    year = startup.saved_counts(spark, path, "daily").where("year = 2000")
    assert "PartitionFilters: [isnotnull(year" in final_plan(startup.saved_daily_volume(year, "sender"))


def test_refreshing_a_year_is_a_rebuild(spark, table, tmp_path):
    """Rows of one year change, and another year loses all of its rows."""
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    changed = table.where("not (year = 2000 and month < 7) and year <> 2001")
    startup.save_counts(table, TESTBED, old)
    before = contents(spark, old)
    startup.save_counts(changed, TESTBED, old, years=[2000, 2001])
    startup.save_counts(changed, TESTBED, new)
    assert contents(spark, old) == contents(spark, new) != before


def test_bucketed_sources_join_without_a_shuffle(spark, config, tmp_path):
    n = 20_000
    staff = spark.createDataFrame([(i, "f", "l", f"a{i}@x", "", "", "", "x", "CEO") for i in range(5)],
                                  "eid long, first_name string, last_name string, email_id string, email2 string, email3 string, email4 string, folder string, status string")
    who = F.concat(F.lit("a"), F.col("id") % 9, F.lit("@x"))
    sources = Sources(
        staff,
        spark.range(n).select(F.col("id").alias("mid"), who.alias("sender"), F.lit("2000-01-01").cast("date").alias("date"),
                              F.lit("m").alias("message_id"), F.concat(F.lit("subject "), "id").alias("subject")),
        spark.range(3 * n).select(F.col("id").alias("rid"), (F.col("id") % n).alias("mid"), F.lit("TO").alias("rtype"), who.alias("rvalue")),
        spark.range(n).select(F.col("id").alias("rfid"), F.col("id").alias("mid"), F.concat(F.lit("text "), "id").alias("reference")),
    )
    startup.save_bucketed(sources, config, "startup_test", str(tmp_path), 4)
    try:
        saved, directory = startup.bucketed_sources(spark, "startup_test")
        with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "20KB", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20KB"}):
            columns = [c for c in EXCHANGE_COLUMNS if c != "reference"]
            df = build_exchange(saved, config, directory, co_located=True).select(*columns, "reference")
            plan = final_plan(df)
            assert "SortMergeJoin" in plan and not re.search(r"Exchange (?:hash|range|RoundRobin)partitioning", plan)
            found = df.agg(F.count("*"), F.count("status_sender"), F.count("status_recipient"), F.count("reference")).first()
        direct = build_exchange(sources, config)
        expected = direct.agg(F.count("*"), F.count("status_sender"), F.count("status_recipient"), F.count("reference")).first()
        assert tuple(found) == tuple(expected) and found[0] == 3 * n
    finally:
        for name in (*startup.BUCKETED, "employees", "directory"):
            spark.sql(f"DROP TABLE IF EXISTS startup_test_{name}")
