"""What the physical plans must look like."""

from __future__ import annotations

import contextlib
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from mailscope import catalog
from mailscope.plans import activity, external, keywords, rank, volume
from mailscope.plans.exchange import build_exchange, corpus_exchange, save_exchange, saved_exchange, status_pairs
from mailscope.sources.tables import Sources, load_sources, write_table
from tests.conftest import SF_DIR, rows


def final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Subqueries are printed with an initial plan of their own; only those parts are left out.
    kept, skipping = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|*"))
        if "== Initial Plan ==" in line:
            skipping = depth
        elif skipping is not None and ("== Final Plan ==" in line or depth < skipping):
            skipping = None
        if skipping is None:
            kept.append(line)
    return "\n".join(kept)


def scans(df) -> dict[str, int]:
    """How often the final plan, stages and subqueries included, reads each file; reused stages read nothing."""
    df.collect()
    found: dict[str, int] = {}

    def walk(node) -> None:
        name = node.getClass().getSimpleName()
        if name == "ReusedExchangeExec" or name == "ReusedSubqueryExec":
            return
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            table = re.search(r"/(\w+)\.parquet", node.toString())[1]
            found[table] = found.get(table, 0) + 1
        for children in (node.children(), node.subqueries()):
            for i in range(children.size()):
                walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@contextlib.contextmanager
def settings(spark, **options):
    before = {k: spark.conf.get(k, None) for k in options}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.shuffle.partitions": "16",
}


def hot_sources(spark, n: int = 60000) -> Sources:
    """One message, one sender and one recipient each hold a third of the rows."""
    third = F.col("id") % 3 == 0
    messages = spark.range(n // 2, numPartitions=4).select(
        F.col("id").alias("mid"),
        F.when(third, "hot@corp").otherwise(F.concat(F.lit("s"), F.col("id") % 5000, F.lit("@corp"))).alias("sender"),
        F.lit("2000-01-01").cast("date").alias("date"),
        F.lit("m").alias("message_id"),
        F.concat(F.lit("subject "), F.col("id")).alias("subject"),
    )
    recipients = spark.range(n, numPartitions=4).select(
        F.col("id").alias("rid"),
        F.when(third, 1).otherwise(F.col("id") % (n // 2)).alias("mid"),
        F.lit("TO").alias("rtype"),
        F.when(F.col("id") % 3 == 1, "hot@corp").otherwise(F.concat(F.lit("r"), F.col("id"), F.lit("@corp"))).alias("rvalue"),
    )
    staff = spark.range(5000, numPartitions=2).select(
        F.col("id").alias("eid"), F.lit("").alias("first_name"), F.lit("").alias("last_name"),
        F.when(F.col("id") == 0, "hot@corp").otherwise(F.concat(F.lit("s"), F.col("id"), F.lit("@corp"))).alias("email_id"),
        F.lit("").alias("email2"), F.lit("").alias("email3"), F.lit("").alias("email4"), F.lit("").alias("folder"),
        F.lit("CEO").alias("status"),
    )
    bodies = spark.range(100).select(
        F.col("id").alias("rfid"), F.col("id").alias("mid"), F.concat(F.lit("text "), F.col("id")).alias("reference")
    )
    return Sources(staff, messages, recipients, bodies)


def test_hot_message_sender_and_recipient_are_split(spark, config):
    with settings(spark, **SHUFFLED):
        sources = hot_sources(spark)
        table = build_exchange(sources, config)
        df = table.groupBy("status_sender", "status_recipient").agg(F.count("*").alias("n"))
        plan = final_plan(df)
        assert sum(r["n"] for r in df.collect()) == 60000
    # The lookups of both addresses and the join of recipients with their message.
    assert plan.count("isSkew=true") + plan.count("skew=true") >= 3


def test_blank_address_is_split(spark, config):
    """Half of all aliases and a third of all recipients are blank and match each other."""
    with settings(spark, **SHUFFLED):
        sources = hot_sources(spark)
        blank = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("id")))
        recipients = spark.range(60000, numPartitions=4).select(
            F.col("id").alias("rid"), (F.col("id") % 30000).alias("mid"), F.lit("TO").alias("rtype"), blank.alias("rvalue")
        )
        df = status_pairs(replace(sources, recipients=recipients), replace(config, match_blank=True))
        assert "skew=true" in final_plan(df)
        # 10,000 of the blank recipients' messages are there twice; each meets 5,000 blank aliases.
        assert sum(r["n"] for r in df.collect()) == 40_000 + 20_000 * 5_000


def test_hot_conversation_is_split(spark, config):
    with settings(spark, **SHUFFLED):
        one = F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("subject "), F.col("id")))
        table = spark.range(60000, numPartitions=4).select(
            F.lit("2000-01-01").cast("date").alias("date"), one.alias("subject"),
            F.concat(F.lit("s"), F.col("id")).alias("sender"), F.lit("r@out").alias("recipient"),
        )
        df = external.external_exchanges(table, config)
        assert "skew=true" in final_plan(df)
        assert df.count() == 60000


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored"))
    sources = corpus(
        staff=[("a@x", "", "CEO")],
        mails=[(1, "a@x", "2000-01-01", "s"), (2, "b@x", "2003-01-01", "t")],
        recipients=[(1, "TO", "b@x"), (2, "TO", "b@x")],
        bodies=[(1, "line one\nline \"two\"")],
    )
    for name, df in vars(sources).items():
        write_table(df, f"{path}/parquet/{name}")
        df.write.csv(f"{path}/csv/{name}", header=True, escape='"', emptyValue="", nullValue="\\N")
    return path, sources


def test_filters_and_columns_reach_the_scan(spark, config, stored):
    sources = load_sources(spark, f"{stored[0]}/parquet")
    plan = final_plan(volume.monthly_volume(build_exchange(sources, config)))
    assert "GreaterThanOrEqual(date,1999-01-01)" in plan and "LessThanOrEqual(date,2002-12-31)" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    bodies = next(line for line in scans if "/references" in line)
    assert "ReadSchema: struct<mid:bigint>" in bodies
    assert "regexp" not in plan.lower() and "RLIKE" not in plan and "sha2" not in plan


def test_formats_round_trip(spark, config, stored):
    path, sources = stored
    expected = rows(corpus_exchange(sources, config))
    assert len(expected) == 1
    for fmt in ("parquet", "csv"):
        assert rows(corpus_exchange(load_sources(spark, f"{path}/{fmt}", fmt), config)) == expected


def test_saved_exchange_prunes_years(spark, config, stored, tmp_path):
    table = build_exchange(stored[1], config)
    save_exchange(table, str(tmp_path / "exchange"))
    again = saved_exchange(spark, str(tmp_path / "exchange"))
    assert rows(volume.monthly_volume(again)) == rows(volume.monthly_volume(table))
    plan = final_plan(again.where("year = 2000").select("sender"))
    assert "PartitionFilters: [isnotnull(year" in plan


@pytest.mark.parametrize(
    "name", ["keyword_total_sent", "keyword_status_total_received", "per_person_ratio_stats_received", "top_senders",
             "compare_stats_received", "kpis", "external_subject_overlap"]
)
def test_large_tables_are_scanned_once(spark, name):
    assert scans(catalog.queries()[name](spark, SF_DIR))["lineitem"] == 1


@pytest.mark.parametrize(
    "name", ["topic_flags_received", "person_mails_received", "external_exchanges", "internal_exchanges",
             "external_subject_overlap", "first_exchanges"]
)
def test_bodies_join_rows_that_are_computed_once(spark, name):
    """Bodies are read once for what is derived from them and once for their text; everything else once."""
    found = scans(catalog.queries()[name](spark, SF_DIR.replace("0.001", "0.01")))
    assert (found["lineitem"], found["orders"], found["documents"]) == (1, 1, 2)


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("profile_row_preservation", {"lineitem": 1, "orders": 1, "documents": 1, "customer": 1}),
        ("profile_selectors", {"lineitem": 1, "orders": 1, "documents": 1, "customer": 2}),
        ("profile_message_numbers", {"orders": 5}),
        ("profile_reference_numbers", {"documents": 5}),
    ],
)
def test_profiles_scan_a_table_once_per_pass(spark, name, expected):
    """The staff list is looked up under two aliases; quantiles take four passes after that of the simple figures."""
    assert scans(catalog.queries()[name](spark, SF_DIR)) == expected


def test_a_second_scan_is_seen(spark):
    sources, table = catalog._testbed(spark, SF_DIR)
    again = sources.recipients.agg(F.count("*").alias("n")).select("n", F.lit("x").alias("sender"))
    assert scans(rank.top_senders(table).join(again, "sender", "left"))["lineitem"] == 2


def test_whole_results_do_not_pass_one_window(spark, config):
    table = catalog._testbed(spark, SF_DIR)[1]
    for df in (
        external.external_exchanges(table, catalog.TESTBED),
        activity.received_ratio(table),
        keywords.monthly_pairs(table),
    ):
        assert "Window" not in final_plan(df)
