"""The four source tables expressed over the shared test tables (see FIXTURES.md)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig, Topic
from mailscope.sources.tables import Sources


def _address(prefix: str, number: F.Column, domain: str) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"), F.lit(domain))


def employees(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        key.alias("eid"),
        F.col("c_name").alias("first_name"),
        F.lit("").alias("last_name"),
        _address("cust", key, "@corp.example").alias("email_id"),
        F.lit("").alias("email2"),
        F.when(key % 3 != 0, _address("supp", key, "@corp.example")).otherwise("").alias("email3"),
        F.lit("").alias("email4"),
        F.concat(F.lit("folder-"), F.col("c_nationkey").cast("string")).alias("folder"),
        F.when(key % 5 == 0, "N/A").when(key % 149 == 1, None).otherwise(F.col("c_mktsegment")).alias("status"),
    )


def messages(orders: DataFrame) -> DataFrame:
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    state = F.col("o_orderstatus")
    return orders.select(
        order.alias("mid"),
        F.when(customer % 4 == 0, _address("ext", customer % 40, "@mail.example"))
        .when(customer % 50 == 7, _address("cust ", customer, "@corp.example"))
        .otherwise(_address("cust", customer, "@corp.example"))
        .alias("sender"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("<"), (order - F.when(order % 40 == 1, 1).otherwise(0)).cast("string"), F.lit("@mail>")).alias("message_id"),
        F.concat(
            F.when(state == "F", "RE: ").when(state == "P", "FW: ").otherwise(""),
            F.col("o_orderpriority"),
            F.lit(" "),
            (order % 200).cast("string"),
        ).alias("subject"),
    )


def recipients(lineitem: DataFrame) -> DataFrame:
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    flag = F.col("l_returnflag")
    # The table has no key of its own; "first" is defined by the whole row, compared field by field.
    order_of_appearance = F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    return lineitem.select(
        order_of_appearance.alias("rid"),
        F.col("l_orderkey").alias("mid"),
        F.when(flag == "R", "TO").when(flag == "A", "CC").otherwise("BCC").alias("rtype"),
        F.when(line % 3 == 0, _address("supp", F.col("l_suppkey"), "@corp.example"))
        .when(line % 3 == 1, _address("cust", part, "@corp.example"))
        .otherwise(_address("ext", part % 97, "@mail.example"))
        .alias("rvalue"),
    )


def references(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("rfid"), F.col("doc_id").alias("mid"), F.col("text").alias("reference")
    )


#: Declared, so that no file is opened while a query is put together.
TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING",
}


def testbed_sources(spark: SparkSession, sf_dir: str) -> Sources:
    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    return Sources(
        employees=employees(table("customer")),
        messages=messages(table("orders")),
        recipients=recipients(table("lineitem")),
        references=references(table("documents")),
    )


def with_blank_addresses(sources: Sources) -> Sources:
    """The same sources with some blank and missing addresses on both ends."""
    mid = F.col("mid")
    sender = F.when(mid % 40 == 7, "").otherwise(F.col("sender"))
    recipient = F.when((mid % 40 == 3) | (mid % 400 == 7), "").when(mid % 40 == 5, None).otherwise(F.col("rvalue"))
    return replace(
        sources, messages=sources.messages.withColumn("sender", sender), recipients=sources.recipients.withColumn("rvalue", recipient)
    )


TESTBED = CorpusConfig(
    internal_pattern="@corp",
    company_pattern="HIGH|URGENT|License",
    generic_pattern="^ext1|^supp2|cust9",
    topics=(
        Topic("meeting", "HIGH|URGENT", "the|and"),
        Topic("business_process", "MEDIUM|SPEC", "date|hat"),
        Topic("core_business", "LOW|RE:", "all|License"),
        Topic("company_event", "1[0-9]$", "@mail|token"),
    ),
    words=(
        "the", "and", "date", "all", "License", "HIGH", "LOW", "token", "the", "MEDIUM", "RE", "with", "URGENT", "for", "SPEC",
    ),
    statuses=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    status_groups={
        "BUILDING": "goods",
        "FURNITURE": "goods",
        "MACHINERY": "industrial",
        "AUTOMOBILE": "industrial",
    },
    topic_labels={
        "sum_subject_business_process": "Process subject",
        "sum_subject_core_business": "Core subject",
        "sum_subject_meeting": "Meeting subject",
        "sum_subject_company_event": "Event subject",
        "sum_email_business_process": "Process text",
        "sum_email_core_business": "Core text",
        "sum_email_meeting": "Meeting text",
        "sum_email_company_event": "Event text",
    },
    person_shortlist="^cust1[0-4]@|^ext8@|^ext12@|^supp1[0-2]@",
    persons={
        "sender": {
            "cust10@corp.example": "Person A",
            "ext8@mail.example": "Person A",
            "cust11@corp.example": "Person B",
            "cust13@corp.example": "Person C",
        },
        "recipient": {
            "cust10@corp.example": "Person A",
            "supp10@corp.example": "Person A",
            "ext8@mail.example": "Person A",
            "cust11@corp.example": "Person B",
            "supp11@corp.example": "Person B",
            "cust13@corp.example": "Person C",
        },
    },
    focus_address="cust1378@corp.example",
    focus_label="cust1378",
    focus_status="HOUSEHOLD",
)
