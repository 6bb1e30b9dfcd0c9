"""Reading the four source tables, and writing results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mailscope.schema import SOURCE_SCHEMAS


@dataclass(frozen=True)
class Sources:
    """The four tables an analysis starts from."""

    employees: DataFrame
    messages: DataFrame
    recipients: DataFrame
    references: DataFrame


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read one source table under its declared schema (nothing is inferred)."""
    reader = spark.read.schema(SOURCE_SCHEMAS[name]).format(fmt)
    if fmt == "csv":
        # Bodies span lines and hold quotes; a blank alias must stay a blank, not turn into a NULL.
        reader = reader.options(header="true", multiLine="true", escape='"', emptyValue="", nullValue="\\N")
    return reader.options(**options).load(f"{path.rstrip('/')}/{name}")


def load_sources(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> Sources:
    """Load ``employees``, ``messages``, ``recipients`` and ``references`` from a folder."""
    return Sources(**{name: read_table(spark, path, name, fmt, **options) for name in SOURCE_SCHEMAS})


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Write a result table, replacing what is there."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
