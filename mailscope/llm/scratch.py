"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage: a lost executor costs a reread, not a recomputation of everything before.
The folder is scratch space; whoever runs the cluster empties it after a job.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL = re.compile(r"local(\[.*\])?")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a local one only where none is set and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mailscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` and return it as read back, so that several uses compute it once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
