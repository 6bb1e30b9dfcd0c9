"""Rows to Python in batches whose bytes are bounded, however long the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a batch; a longer row is a batch of its own.
BYTES = 8 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with batches of at most :data:`BYTES`; buffers on both sides grow with the batch.

    The bound is a setting of the session, which stays; a smaller one is left as it is.
    """
    conf = df.sparkSession.conf
    if int(str(conf.get(SETTING, "67108864")).rstrip("b")) > BYTES:
        conf.set(SETTING, str(BYTES))
    return df.mapInArrow(run, schema)
