"""Shards by extendible hashing.

A row's key gives a string of hash bits. The directory starts with one bucket for all rows; a bucket beyond its byte
limit splits on the next bit, others stay, so a shard is a prefix of bits of its own length. All sizes come from one
histogram over prefixes, as deep as an even spread needs and a little more; only rows of prefixes that are still too
large are looked at again with more bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscope.llm.scratch import materialise

#: Bits that a digest gives at a time, so that they stay a positive LONG, and bits looked at further in one round.
BITS, STEP = 60, 10
#: Bytes of a shard: what a training loader fetches at a time.
SHARD_BYTES = 1 << 20


def hash_bits(text: Column) -> Column:
    """The first 60 bits of a digest."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _leaves(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards between `low` and `high` bits: a map from the bits used so far, `_bits`, and the
    prefix of `high` bits, `_cell`, to `_depth`, `_bytes` and
    `_count`, null where more bits are needed."""
    cells = rows.groupBy("_bits", F.shiftright("_hash", BITS - high).alias("_cell")).agg(F.sum("_size").alias("_b"), F.count("*").alias("_n"))
    cells = materialise(cells, "shard-cells")
    levels = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("_depth"))
    levels = levels.withColumn("_prefix", F.expr(f"shiftright(_cell, {high} - _depth)"))
    sums = levels.groupBy("_bits", "_depth", "_prefix").agg(F.sum("_b").alias("_bytes"), F.sum("_n").alias("_count"))
    fitting = sums.filter((F.col("_bytes") <= limit) | (F.col("_count") == 1))
    first = levels.join(fitting, ["_bits", "_depth", "_prefix"]).groupBy("_bits", "_cell").agg(F.min(F.struct("_depth", "_bytes", "_count")).alias("_s"))
    return cells, first.select("_bits", "_cell", "_s.*")


def shards(rows: DataFrame, keys: Sequence[str], size: Column, limit: int) -> DataFrame:
    """`rows` with `shard` (its prefix of bits as text), `depth`, `shard_bytes` and `shard_rows`.

    Bits come from the keys; rows that share all of them go on with bits of the whole row, and equal rows with bits of
    their number among their equals. Only a row that is larger than the limit on its own gives a shard that is.
    Null keys hash as such, null sizes count 0. Columns of the rows with the four result names are replaced. No rows
    in, no rows out.
    """
    names = [c for c in rows.columns if c not in ("shard", "depth", "shard_bytes", "shard_rows")]
    rows = rows.select(*names)
    known = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    whole = F.to_json(F.struct(*names))
    left = rows.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long")).withColumn("_hash", hash_bits(known)).withColumn("_bits", F.lit(""))
    total = left.agg(F.sum("_size")).first()[0] or 0
    low, high, done, stage = 0, min(BITS, max(1, (total // limit).bit_length() + 3)), None, 0
    while True:
        _, leaves = _leaves(left, low, high, limit)
        cell = F.shiftright("_hash", BITS - high).alias("_cell")
        placed = left.select("*", cell).join(materialise(leaves, "shard-leaves"), ["_bits", "_cell"], "left").drop("_cell")
        bits = F.expr(f"concat(_bits, substring(lpad(bin(_hash), {BITS}, '0'), 1, _depth))")
        found = placed.filter("_depth is not null").select(
            *names, bits.alias("shard"), F.length(bits).alias("depth"), F.col("_bytes").alias("shard_bytes"), F.col("_count").alias("shard_rows")
        )
        done = found if done is None else done.unionByName(found)
        left = placed.filter("_depth is null").drop("_depth", "_bytes", "_count")
        if left.isEmpty():
            return done
        left = materialise(left, "shard-oversized")
        low, high = high + 1, min(BITS, high + STEP)
        if low > BITS:  # all bits of this digest are used: go on with the next
            whole_bits = F.concat("_bits", F.lpad(F.bin("_hash"), BITS, "0"))
            left = left.withColumn("_bits", whole_bits)
            stage += 1
            if stage == 1:
                left = left.withColumn("_hash", hash_bits(whole))
            else:
                equal = left.groupBy(*names, "_size", "_bits").agg(F.count("*").alias("_n"))
                left = equal.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
                left = left.withColumn("_hash", hash_bits(F.concat_ws("/", whole, "_n"))).drop("_n")
            left = materialise(left, "shard-oversized")
            low, high = 0 if stage > 1 else 1, STEP


def document_shards(documents: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """`doc_id`, `n_bytes` (of the text) and the shard of every document, by the hash of `doc_id`."""
    return shards(documents.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).na.fill(0, ["n_bytes"]), ["doc_id"], F.col("n_bytes"), limit)


def write_shards(documents: DataFrame, path: str, limit: int = 1 << 26) -> None:
    """The documents, all columns, one folder per shard, each written by one task.

    The folders are named by bits: a reader gives a schema, lest Spark takes them for numbers."""
    sharded = shards(documents, ["doc_id"], F.octet_length("text"), limit)
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
