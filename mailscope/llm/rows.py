"""Telling rows apart by what they hold."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(df: DataFrame, *names: str) -> Iterator[Column]:
    """One 64-bit hash of the whole row under each of `names`, each with a seed of its own.

    Equal rows have equal hashes. Nulls are told from every value; nested columns count as their JSON text, since hashes
    leave out what is null inside.
    """
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    plain = [c for field in df.columns if field not in nested for c in (F.col(f"`{field}`").isNull(), F.col(f"`{field}`"))]
    if nested:
        plain.append(F.to_json(F.struct(*[F.col(f"`{c}`") for c in nested])))
    for seed, name in enumerate(names):
        yield F.xxhash64(F.lit(seed), *plain).alias(name)
