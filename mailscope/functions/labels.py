"""Labels: merged groups, person names and percentages."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def relabel(value: Column, labels: Mapping[str, str]) -> Column:
    """Replace a value by its label, keeping values that have none."""
    if not labels:
        return value
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(pairs, value), value)


def percent(share: Column, digits: int = 1) -> Column:
    """A fraction as text, such as ``12.5%``."""
    return F.format_string(f"%.{digits}f%%", share * 100)
