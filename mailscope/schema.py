"""Schemas of the four source tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


EMPLOYEES = _schema(
    ("eid", T.LongType()),
    ("first_name", T.StringType()),
    ("last_name", T.StringType()),
    ("email_id", T.StringType()),
    ("email2", T.StringType()),
    ("email3", T.StringType()),
    ("email4", T.StringType()),
    ("folder", T.StringType()),
    ("status", T.StringType()),
)

MESSAGES = _schema(
    ("mid", T.LongType()),
    ("sender", T.StringType()),
    ("date", T.DateType()),
    ("message_id", T.StringType()),
    ("subject", T.StringType()),
)

RECIPIENTS = _schema(
    ("rid", T.LongType()),
    ("mid", T.LongType()),
    ("rtype", T.StringType()),
    ("rvalue", T.StringType()),
)

REFERENCES = _schema(
    ("rfid", T.LongType()),
    ("mid", T.LongType()),
    ("reference", T.StringType()),
)

SOURCE_SCHEMAS = {
    "employees": EMPLOYEES,
    "messages": MESSAGES,
    "recipients": RECIPIENTS,
    "references": REFERENCES,
}
