"""Cleaning and joining, on the cases that go wrong easily."""

from __future__ import annotations

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from mailscope.operators.cleaning import clean_employees
from mailscope.plans import profile, volume
from mailscope.operators.aliases import replicated
from mailscope.plans.exchange import (
    EXCHANGE_COLUMNS, build_exchange, corpus_exchange, status_pairs, texts, with_text,
)
from tests.conftest import day, rows

STAFF = [("ann@corp", "a@old", "CEO"), ("bob@corp", "", "Manager"), ("cid@corp", "c@old", "N/A"), ("dan@corp", "", None)]


def test_missing_status_becomes_null(corpus, config):
    staff = clean_employees(corpus(staff=STAFF).employees, config)
    assert rows(staff, "email_id", "status") == [
        ("ann@corp", "CEO"), ("bob@corp", "Manager"), ("cid@corp", None), ("dan@corp", None)
    ]
    assert "email2" not in staff.columns and "email4" not in staff.columns


def test_exchange_rows(corpus, config):
    sources = corpus(
        STAFF,
        mails=[(1, "ann@corp", "2000-05-06", "RE: meet"), (2, "a@old", "2001-01-02", "x"), (3, "z@out", "2002-12-31", "y")],
        recipients=[(1, "TO", "bob@corp"), (1, "CC", "c@old"), (2, "TO", "a@old"), (3, "BCC", "q@out"), (9, "TO", "r@out")],
        bodies=[(1, "a body"), (7, "of nobody")],
    )
    table = corpus_exchange(sources, config)
    assert tuple(table.columns) == EXCHANGE_COLUMNS
    assert rows(table) == [
        (day("2000-05-06"), 2000, 5, "ann@corp", "CEO", "CC", "c@old", None, "RE: meet", "a body"),
        (day("2000-05-06"), 2000, 5, "ann@corp", "CEO", "TO", "bob@corp", "Manager", "RE: meet", "a body"),
        (day("2001-01-02"), 2001, 1, "a@old", "CEO", "TO", "a@old", "CEO", "x", None),
        (day("2002-12-31"), 2002, 12, "z@out", None, "BCC", "q@out", None, "y", None),
    ]


def test_period_and_incomplete_messages(corpus, config):
    sources = corpus(
        mails=[
            (1, "a", "0001-01-01", "s"), (2, "a", "1998-12-31", "s"), (3, "a", "1999-01-01", "s"), (4, "a", "2002-12-31", "s"),
            (5, "a", "2003-01-01", "s"), (6, None, "2000-01-01", "s"), (7, "a", None, "s"), (8, "a", "2000-01-01", None),
        ],
        recipients=[(m, "TO", "b") for m in range(1, 9)],
    )
    assert rows(build_exchange(sources, config), "year") == [(1999,), (2002,)]
    assert rows(profile.years_out_of_period(sources.messages, config)) == [(1, 1), (1998, 1), (2003, 1)]
    assert profile.incomplete_rows(sources, config).count() == 6


def test_an_address_is_looked_up_before_its_spaces_go(corpus, config):
    sources = corpus(
        staff=[("ab@x", "", "CEO")],
        mails=[(1, "a b@x", "2000-01-01", "s")],
        recipients=[(1, "TO", "ab@x"), (1, "TO", "a b@x")],
    )
    assert rows(build_exchange(sources, config), "sender", "status_sender", "recipient", "status_recipient") == [
        ("ab@x", None, "ab@x", "CEO"), ("ab@x", None, "ab@x", None)
    ]


def test_blank_aliases_match_only_on_request(corpus, config):
    sources = corpus(
        staff=[("a@x", "", "CEO"), ("b@x", "", "Manager"), ("c@x", "", "Trader"), ("d@x", None, "CEO")],
        mails=[(1, "s@x", "2000-01-01", "s")],
        recipients=[(1, "TO", ""), (1, "TO", None), (1, "TO", "a@x")],
    )
    assert rows(build_exchange(sources, config), "recipient", "status_recipient") == [
        ("", None), ("a@x", "CEO"), (None, None)
    ]
    blank = dataclasses.replace(config, match_blank=True)
    assert rows(build_exchange(sources, blank), "recipient", "status_recipient") == [
        ("", "CEO"), ("", "Manager"), ("", "Trader"), ("a@x", "CEO"), (None, "CEO")
    ]


def test_repeated_aliases_repeat_rows(corpus, config):
    # Two rows by primary and two by third address: every pair, first status first.
    sources = corpus(
        staff=[("a@x", "", "CEO"), ("a@x", "", "N/A"), ("b@x", "a@x", "Manager"), ("c@x", "a@x", None)],
        mails=[(1, "a@x", "2000-01-01", "s")],
        recipients=[(1, "TO", "z@x"), (1, "TO", "b@x")],
    )
    table = build_exchange(sources, config)
    assert rows(table.where("recipient = 'z@x'"), "status_sender") == [("CEO",), ("CEO",), ("Manager",), (None,)]
    assert rows(profile.row_preservation(sources, config)) == [
        ("message_join", 2, 2, True), ("status_lookup", 2, 8, False)
    ]
    assert dict(rows(profile.match_counts(sources, config))) == {
        "sender_primary": 2, "sender_third": 4, "sender_combined": 6,
        "recipient_primary": 4, "recipient_third": 0, "recipient_combined": 4,
    }


@pytest.mark.parametrize("match_blank", [False, True])
def test_row_counts_without_joining(spark, corpus, config, match_blank):
    """Counts worked out from multiplicities are those of the joins, with repeats, blanks and missing values."""
    pick = random.Random(5)
    address = lambda: pick.choice(["a@x", "b@x", "c@x", "", None, "z@x"])
    mid = lambda: pick.choice([1, 2, 3, 4, None])
    day = lambda: pick.choice(["2000-01-01", "2001-05-05", "1990-01-01", None])
    sources = corpus(
        staff=[(address(), address(), "CEO") for _ in range(9)],
        mails=[(mid(), address(), day(), pick.choice(["s", None])) for _ in range(30)],
        recipients=[(mid(), "TO", address()) for _ in range(25)],
        bodies=[(mid(), "text") for _ in range(8)],
    )
    config = dataclasses.replace(config, match_blank=match_blank)
    whole = profile.joined(sources, config)
    complete = whole.dropna(subset=["sender", "subject", "date"]).count()
    looked_up = build_exchange(sources, config).count()
    assert rows(profile.row_preservation(sources, config)) == [
        ("message_join", 25, whole.count(), False), ("status_lookup", complete, looked_up, False)
    ]
    assert looked_up > complete > 0


def test_copies_are_spread(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 5000), (4, 1024), (5, 1025)], "rid long, n long")
    found = replicated(df, F.col("n"), "rid")
    assert {r.rid: r["count"] for r in found.groupBy("rid").count().collect()} == {2: 1, 3: 5000, 4: 1024, 5: 1025}


@pytest.mark.parametrize("match_blank", [False, True])
def test_status_pairs_are_those_of_the_rows(corpus, config, match_blank):
    sources = corpus(
        staff=[("a@x", "", "CEO"), ("b@x", "", "N/A"), ("", "a@x", "Trader"), ("", "", "CEO"), (None, "c@x", "Manager"), (None, None, "CEO")],
        mails=[(1, "a@x", "2000-01-01", "s"), (2, "", "2000-01-01", "s"), (3, "q@x", "2000-01-01", "s")],
        recipients=[(m, t, a) for m in (1, 2, 3) for t in ("TO", "CC") for a in ("a@x", "", None, "c@x", "z@x")],
        bodies=[(2, "x"), (2, "y")],
    )
    config = dataclasses.replace(config, match_blank=match_blank)
    table = build_exchange(sources, config)
    by = ["rtype", "status_sender", "status_recipient"]
    assert rows(status_pairs(sources, config), *by, "n") == rows(table.groupBy(*by).agg(F.count("*").alias("n")), *by, "n")
    assert (table.count() > 100) == match_blank


def test_selectors_of_nothing(corpus, config):
    table = build_exchange(corpus(mails=[], recipients=[]), config)
    assert rows(profile.selector_values(table, config)) == [("first_month", None), ("last_month", None)]


def test_repeated_bodies_repeat_rows(corpus, config):
    sources = corpus(mails=[(1, "a", "2000-01-01", "s")], recipients=[(1, "TO", "b")], bodies=[(1, "x"), (1, "y")])
    assert rows(build_exchange(sources, config), "reference") == [("x",), ("y",)]


def test_text_keys_stand_for_bodies(corpus, config):
    sources = corpus(
        mails=[(m, "a", "2000-01-01", "s") for m in (1, 2, 3)],
        recipients=[(m, "TO", "b") for m in (1, 2, 3)],
        bodies=[(1, "same"), (2, "same")],
    )
    table = build_exchange(sources, config)
    assert rows(texts(sources, table), "reference") == [("same",)]
    assert rows(texts(sources, table.where("false")), "reference") == []
    back = with_text(table.select("text_key"), sources)
    assert rows(back, "reference") == [("same",), ("same",), (None,)]
    assert table.where(F.col("text_key").isNull()).count() == 1


def test_key_figures(corpus, config):
    sources = corpus(
        STAFF,
        mails=[(1, "ann@corp", "2000-01-01", "RE: a"), (2, "z@out", "2000-01-02", "b"), (3, "ann@corp", "2000-02-01", "RE: a")],
        recipients=[(1, "TO", "bob@corp"), (1, "CC", "q@out"), (2, "TO", "q@out"), (3, "TO", "bob@corp")],
    )
    table = build_exchange(sources, config)
    # Two of the four rows are one exchange; replies count all kinds of recipients.
    assert rows(volume.kpis(table, config)) == [(2, 2, 2, 2, 2, 100.0, 100.0)]
    assert rows(volume.external_share(table, config)) == [(1, "50%", 1, "50%")]
    assert rows(volume.internal_pairs(table, config)) == [(2,)]


def test_status_share_with_and_without_missing(corpus, config):
    staff = corpus(staff=STAFF).employees
    assert rows(volume.employee_status_share(staff, config), "status", "n", "perc", "labels") == [
        ("CEO", 1, 0.25, "25.00%"), ("Manager", 1, 0.25, "25.00%"), (None, 2, 0.5, "50.00%")
    ]
    assert rows(volume.employee_status_share(staff, config, False), "status", "labels") == [
        ("CEO", "50.00%"), ("Manager", "50.00%")
    ]


def test_profiles(corpus, config):
    sources = corpus(
        STAFF,
        mails=[(1, "ann@corp", "2000-01-01", "s"), (2, "a@old", "2000-01-01", "s"), (2, "a@old", "2000-01-01", None)],
        recipients=[(1, "TO", "bob@corp"), (1, "TO", "bob@corp"), (1, "TO", "")],
    )
    assert rows(profile.dimensions(sources)) == [
        ("employees", 4, 9), ("messages", 3, 5), ("recipients", 3, 4), ("references", 0, 3)
    ]
    assert rows(profile.blank_aliases(sources.employees)) == [
        ("email2", 4, 0, 0, 0), ("email3", 2, 0, 2, 2), ("email4", 4, 0, 0, 0), ("email_id", 0, 0, 4, 4)
    ]
    assert rows(profile.alias_coverage(sources, config).where("n > 0")) == [
        ("recipient", "email_id", 2), ("sender", "email3", 2), ("sender", "email_id", 1)
    ]
    assert rows(profile.repeated_ids(sources.messages)) == [("<2>", 2, 2)]
    assert rows(profile.category_profile(sources.messages, ["sender", "subject"], k=1)) == [
        ("sender", "level", "a@old", 2), ("sender", "other", None, 1), ("subject", "level", "s", 2),
        ("subject", "missing", None, 1),
    ]
    assert rows(profile.missing_values(sources.messages, ["sender", "subject"])) == [(3, "sender", 0), (3, "subject", 1)]
    assert profile.column_types(sources.messages)["date"] == "date"
