"""Analyses on small corpora with answers worked out by hand."""

from __future__ import annotations

import datetime as dt

from mailscope.plans import activity, compare, external, flow, keywords, people, rank, topics, volume
from mailscope.plans.exchange import build_exchange
from tests.conftest import day, rows

STAFF = [("ann@corp", "", "CEO"), ("bob@corp", "", "Manager"), ("tom@corp", "", "Trader")]


def test_flow(corpus, config):
    table = build_exchange(
        corpus(
            STAFF,
            mails=[(1, "ann@corp", "2000-01-01", "s"), (2, "bob@corp", "2000-01-01", "s"), (3, "ann@corp", "2001-01-02", "s")],
            recipients=[(1, "TO", "bob@corp"), (1, "TO", "bob@corp"), (1, "TO", "ann@corp"), (1, "TO", "x@out"),
                        (2, "TO", "tom@corp"), (3, "TO", "bob@corp")],
        ),
        config,
    )
    daily = flow.flow_daily(table, config)
    assert rows(daily) == [
        (day("2000-01-01"), "Head", "Head", 2000, 1), (day("2000-01-01"), "Head", "Manager", 2000, 2),
        (day("2000-01-01"), "Manager", "Trader", 2000, 1), (day("2001-01-02"), "Head", "Manager", 2001, 1),
    ]
    assert rows(flow.flow_by_year(daily)) == [
        (2000, "Head", "Manager", 2), (2000, "Manager", "Trader", 1), (2001, "Head", "Manager", 1)
    ]
    assert rows(flow.flow_all_years(daily)) == [("Head", "Manager", 3), ("Manager", "Trader", 1)]
    matrix = flow.presence(daily, config.flow_labels)
    assert matrix.columns == ["status_sender", "Head", "Manager", "Trader"]
    assert rows(matrix) == [("Head", 0, 1, 0), ("Manager", 0, 0, 1)]
    assert rows(flow.presence(daily, config.flow_labels, 2001)) == [("Head", 0, 1, 0)]


def _texts(corpus, config):
    return corpus(
        STAFF,
        mails=[
            (1, "ann@corp", "2000-01-01", "meet"), (2, "ann@corp", "2000-01-01", "other"), (3, "ann@corp", "2000-01-05", "other"),
            (4, "bob@corp", "2000-02-01", "none"), (5, "bob@corp", "2000-02-02", "thank thank"),
        ],
        recipients=[(m, "TO", a) for m in (1, 2, 3, 4, 5) for a in ("x@out", "y@out")],
        bodies=[(1, "SEC meet thank thank"), (2, "plain"), (4, "")],
    )


def test_flags_and_empty_sums(corpus, config):
    sources = _texts(corpus, config)
    table = build_exchange(sources, config)
    mails = topics.topic_mails(table, "sender", config)
    assert rows(mails, "subject", *config.topic_flags) == [
        ("meet", 1, 0, 1, 1), ("none", 0, 0, 0, 0), ("other", 0, 0, 0, 0), ("other", 0, 0, None, None),
        ("thank thank", 0, 0, None, None),
    ]
    # February has no flag at all and is left out; a sum over NULLs alone would be 0.
    assert rows(topics.topic_months(table, "sender", config)) == [(day("2000-01-01"), 1, 0, 1, 1)]
    sums = topics.topic_sums(mails.where("subject = 'thank thank'"), ["year_month"], config)
    assert rows(sums) == [(day("2000-02-01"), 0, 0, 0, 0)]
    long = topics.topic_months_long(table, "sender", config, labels=["Meeting text"], start=dt.date(2000, 1, 1))
    assert rows(long) == [(day("2000-01-01"), "sum_email_meeting", 1)]
    assert rows(topics.topic_months_long(table, "sender", config, end=dt.date(1999, 12, 1))) == []
    assert rows(topics.monthly_distinct_mails(table, "recipient", config)) == [
        (day("2000-01-01"), 6), (day("2000-02-01"), 4)
    ]


def test_months_weigh_by_their_distinct_pairs(corpus, config):
    table = build_exchange(_texts(corpus, config), config)
    found = dict(rows(topics.topic_year_stats(table, config), "topics", "values"))
    # January: sum 1, three pairs; February: sum 0, two pairs.
    assert found["sum_subject_meeting_mean"] == 0.6
    assert found["sum_subject_meeting_median"] == 1.0
    assert found["sum_subject_meeting_sd"] == 0.55


def test_keywords(corpus, config):
    sources = _texts(corpus, config)
    table = build_exchange(sources, config)
    # A subject counts every occurrence, a body 2 however often it matches; a repeated word has two rows.
    assert rows(keywords.keyword_subject(table, config)) == [(1, "thank", 2), (2, "meet", 1), (3, "thank", 2)]
    assert rows(keywords.keyword_text(table, sources, config)) == [(1, "thank", 2), (2, "meet", 2), (3, "thank", 2)]
    # February has no topic, so its subject does not count here.
    assert rows(keywords.keyword_total(table, sources, config)) == [(1, "thank", 2), (2, "meet", 3), (3, "thank", 2)]
    status = keywords.keyword_status_total(table, "sender", sources, config)
    assert rows(status) == [("CEO", 1, "thank", 2), ("CEO", 2, "meet", 3), ("CEO", 3, "thank", 2)]


def test_top_words(spark, config):
    df = spark.createDataFrame(
        [("a", 1, "x", 12), ("a", 2, "y", 9), ("a", 3, "w", 12), ("b", 1, "x", 10), ("b", 2, "y", 40)],
        "g string, position int, word string, freq long",
    )
    assert rows(keywords.top_words(df, ["g"], 1, config), "g", "word") == [("a", "w"), ("b", "y")]
    assert [r["word"] for r in keywords.top_words(df, [], 3, config).collect()] == ["y", "w", "x"]


def test_filtering_first_differs_from_reducing_first(corpus, config):
    table = build_exchange(
        corpus(
            mails=[(1, "a@x", "2000-01-01", "s"), (2, "a@x", "2000-01-02", "s")],
            recipients=[(1, "CC", "b@x"), (2, "TO", "b@x")],
        ),
        config,
    )
    assert rows(rank.top_recipients_filter_first(table, config)) == [("b@x", 1, 1.0, "100.00%")]
    assert rows(rank.top_recipients_dedupe_first(table, config)) == []
    assert rows(rank.top_senders(table)) == [("a@x", 1, 1.0, "100.0%")]


def test_top_list_breaks_ties_by_address(corpus, config):
    table = build_exchange(
        corpus(
            mails=[(m, f"s{m:02}@x", "2000-01-01", "s") for m in range(12)],
            recipients=[(m, "TO", "b@x") for m in range(12)] + [(11, "TO", "c@x")],
        ),
        config,
    )
    top = rank.top_senders(table, k=3).collect()
    assert [(r["sender"], r["n"]) for r in top] == [("s11@x", 2), ("s00@x", 1), ("s01@x", 1)]
    assert top[0]["perc"] == 0.154


def test_conversations(corpus, config):
    table = build_exchange(
        corpus(
            mails=[(1, "p@out", "2000-01-01", "corp meet"), (2, "q@out", "2000-01-01", "corp meet"),
                   (3, "p@out", "2000-01-02", "corp meet"), (4, "p@out", "2000-01-02", "none")],
            recipients=[(1, "TO", "r@out"), (2, "TO", "ann@corp"), (3, "TO", "r@out"), (4, "TO", "r@out")],
            bodies=[(4, "about Corp time")],
        ),
        config,
    )
    outside, inside = external.external_exchanges(table, config), external.internal_exchanges(table, config)
    assert rows(outside, "date", "subject") == [(day("2000-01-02"), "corp meet"), (day("2000-01-02"), "none")]
    assert rows(inside, "sender") == [("p@out",), ("q@out",)]
    assert rows(external.external_count(table, config)) == [(2,)]
    assert rows(external.external_topics(table, config)) == [(day("2000-01-01"), 1, 0, 1, 0)]
    assert rows(external.external_subject_overlap(table, config), "sender", "subject", "sum_email_meeting") == [
        ("p@out", "corp meet", 1), ("q@out", "corp meet", 1)
    ]


def test_ratios(corpus, config):
    table = build_exchange(
        corpus(
            STAFF + [("cat@corp", "", "CEO")],
            mails=[(1, "ann@corp", "2000-01-01", "s"), (2, "cat@corp", "2000-01-01", "t"), (3, "ann@corp", "2000-01-02", "s")],
            recipients=[(1, "TO", "bob@corp"), (1, "TO", "x@out"), (1, "TO", "tom@corp"), (2, "TO", "bob@corp"), (3, "TO", "bob@corp")],
        ),
        config,
    )
    # Day one: 4 mails of 2 senders, which weighs twice; day two: 1 of 1.
    sent = activity.per_person_ratio_stats(table, "sender").first()
    assert (sent["n"], round(sent["mean"], 6), sent["max"]) == (3, round(5 / 3, 6), 2.0)
    # Received on day one from CEOs: 3 rows, 2 recipients.
    received = {r["status_recipient"]: r for r in activity.per_person_ratio_stats(table, "recipient").collect()}
    assert (received["Manager"]["n"], received["Manager"]["mean"]) == (2, 1.25)
    assert (received["Trader"]["n"], received["Trader"]["mean"]) == (1, 1.5)
    by_recipient = activity.per_person_ratio_stats(table, "recipient", by="recipient")
    assert {r["status_recipient"]: r["mean"] for r in by_recipient.collect()} == {"Manager": 1.5, "Trader": 1.0}
    assert rows(activity.extreme_day_senders(table, "CEO", k=1), "sender", "nb_send") == [("ann@corp", 4), ("cat@corp", 4)]
    assert rows(activity.extreme_day_senders(table, "CEO", ratio=1.0), "date") == [(day("2000-01-02"),)]
    stats = activity.active_people_stats(table).first()
    assert (stats["nb_sender_per_group_mean"], stats["nb_sender_per_group_max"]) == (1.8, 2.0)
    assert stats["nb_recipient_per_group_max"] == 1.0


def test_one_address_against_groups(corpus, config):
    table = build_exchange(
        corpus(
            STAFF + [("cat@corp", "", "CEO")],
            mails=[(1, "ann@corp", "2000-01-01", "s"), (2, "ann@corp", "2000-01-01", "t"), (3, "cat@corp", "2000-01-01", "s"),
                   (4, "z@out", "2000-01-02", "s")],
            recipients=[(1, "TO", "x@out"), (1, "TO", "y@out"), (2, "TO", "x@out"), (3, "TO", "ann@corp"), (4, "TO", "ann@corp"),
                        (4, "TO", "cat@corp")],
        ),
        config,
    )
    assert rows(compare.sent_counts(table, config), "source", "email_count") == [
        ("All", 1), ("All", 1), ("All", 2), ("All", 2), ("Ann", 1), ("Ann", 2),
        ("CEO status", 1), ("CEO status", 1), ("CEO status", 2),
    ]
    # The status group is counted per day, everyone per day and recipient.
    assert rows(compare.received_counts(table, config), "source", "email_count") == [
        ("All", 1), ("All", 1), ("All", 1), ("All", 1), ("All", 2), ("Ann", 1), ("Ann", 1),
        ("CEO status", 1), ("CEO status", 2),
    ]
    assert rank.address_status(table, "ann@corp").first()[0] == "CEO"


def test_persons(corpus, config):
    table = build_exchange(
        corpus(
            STAFF,
            mails=[(1, "z@out", "2000-01-01", "meet"), (2, "z@out", "2001-01-01", "s"), (3, "z@out", "2001-01-02", "t")],
            recipients=[(1, "TO", "ann@corp"), (2, "TO", "ann@home"), (3, "TO", "ann@corp"), (3, "TO", "bob_x@q"), (3, "TO", "bob@corp")],
        ),
        config,
    )
    # The dot is a wildcard; an unlisted variant stays under its own address.
    assert rows(people.person_monthly(table, "recipient", config)) == [
        ("Ann", 2000, 1, 1), ("Ann", 2001, 1, 2), ("bob_x@q", 2001, 1, 1)
    ]
    assert rows(people.person_year_stats(table, "recipient", config), "email_label_recipient", "n", "mean") == [
        ("Ann", 2, 1.5), ("bob_x@q", 1, 1.0)
    ]
    assert rows(people.person_topics(table, "recipient", config, "Ann", labels=["Meeting subject"]), "value") == [(0,), (1,)]
    assert people.person_mails(table, "sender", config).count() == 0


def test_invariants(corpus, config):
    table = build_exchange(_texts(corpus, config), config)
    outside = external.external_exchanges(table, config).count()
    assert outside + external.internal_exchanges(table, config).count() == table.count()
    assert sum(r["n"] for r in volume.monthly_volume(table).collect()) == table.count()
    wide = topics.topic_months(table, "sender", config).collect()
    long = topics.topic_months_long(table, "sender", config).collect()
    assert sum(sum(r[c] for c in config.topic_sums) for r in wide) == sum(r["value"] for r in long)
