"""Every analysis under a name, over the shared test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscope.config import CorpusConfig
from mailscope.operators.rank import peek
from mailscope.plans import activity, compare, exchange, external, flow, keywords, people, profile, rank, topics, volume
from mailscope.sources.tables import Sources
from mailscope.sources.testbed import TESTBED, testbed_sources, with_blank_addresses

Query = Callable[[SparkSession, str], DataFrame]
Analysis = Callable[[DataFrame, Sources, CorpusConfig], DataFrame]

SIDES = {"sent": "sender", "received": "recipient"}

# Choices a dashboard reader could make.
STATUS = "HOUSEHOLD"
PERSON = "Person A"
EXTREME_RATIO = 9.0
CHOICE = {
    "start": dt.date(2000, 1, 1),
    "end": dt.date(2000, 12, 1),
    "labels": ["Meeting subject", "Core text", "Event subject"],
}


#: Decimals of doubles, so that the last bits of a float sum do not decide a comparison.
DIGITS, FINER = 6, {"density": 9}
#: Probabilities can be very small; they have so many significant digits instead.
PROBABILITIES, SIGNIFICANT = ("p", "p_adjusted"), 6


def _rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)

    def shown(name: str) -> F.Column:
        c = F.col(name)
        if kinds[name] != "double":
            return c
        if name in PROBABILITIES:
            return F.when(c.isNotNull(), F.format_string(f"%.{SIGNIFICANT - 1}e", c).cast("double")).alias(name)
        return F.round(c, FINER.get(name, DIGITS)).alias(name)

    return df.select(*map(shown, df.columns))


def _per_side() -> dict[str, Callable[[str], Analysis]]:
    return {
        "monthly_distinct_mails": lambda s: lambda x, _, c: topics.monthly_distinct_mails(x, s, c),
        "daily_status_stats": lambda s: lambda x, _, c: volume.daily_status_stats(x, s),
        "daily_status_box": lambda s: lambda x, _, c: volume.daily_status_box(x, s),
        "daily_status_box_clipped": lambda s: lambda x, _, c: volume.daily_status_box(x, s, (0, 15)),
        "daily_status_anova": lambda s: lambda x, _, c: volume.daily_status_anova(x, s),
        "daily_status_anova_clipped": lambda s: lambda x, _, c: volume.daily_status_anova(x, s, (0, 6)),
        "daily_status_pairwise": lambda s: lambda x, _, c: volume.daily_status_pairwise(x, s),
        "daily_status_density": lambda s: lambda x, _, c: volume.daily_status_density(x, s),
        "per_person_ratio_stats": lambda s: lambda x, _, c: activity.per_person_ratio_stats(x, s),
        "per_person_ratio_anova": lambda s: lambda x, _, c: activity.per_person_ratio_anova(x, s),
        "per_person_ratio_box": lambda s: lambda x, _, c: activity.per_person_ratio_box(x, s),
        "per_person_ratio_density": lambda s: lambda x, _, c: activity.per_person_ratio_density(x, s),
        "active_people_box": lambda s: lambda x, _, c: activity.active_people_box(x, s),
        "active_people_density": lambda s: lambda x, _, c: activity.active_people_density(x, s),
        "active_people_by_status": lambda s: lambda x, _, c: activity.active_people_by_status(x, s),
        "yearly_status_stats": lambda s: lambda x, _, c: volume.yearly_status_stats(x, s),
        "monthly_status_volume": lambda s: lambda x, _, c: volume.monthly_status_volume(x, s),
        "monthly_one_status_volume": lambda s: lambda x, _, c: volume.monthly_status_volume(x, s, STATUS),
        "topic_flags": lambda s: lambda x, t, c: exchange.with_text(topics.topic_mails(x, s, c), t),
        "topic_month_wide": lambda s: lambda x, _, c: topics.topic_months(x, s, c),
        "topic_month_long": lambda s: lambda x, _, c: topics.topic_months_long(x, s, c),
        "topic_month_chosen": lambda s: lambda x, _, c: topics.topic_months_long(x, s, c, **CHOICE),
        "topic_status_long": lambda s: lambda x, _, c: topics.topic_status_long(x, s, c),
        "topic_status_chosen": lambda s: lambda x, _, c: topics.topic_status_long(x, s, c, STATUS, **CHOICE),
        "keyword_total": lambda s: lambda x, t, c: keywords.keyword_total(x, t, c),
        "keyword_top": lambda s: lambda x, t, c: keywords.top_words(
            keywords.keyword_total(x, t, c), [], len(c.words), c
        ),
        "keyword_status_total": lambda s: lambda x, t, c: keywords.keyword_status_total(x, s, t, c),
        "keyword_top_status": lambda s: lambda x, t, c: keywords.keyword_top_status(x, s, t, c),
        "compare_stats": lambda s: lambda x, _, c: compare.compare_stats(x, s, c),
        "compare_box": lambda s: lambda x, _, c: compare.compare_box(x, s, c),
        "compare_welch": lambda s: lambda x, _, c: compare.compare_welch(x, s, c),
        "compare_welch_clipped": lambda s: lambda x, _, c: compare.compare_welch(x, s, c, (-10, 5)),
        "compare_density": lambda s: lambda x, _, c: compare.compare_density(x, s, c),
        "person_mails": lambda s: lambda x, t, c: exchange.with_text(people.person_mails(x, s, c), t),
        "person_year_stats": lambda s: lambda x, _, c: people.person_year_stats(x, s, c),
        "person_monthly": lambda s: lambda x, _, c: people.person_monthly(x, s, c),
        "person_topics": lambda s: lambda x, _, c: people.person_topics(x, s, c),
        "person_topics_chosen": lambda s: lambda x, _, c: people.person_topics(x, s, c, PERSON, **CHOICE),
    }


def _analyses() -> dict[str, Analysis]:
    single: dict[str, Analysis] = {
        "corpus_exchange": lambda x, t, c: x.select(*exchange.EXCHANGE_COLUMNS),
        "kpis": lambda x, t, c: volume.kpis(x, c),
        "internal_pairs": lambda x, t, c: volume.internal_pairs(x, c),
        "generic_rows": lambda x, t, c: volume.generic_rows(x, c),
        "status_pairs": lambda x, t, c: exchange.status_pairs(t, c),
        "status_pairs_match_blank": lambda x, t, c: exchange.status_pairs(with_blank_addresses(t), replace(c, match_blank=True)),
        "external_share": lambda x, t, c: volume.external_share(x, c),
        "external_count": lambda x, t, c: external.external_count(x, c),
        "conversation_flags": lambda x, t, c: external.with_internal_counts(x, c).select(
            "date", "sender", "recipient", "subject", "sum_sender", "sum_recipient"
        ),
        "external_exchanges": lambda x, t, c: exchange.with_text(external.external_exchanges(external.chosen_columns(
            x, ["date", "year", "month", "sender", "recipient", "subject", "text_key"]
        ), c), t),
        "internal_exchanges": lambda x, t, c: exchange.with_text(external.internal_exchanges(external.chosen_columns(
            x, ["date", "sender", "recipient", "subject", "text_key"]
        ), c), t, most=True),
        "external_topics": lambda x, t, c: external.external_topics(x, c),
        "external_topics_long": lambda x, t, c: external.external_topics_long(x, c),
        "external_subject_overlap": lambda x, t, c: exchange.with_text(external.external_subject_overlap(x, c), t),
        "employee_status_share": lambda x, t, c: volume.employee_status_share(t.employees, c),
        "employee_status_share_known": lambda x, t, c: volume.employee_status_share(t.employees, c, False),
        "monthly_volume": lambda x, t, c: volume.monthly_volume(x),
        "per_person_ratio_stats_by_recipient": lambda x, t, c: activity.per_person_ratio_stats(
            x, "recipient", by="recipient"
        ),
        "extreme_day": lambda x, t, c: activity.extreme_day_senders(x, STATUS),
        "extreme_day_equal": lambda x, t, c: activity.extreme_day_senders(x, STATUS, ratio=EXTREME_RATIO),
        "active_people_stats": lambda x, t, c: activity.active_people_stats(x),
        "flow_daily": lambda x, t, c: flow.flow_daily(x, c),
        "flow_by_year": lambda x, t, c: flow.flow_by_year(flow.flow_daily(x, c)),
        "flow_all_years": lambda x, t, c: flow.flow_all_years(flow.flow_daily(x, c)),
        "flow_presence": lambda x, t, c: flow.presence(flow.flow_daily(x, c), c.flow_labels),
        "flow_presence_2000": lambda x, t, c: flow.presence(flow.flow_daily(x, c), c.flow_labels, 2000),
        "topic_year_stats": lambda x, t, c: topics.topic_year_stats(x, c),
        "word_count_stats": lambda x, t, c: topics.word_count_stats(x),
        "body_share": lambda x, t, c: topics.body_share(x),
        "keyword_subject": lambda x, t, c: keywords.keyword_subject(x, c),
        "keyword_positions": lambda x, t, c: keywords.keyword_positions(t, c),
        "keyword_text": lambda x, t, c: keywords.keyword_text(x, t, c),
        "top_senders": lambda x, t, c: rank.top_senders(x),
        "top_recipients_filter_first": lambda x, t, c: rank.top_recipients_filter_first(x, c),
        "top_recipients_dedupe_first": lambda x, t, c: rank.top_recipients_dedupe_first(x, c),
        "first_exchanges": lambda x, t, c: exchange.with_text(rank.first_exchanges(x), t),
        "address_status": lambda x, t, c: rank.address_status(x, c.focus_address),
        "profile_dimensions": lambda x, t, c: profile.dimensions(t),
        "profile_missing_values": lambda x, t, c: profile.missing_values(t.employees, t.employees.columns),
        "profile_all_missing_values": lambda x, t, c: profile.all_missing_values(t),
        "profile_employee_categories": lambda x, t, c: profile.category_profile(
            t.employees, ["first_name", "last_name", "email_id", "email3", "folder"]
        ),
        "profile_message_id_categories": lambda x, t, c: profile.category_profile(t.messages, ["message_id"]),
        "profile_employee_numbers": lambda x, t, c: profile.numeric_profile(t.employees, ["eid"]),
        "profile_message_numbers": lambda x, t, c: profile.numeric_profile(t.messages, ["mid"]),
        "profile_recipient_numbers": lambda x, t, c: profile.numeric_profile(t.recipients, ["mid"]),
        "profile_reference_numbers": lambda x, t, c: profile.numeric_profile(t.references, ["rfid", "mid"]),
        "profile_ratio_numbers": lambda x, t, c: profile.numeric_profile(
            activity.sent_ratio(x), ["nb_send", "nb_sender_per_gp", "ratio_nb_email"]
        ),
        "profile_message_dates": lambda x, t, c: profile.date_profile(t.messages, "date"),
        "profile_categories": lambda x, t, c: profile.category_profile(t.messages, ["sender", "subject"]),
        "profile_recipient_categories": lambda x, t, c: profile.category_profile(t.recipients, ["rtype", "rvalue"]),
        "profile_status_categories": lambda x, t, c: profile.category_profile(t.employees, ["status"], 3),
        "profile_blank_aliases": lambda x, t, c: profile.blank_aliases(t.employees),
        "profile_out_of_period": lambda x, t, c: profile.years_out_of_period(t.messages, c),
        "profile_repeated_ids": lambda x, t, c: profile.repeated_ids(t.messages),
        "profile_ids_with_several_mids": lambda x, t, c: profile.ids_with_several_mids(t.messages),
        "profile_alias_coverage": lambda x, t, c: profile.alias_coverage(t, c),
        "profile_row_preservation": lambda x, t, c: profile.row_preservation(t, c),
        "profile_incomplete_rows": lambda x, t, c: profile.incomplete_rows(t, c),
        "profile_text_period": lambda x, t, c: profile.text_period(t, c),
        "profile_match_counts": lambda x, t, c: profile.match_counts(t, c),
        "profile_selectors": lambda x, t, c: profile.selector_values(x, c),
        "peek_messages": lambda x, t, c: peek(t.messages, "mid", 1, 10),
        "peek_references": lambda x, t, c: peek(t.references, "mid", 5, 10),
    }
    for name, make in _per_side().items():
        for suffix, side in SIDES.items():
            single[f"{name}_{suffix}"] = make(side)
    return single


@lru_cache(maxsize=8)
def _testbed(spark: SparkSession, sf_dir: str) -> tuple[Sources, DataFrame]:
    """The sources and the exchange table as plans; nothing is computed or kept."""
    sources = testbed_sources(spark, sf_dir)
    return sources, exchange.build_exchange(sources, TESTBED)


def _query(analysis: Analysis) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources, exchanged = _testbed(spark, sf_dir)
        return _rounded(analysis(exchanged, sources, TESTBED))

    return run


def queries() -> dict[str, Query]:
    return {name: _query(analysis) for name, analysis in _analyses().items()}
