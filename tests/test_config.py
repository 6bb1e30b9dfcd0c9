from __future__ import annotations

from mailscope.presets import energy_trader


def test_preset_names_the_company_everywhere():
    config = energy_trader("acme")
    assert config.internal_pattern == "@acme" and config.company_pattern == "acme|Acme"
    assert len(config.words) == 56 and config.words[18] == "acme"
    assert config.topics[1].subject_pattern.startswith("acme|deal")
    assert config.persons["sender"]["jeff.skilling@acme.com"] == "Jeffrey Skilling"
    assert len(config.persons["recipient"]) == len(config.persons["sender"]) + 7
    assert config.flow_labels == ["CEO - President", "Employee", "In House Lawyer", "Manger - Director", "Trader"]
    assert set(config.topic_labels) == set(config.topic_sums)
    assert config.topics_labelled(["Meeting email text"]) == ["sum_email_meeting"]
