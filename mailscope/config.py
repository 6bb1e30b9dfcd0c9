"""What a corpus analysis is parameterised by."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Topic:
    """A named pair of regular expressions, one for subjects and one for bodies."""

    name: str
    subject_pattern: str
    email_pattern: str

    @property
    def subject_flag(self) -> str:
        return f"subject_{self.name}"

    @property
    def email_flag(self) -> str:
        return f"email_{self.name}"

    @property
    def flags(self) -> tuple[str, str]:
        return (self.subject_flag, self.email_flag)

    @property
    def sums(self) -> tuple[str, str]:
        return (f"sum_{self.subject_flag}", f"sum_{self.email_flag}")


@dataclass(frozen=True)
class CorpusConfig:
    """Every constant of the analyses; the operators themselves hold none."""

    internal_pattern: str
    company_pattern: str
    generic_pattern: str
    topics: tuple[Topic, ...]
    words: tuple[str, ...]
    statuses: tuple[str, ...]
    status_groups: Mapping[str, str] = field(default_factory=dict)
    topic_labels: Mapping[str, str] = field(default_factory=dict)
    person_shortlist: str = ""
    persons: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    focus_address: str = ""
    focus_label: str = ""
    focus_status: str = ""
    period_start: dt.date = dt.date(1999, 1, 1)
    period_end: dt.date = dt.date(2002, 12, 31)
    missing_status: str = "N/A"
    reply_pattern: str = "^RE:"
    direct_rtype: str = "TO"
    min_word_frequency: int = 10
    text_hit_weight: int = 2
    match_blank: bool = False

    @property
    def topic_flags(self) -> list[str]:
        """Flag columns, subjects first."""
        return [t.subject_flag for t in self.topics] + [t.email_flag for t in self.topics]

    @property
    def topic_sums(self) -> list[str]:
        """Monthly sum columns, in the order of :attr:`topic_flags`."""
        return [f"sum_{flag}" for flag in self.topic_flags]

    @property
    def subject_sums(self) -> list[str]:
        return [f"sum_{t.subject_flag}" for t in self.topics]

    @property
    def flow_labels(self) -> list[str]:
        """The distinct status labels left after merging."""
        merged = [self.status_groups.get(s, s) for s in self.statuses]
        return sorted(set(merged))

    def topics_labelled(self, labels: list[str]) -> list[str]:
        """Sum columns whose display label is among ``labels``."""
        return [key for key, label in self.topic_labels.items() if label in labels]
