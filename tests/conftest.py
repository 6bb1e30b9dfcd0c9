from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from mailscope.config import CorpusConfig, Topic  # noqa: E402
from mailscope.schema import EMPLOYEES, MESSAGES, RECIPIENTS, REFERENCES  # noqa: E402
from mailscope.session import local_session  # noqa: E402
from mailscope.sources.tables import Sources  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def config():
    return CorpusConfig(
        internal_pattern="@corp",
        company_pattern="corp|Corp",
        generic_pattern="^all",
        topics=(Topic("meeting", "meet|time", "meet|time"), Topic("event", "SEC|fear", "SEC|fear")),
        words=("thank", "meet", "thank"),
        statuses=("CEO", "Manager", "Trader"),
        status_groups={"CEO": "Head"},
        topic_labels={"sum_subject_meeting": "Meeting subject", "sum_email_meeting": "Meeting text"},
        person_shortlist="ann|bob.x",
        persons={"sender": {"ann@corp": "Ann"}, "recipient": {"ann@corp": "Ann", "ann@home": "Ann"}},
        focus_address="ann@corp",
        focus_label="Ann",
        focus_status="CEO",
    )


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def corpus(spark):
    """Sources from short rows: staff ``(email, third, status)``, mails ``(mid, sender, day, subject)``,
    recipients ``(mid, rtype, address)`` numbered as they come, bodies ``(mid, text)``."""

    def make(staff=(), mails=(), recipients=(), bodies=()) -> Sources:
        return Sources(
            employees=spark.createDataFrame(
                [(i, "f", "l", a, "", b, "", "x", s) for i, (a, b, s) in enumerate(staff)], EMPLOYEES
            ),
            messages=spark.createDataFrame(
                [(m, s, day(d) if d else None, f"<{m}>", t) for m, s, d, t in mails], MESSAGES
            ),
            recipients=spark.createDataFrame(
                [(i, m, t, a) for i, (m, t, a) in enumerate(recipients, start=1)], RECIPIENTS
            ),
            references=spark.createDataFrame([(m, m, t) for m, t in bodies], REFERENCES),
        )

    return make


def rows(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
