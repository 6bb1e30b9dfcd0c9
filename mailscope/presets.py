"""Ready-made configurations."""

from __future__ import annotations

from mailscope.config import CorpusConfig, Topic

# ---------------------------------------------------------------------------
# The lists below decide which rows a query counts, so they are
# stated as they are. ``{company}`` stands for the organisation's own name,
# which is one of the searched words and the mail domain.
# ---------------------------------------------------------------------------

TOPIC_PATTERNS = {
    "meeting": "message|origin|pleas|email|thank|attach|file|copi|inform|receiv|thank|all|time|meet|look|week|day|dont|vinc|talk",
    "business_process": "{company}|deal|agreement|chang|contract|corp|fax|houston|date|america|risk|analy|confidential|correction",
    "core_business": "market|gas|price|power|company|energy|trade|busi|servic|manag",
    "company_event": "bankrup|SEC|MTM|fear|losing money|10-K|fears|investigation|phone|fax|document|testimony|witness|deposition",
}

TOPIC_LABELS = {
    "sum_subject_business_process": "Business process email subject",
    "sum_subject_core_business": "Core Business email subject",
    "sum_subject_meeting": "Meeting email subject",
    "sum_subject_company_event": "Company Event email subject",
    "sum_email_business_process": "Business process email text",
    "sum_email_core_business": "Core business email text",
    "sum_email_meeting": "Meeting email text",
    "sum_email_company_event": "Company's event email text",
}

WORDS = (
    "message", "origin", "pleas", "email", "thank", "attach", "file", "copi", "inform", "receiv", "thank",
    "time", "meet", "look", "week", "dont", "vinc", "talk", "{company}", "deal", "agreement", "chang",
    "contract", "corp", "fax", "houston", "america", "risk", "analy", "confidential", "correction", "market",
    "gas", "price", "power", "company", "energy", "trade", "busi", "servic", "manag", "bankrup", "SEC", "MTM",
    "fear", "investigation", "mark-to-market", "10-K", "losing money", "correction", "phone", "fax",
    "document", "testimony", "deposition", "witness",
)

STATUSES = (
    "Employee", "CEO", "Manager", "Director", "Vice President", "Trader", "President", "Managing Director",
    "In House Lawyer",
)

# The first label is spelled this way in the published results.
STATUS_GROUPS = {
    "Managing Director": "Manger - Director",
    "Manager": "Manger - Director",
    "Director": "Manger - Director",
    "CEO": "CEO - President",
    "Vice President": "CEO - President",
    "President": "CEO - President",
}

GENERIC_PATTERN = (
    "^{company}|^press|^office|^all|^announcement|^communications|affair|client|contact|secur|team|comit|^west|energy"
)

PERSON_SHORTLIST = (
    "jeff.dasovich|andrew.baker|tim.belden|andrew.fastow|lfastow|vkaminski|jordan.mintz|jeff.skilling"
    "|sherron.watkins|richard.causey|greg.whalley"
)

SENDER_LABELS = {
    "jeff.dasovich@{company}.com": "Jeff Dasovich",
    "kenneth.lay@{company}.com": "Kenneth Lay",
    "jeff.skilling@{company}.com": "Jeffrey Skilling",
    "andrew.baker@{company}.com": "Andrew Baker",
    "tim.belden@{company}.com": "Timothy Belden",
    "lfastow@pop.pdq.net": "Lea Fastow",
    "lfastow@pdq.net": "Lea Fastow",
    "andrew.fastow@{company}.com": "Andrew Fastow",
    "vkaminski@{company}.com": "Vincent Kaminski",
    "vkaminski@aol.com": "Vincent Kaminski",
    "vkaminski@palm.net": "Vincent Kaminski",
    "jordan.mintz@{company}.com": "Jordan Mintz",
    "sherron.watkins@{company}.com": "Sherron Watkins",
    "richard.causey@{company}.com": "Richard Causey",
    "greg.whalley@{company}.com": "Greg Whalley",
}

# Only addresses the sender list lacks.
EXTRA_RECIPIENT_LABELS = {
    "jeff_dasovich@ees.{company}.com": "Jeff Dasovich",
    "jeff_skilling@{company}.com": "Jeffrey Skilling",
    "tim_belden@pgn.com": "Timothy Belden",
    "andrew.fastow@ljminvestments.com": "Andrew Fastow",
    "vkaminski@aol .com": "Vincent Kaminski",
    "vkaminski@ol.com": "Vincent Kaminski",
    "jordan_mintz@{company}.com": "Jordan Mintz",
}

FOCUS = {"address": "jeff.dasovich@{company}.com", "label": "Jeff Dasovich", "status": "Employee"}


def energy_trader(company: str) -> CorpusConfig:
    """Configuration of the energy-trading corpus of 1999-2002.

    ``company`` is the organisation's name in lower case, as in its mail domain.
    """

    def named(text: str) -> str:
        return text.replace("{company}", company)

    senders = {named(alias): label for alias, label in SENDER_LABELS.items()}
    extra = {named(alias): label for alias, label in EXTRA_RECIPIENT_LABELS.items()}
    return CorpusConfig(
        internal_pattern=f"@{company}",
        company_pattern=f"{company}|{company.capitalize()}",
        generic_pattern=named(GENERIC_PATTERN),
        topics=tuple(Topic(name, named(p), named(p)) for name, p in TOPIC_PATTERNS.items()),
        words=tuple(named(word) for word in WORDS),
        statuses=STATUSES,
        status_groups=STATUS_GROUPS,
        topic_labels=TOPIC_LABELS,
        person_shortlist=PERSON_SHORTLIST,
        persons={"sender": senders, "recipient": senders | extra},
        focus_address=named(FOCUS["address"]),
        focus_label=FOCUS["label"],
        focus_status=FOCUS["status"],
    )
