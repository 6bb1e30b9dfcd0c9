"""Every registered query restated as SQL for an independent engine.

The statements follow the definition of each figure step by step (four alias joins, windows over
rows, rows repeated as often as they count) rather than the way the library computes it.
"""

from __future__ import annotations

from mailscope.catalog import CHOICE, EXTREME_RATIO, FINER, PERSON, SIDES, SIGNIFICANT, STATUS
from mailscope.sources.testbed import TESTBED as C

FLAGS, SUMS = C.topic_flags, C.topic_sums
WORDS = list(enumerate(C.words, start=1))
#: Name of each source here, and the types its columns have. Recipients are numbered by their whole row.
ROW = (
    "struct<l_orderkey:bigint,l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_extendedprice:double,"
    "l_discount:double,l_tax:double,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz>"
)
COLUMN_TYPES = {
    "employees": ("employees", {"eid": "bigint"} | dict.fromkeys(
        ("first_name", "last_name", "email_id", "email2", "email3", "email4", "folder", "status"), "string"
    )),
    "messages": ("messages", {"mid": "bigint", "sender": "string", "date": "date", "message_id": "string", "subject": "string"}),
    "recipients": ("recipients", {"rid": ROW, "mid": "bigint", "rtype": "string", "rvalue": "string"}),
    "references": ("refs", {"rfid": "bigint", "mid": "bigint", "reference": "string"}),
}
MATCH = "regexp_matches({0}, '{1}')"

BASE = f"""
employees AS (
  SELECT c_custkey AS eid, c_name AS first_name, '' AS last_name,
    'cust' || c_custkey || '@corp.example' AS email_id, '' AS email2,
    CASE WHEN c_custkey % 3 <> 0 THEN 'supp' || c_custkey || '@corp.example' ELSE '' END AS email3, '' AS email4,
    'folder-' || c_nationkey AS folder,
    CASE WHEN c_custkey % 5 = 0 THEN 'N/A' WHEN c_custkey % 149 = 1 THEN NULL ELSE c_mktsegment END AS status
  FROM customer),
messages AS (
  SELECT o_orderkey AS mid,
    CASE WHEN o_custkey % 4 = 0 THEN 'ext' || (o_custkey % 40) || '@mail.example'
         WHEN o_custkey % 50 = 7 THEN 'cust ' || o_custkey || '@corp.example'
         ELSE 'cust' || o_custkey || '@corp.example' END AS sender,
    CAST(o_orderdate AS DATE) AS date, '<' || (o_orderkey - CASE WHEN o_orderkey % 40 = 1 THEN 1 ELSE 0 END) || '@mail>' AS message_id,
    CASE o_orderstatus WHEN 'F' THEN 'RE: ' WHEN 'P' THEN 'FW: ' ELSE '' END
      || o_orderpriority || ' ' || (o_orderkey % 200) AS subject
  FROM orders),
recipients AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rid, l_orderkey AS mid,
    CASE l_returnflag WHEN 'R' THEN 'TO' WHEN 'A' THEN 'CC' ELSE 'BCC' END AS rtype,
    CASE l_linenumber % 3 WHEN 0 THEN 'supp' || l_suppkey || '@corp.example'
         WHEN 1 THEN 'cust' || l_partkey || '@corp.example'
         ELSE 'ext' || (l_partkey % 97) || '@mail.example' END AS rvalue
  FROM lineitem),
refs AS (SELECT doc_id AS rfid, doc_id AS mid, text AS reference FROM documents),
staff AS (SELECT *, nullif(status, 'N/A') AS known FROM employees),
joined AS (
  SELECT r.rid, r.mid, r.rtype, r.rvalue, m.sender, m.date, m.subject, b.reference
  FROM recipients r
  LEFT JOIN (SELECT * FROM messages WHERE year(date) IN (1999, 2000, 2001, 2002)) m ON r.mid = m.mid
  LEFT JOIN refs b ON r.mid = b.mid),
complete AS (SELECT * FROM joined WHERE sender IS NOT NULL AND subject IS NOT NULL AND date IS NOT NULL),
s1 AS (SELECT c.*, e.known AS sp FROM complete c LEFT JOIN staff e ON c.sender = e.email_id AND e.email_id <> ''),
s2 AS (SELECT c.*, e.known AS st FROM s1 c LEFT JOIN staff e ON c.sender = e.email3 AND e.email3 <> ''),
r1 AS (SELECT c.*, e.known AS rp FROM s2 c LEFT JOIN staff e ON c.rvalue = e.email_id AND e.email_id <> ''),
r2 AS (SELECT c.*, e.known AS rt FROM r1 c LEFT JOIN staff e ON c.rvalue = e.email3 AND e.email3 <> ''),
exchange AS (
  SELECT rid, date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
    CAST(date_trunc('month', date) AS DATE) AS year_month,
    replace(sender, ' ', '') AS sender, coalesce(sp, st) AS status_sender, rtype,
    replace(rvalue, ' ', '') AS recipient, coalesce(rp, rt) AS status_recipient, subject, reference
  FROM r2)"""


def _match(column: str, pattern: str) -> str:
    return MATCH.format(column, pattern)


def _query(select: str, **ctes: str) -> str:
    extra = "".join(f",\n{name} AS ({body})" for name, body in ctes.items())
    return f"WITH {BASE}{extra}\n{select}"


def _recursive(select: str, cf: str, **ctes: str) -> str:
    extra = "".join(f",\n{name} AS ({body})" for name, body in ctes.items())
    return f"WITH RECURSIVE {BASE}{extra},\ncf AS ({cf})\n{select}"


def _r(expression: str, digits: int = 6) -> str:
    return f"ROUND(CAST({expression} AS DECIMAL(32, 12)), {digits})::DOUBLE"


def _probability(expression: str) -> str:
    return f"CAST(printf('%.{SIGNIFICANT - 1}e', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def _big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def _statistics(value: str, digits: int = 6, prefix: str = "") -> str:
    columns = {
        "mean": f"avg({value})", "median": f"quantile_cont({value}, 0.5)", "sd": f"stddev_samp({value})",
        "min": f"min({value})", "q1": f"quantile_cont({value}, 0.25)", "q3": f"quantile_cont({value}, 0.75)",
        "max": f"max({value})",
    }
    return ", ".join(f"{_r(c, digits)} AS {prefix}{name}" for name, c in columns.items())


def _describe(table: str, by: str, value: str, digits: int = 6) -> str:
    return f"SELECT {by}, count(*) AS n, {_statistics(value, digits)} FROM {table} GROUP BY {by}"


# --- tests --------------------------------------------------------------------------------------

_BETA_ARGS = """
  SELECT *, x > (a + 1) / (a + b + 2) AS swap,
    CASE WHEN x > (a + 1) / (a + b + 2) THEN b ELSE a END AS p,
    CASE WHEN x > (a + 1) / (a + b + 2) THEN a ELSE b END AS q,
    CASE WHEN x > (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS z
  FROM beta_in"""

_BETA_STEPS = """
  SELECT id, p, q, z, 0 AS m, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * z / (p + 1)) AS d,
    1 / (1 - (p + q) * z / (p + 1)) AS h FROM beta_args WHERE x > 0 AND x < 1
  UNION ALL
  SELECT id, p, q, z, m, 1 + o / c1, 1 / (1 + o * d1), h1 * (1 + o / c1) / (1 + o * d1) FROM (
    SELECT *, -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)) AS o, h * c1 * d1 AS h1 FROM (
      SELECT *, 1 + e / c AS c1, 1 / (1 + e * d) AS d1 FROM (
        SELECT *, m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)) AS e FROM (
          SELECT id, p, q, z, m + 1 AS m, c, d, h FROM cf WHERE m < 200))))"""

_P_VALUE = """CASE WHEN i.x >= 1 THEN 1 WHEN i.x <= 0 THEN 0
  WHEN i.swap THEN 1 - exp(lgamma(i.p + i.q) - lgamma(i.p) - lgamma(i.q) + i.p * ln(i.z) + i.q * ln(1 - i.z)) / i.p * f.h
  ELSE exp(lgamma(i.p + i.q) - lgamma(i.p) - lgamma(i.q) + i.p * ln(i.z) + i.q * ln(1 - i.z)) / i.p * f.h END"""

_P_FROM = "FROM beta_args i LEFT JOIN (SELECT id, h FROM cf WHERE m = 200) f ON i.id = f.id"


def _anova(values: str, **ctes: str) -> str:
    """``values`` selects (g, v)."""
    test = """
      SELECT 1 AS id, (b / (k - 1)) / (w / (n - k)) AS stat, (k - 1)::DOUBLE AS df1, (n - k)::DOUBLE AS df2 FROM (
        SELECT count(DISTINCT g) AS k, count(*) AS n, sum((gm - m) * (gm - m)) AS b, sum((v - gm) * (v - gm)) AS w
        FROM (SELECT g, v, avg(v) OVER (PARTITION BY g) AS gm, avg(v) OVER () AS m FROM vals))"""
    beta = "SELECT *, df2 / 2 AS a, df1 / 2 AS b, df2 / (df2 + df1 * stat) AS x FROM test"
    select = (
        f"SELECT {_r('i.stat')} AS f, i.df1 AS df_between, i.df2 AS df_within, {_probability(_P_VALUE)} AS p {_P_FROM}"
    )
    return _recursive(select, _BETA_STEPS, **ctes, vals=values, test=test, beta_in=beta, beta_args=_BETA_ARGS)


def _pairwise(values: str, **ctes: str) -> str:
    groups = "SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM vals GROUP BY g"
    pooled = "SELECT sum(n - 1)::DOUBLE AS df, sqrt(sum((n - 1) * s) / sum(n - 1)) AS sd, count(*) AS k FROM grp"
    test = """SELECT row_number() OVER () AS id, x.g AS ga, y.g AS gb, df, k * (k - 1) / 2 AS tests,
      (x.m - y.m) / (sd * sqrt(1.0 / x.n + 1.0 / y.n)) AS stat FROM grp x, grp y, pooled WHERE x.g < y.g"""
    beta = "SELECT *, df / 2 AS a, 0.5::DOUBLE AS b, df / (df + stat * stat) AS x FROM test"
    select = f"""SELECT i.ga AS group_a, i.gb AS group_b, {_r('i.stat')} AS t, i.df AS df, {_probability(_P_VALUE)} AS p,
      {_probability(f'least(1, i.tests * ({_P_VALUE}))')} AS p_adjusted {_P_FROM}"""
    return _recursive(
        select, _BETA_STEPS, **ctes, vals=values, grp=groups, pooled=pooled, test=test, beta_in=beta,
        beta_args=_BETA_ARGS,
    )


def _welch(values: str, reference: str, **ctes: str) -> str:
    groups = "SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) / count(*) AS e FROM vals GROUP BY g"
    test = f"""SELECT row_number() OVER () AS id, x.g AS ga, y.g AS gb, (x.m - y.m) / sqrt(x.e + y.e) AS stat,
      pow(x.e + y.e, 2) / (x.e * x.e / (x.n - 1) + y.e * y.e / (y.n - 1)) AS df
      FROM grp x, grp y WHERE x.g = '{reference}' AND y.g <> '{reference}'"""
    beta = "SELECT *, df / 2 AS a, 0.5::DOUBLE AS b, df / (df + stat * stat) AS x FROM test"
    select = f"""SELECT i.ga AS group_a, i.gb AS group_b, {_r('i.stat')} AS t, {_r('i.df')} AS df,
      {_probability(_P_VALUE)} AS p {_P_FROM}"""
    return _recursive(
        select, _BETA_STEPS, **ctes, vals=values, grp=groups, test=test, beta_in=beta, beta_args=_BETA_ARGS
    )


def _box(values: str, name: str, **ctes: str) -> str:
    hinges = """SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3
      FROM vals GROUP BY g"""
    select = f"""SELECT v.g AS {name}, count(*) AS n,
      min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END)::DOUBLE AS lower_whisker, {_r('any_value(q1)')} AS q1,
      {_r('any_value(q2)')} AS median, {_r('any_value(q3)')} AS q3,
      max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END)::DOUBLE AS upper_whisker
      FROM vals v JOIN hinges h ON v.g = h.g GROUP BY v.g"""
    return _query(select, **ctes, vals=values, hinges=hinges)


def _density(values: str, name: str, points: int, **ctes: str) -> str:
    sized = """SELECT g, count(*) AS n, min(v) AS lo, max(v) AS hi, 0.9 * pow(count(*), -0.2) * CASE
        WHEN quantile_cont(v, 0.75) > quantile_cont(v, 0.25)
        THEN least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34)
        ELSE stddev_samp(v) END AS bw FROM vals GROUP BY g"""
    grid = f"""SELECT g, n, bw, CAST(i AS INT) AS point, lo - 3 * bw + i * ((hi - lo + 6 * bw) / {points - 1}) AS x
      FROM sized, range({points}) t(i) WHERE bw > 0"""
    select = f"""SELECT r.g AS {name}, point, {_r('x')} AS x,
      ROUND(sum(exp(-0.5 * pow((x - v) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), {FINER['density']}) AS density
      FROM grid r JOIN vals v ON r.g = v.g GROUP BY r.g, point, x"""
    return _query(select, **ctes, vals=values, sized=sized, grid=grid)


# --- topics, keywords ---------------------------------------------------------------------------


def _flags() -> str:
    subject = [f"CAST({_match('subject', t.subject_pattern)} AS INT) AS {t.subject_flag}" for t in C.topics]
    body = [f"CAST({_match('reference', t.email_pattern)} AS INT) AS {t.email_flag}" for t in C.topics]
    return ", ".join(subject + body)


def _mails(side: str, where: str = "true") -> str:
    return f"""SELECT *, {_flags()} FROM (SELECT DISTINCT date, year, month, year_month, {side}, status_{side}, subject,
      reference FROM exchange WHERE {where})"""


def _sums(by: str, table: str = "mails", where: str = "true") -> str:
    sums = ", ".join(f"{_big(f'coalesce(sum({f}), 0)')} AS sum_{f}" for f in FLAGS)
    return f"SELECT {by}, {sums} FROM {table} WHERE {where} GROUP BY {by}"


ANY = "(" + " OR ".join(f"{s} <> 0" for s in SUMS) + ")"


def _long(table: str, by: str, where: str = "true", name: str = "topic_email") -> str:
    parts = [f"SELECT {by}, '{s}' AS {name}, {s} AS value FROM {table}" for s in SUMS]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {where}"


def _chosen(name: str = "topic_email") -> str:
    keys = ", ".join(f"'{k}'" for k in C.topics_labelled(CHOICE["labels"]))
    return f"year_month >= DATE '{CHOICE['start']}' AND year_month <= DATE '{CHOICE['end']}' AND {name} IN ({keys})"


def _occurrences(word: str) -> str:
    return f"len(regexp_extract_all(subject, '{word}'))"


def _frequency(table: str, by: str = "", parts: tuple[str, ...] = ("subject", "text")) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    rows = []
    for position, word in WORDS:
        terms = []
        if "subject" in parts:
            terms.append(f"coalesce(sum({_occurrences(word)}), 0)")
        if "text" in parts:
            terms.append(f"2 * count(*) FILTER (WHERE {_match('reference', word)})")
        rows.append(
            f"SELECT {key}{position} AS position, '{word}' AS word, {_big(' + '.join(terms))} AS freq FROM {table} {group}"
        )
    return " UNION ALL ".join(rows)


def _topical(side: str) -> dict[str, str]:
    return {
        "mails": _mails(side),
        "months": f"SELECT year_month FROM ({_sums('year_month')}) WHERE {ANY}",
        "pairs": "SELECT DISTINCT subject, reference FROM mails WHERE year_month IN (FROM months)",
    }


def _topical_status(side: str) -> dict[str, str]:
    status = f"status_{side}"
    listed = ", ".join(f"'{s}'" for s in C.statuses)
    return {
        "mails": _mails(side, f"{status} IN ({listed})"),
        "groups": f"SELECT * FROM ({_sums(f'year_month, {status}')}) WHERE {ANY}",
        "pairs": f"SELECT DISTINCT m.{status}, subject, reference FROM mails m JOIN groups g "
        f"ON m.year_month = g.year_month AND m.{status} = g.{status}",
    }


# --- statements per side ------------------------------------------------------------------------


def _compare_values(side: str) -> dict[str, str]:
    label, group = C.focus_label, f"{C.focus_status} status"
    if side == "sender":
        keys, group_keys, focus_keys = "date, sender, subject", "date, sender, subject", "date, subject"
    else:
        keys, group_keys, focus_keys = "date, recipient", "date", "date"
    counts = f"""
      SELECT '{label}' AS g, count(*) AS v FROM exchange WHERE {side} = '{C.focus_address}' GROUP BY {focus_keys}
      UNION ALL SELECT 'All', count(*) FROM exchange GROUP BY {keys}
      UNION ALL SELECT '{group}', count(*) FROM exchange WHERE status_{side} = '{C.focus_status}' GROUP BY {group_keys}"""
    return {"counts": counts}


def _label(side: str) -> str:
    cases = " ".join(f"WHEN '{alias}' THEN '{name}'" for alias, name in C.persons[side].items())
    return f"CASE {side} {cases} ELSE {side} END"


def _person(side: str) -> dict[str, str]:
    return {
        "mails": _mails(side, _match(side, C.person_shortlist)),
        "persons": f"SELECT *, {_label(side)} AS email_label_{side} FROM mails",
    }


def _ratio(side: str, by: str | None = None) -> dict[str, str]:
    if side == "sender":
        return {
            "people": "SELECT DISTINCT date, status_sender, sender FROM exchange WHERE status_sender IS NOT NULL",
            "ratio": """SELECT e.date, e.status_sender, count(*) AS nb_send, count(DISTINCT sender) AS nb_sender_per_gp,
              count(*) / count(DISTINCT sender) AS ratio_nb_email
              FROM exchange e WHERE e.status_sender IS NOT NULL GROUP BY ALL""",
        }
    return {
        "rows": f"""SELECT date, status_recipient, recipient, count(*) OVER w AS nb,
            count(DISTINCT recipient) OVER w AS np, count(*) OVER w / count(DISTINCT recipient) OVER w AS ratio
          FROM exchange WHERE status_recipient IS NOT NULL WINDOW w AS (PARTITION BY date, status_{by or 'sender'})"""
    }


def _side_statements(side: str) -> dict[str, str]:
    status = f"status_{side}"
    known = f"{status} IS NOT NULL"
    daily = f"SELECT date, {status}, count(*) AS email_count FROM exchange WHERE {known} GROUP BY date, {status}"
    daily_values = f"SELECT {status} AS g, email_count AS v FROM daily"
    person = f"email_label_{side}"
    values = "SELECT g, v FROM counts"
    wide = {"mails": _mails(side), "sums": f"SELECT * FROM ({_sums('year_month')}) WHERE {ANY}"}
    by_status = {"mails": _mails(side), "sums": _sums(f"year_month, {status}", where=known)}
    by_person = _person(side) | {"sums": _sums(f"year_month, {person}", "persons")}
    compare = _compare_values(side)
    ranked = f"""SELECT *, CAST(row_number() OVER (PARTITION BY {status} ORDER BY freq DESC, word, position) AS INT) AS rank
      FROM freqs WHERE freq >= {C.min_word_frequency}"""
    if side == "sender":
        ratio_rows = "SELECT p.status_sender AS s, ratio_nb_email AS ratio FROM people p JOIN ratio USING (date, status_sender)"
        ratio_all = "SELECT e.status_sender AS g, ratio_nb_email AS v FROM exchange e JOIN ratio USING (date, status_sender)"
    else:
        ratio_rows = """SELECT status_recipient AS s, ratio FROM
          (SELECT DISTINCT date, status_recipient, recipient, nb, np, ratio FROM rows)"""
        ratio_all = "SELECT status_recipient AS g, ratio AS v FROM rows"
    active = f"""SELECT {status} AS status, count(DISTINCT {side}) OVER (PARTITION BY date, {status}) AS persons
      FROM exchange"""
    active_values = "SELECT status AS g, persons AS v FROM active WHERE status IS NOT NULL"
    per_person = f"""SELECT year, {status}, {side}, count(*) AS nb_email FROM (SELECT DISTINCT year, sender, {status},
      subject, reference, recipient FROM exchange WHERE {known}) GROUP BY ALL"""
    return {
        "monthly_distinct_mails": _query(
            "SELECT year_month, count(*) AS nb_email FROM mails GROUP BY year_month", mails=_mails(side)
        ),
        "daily_status_stats": _query(_describe("daily", status, "email_count"), daily=daily),
        "daily_status_box": _box(daily_values, status, daily=daily),
        "daily_status_box_clipped": _box(f"{daily_values} WHERE email_count BETWEEN 0 AND 15", status, daily=daily),
        "daily_status_anova": _anova(daily_values, daily=daily),
        "daily_status_anova_clipped": _anova(f"{daily_values} WHERE email_count BETWEEN 0 AND 6", daily=daily),
        "daily_status_pairwise": _pairwise(daily_values, daily=daily),
        "daily_status_density": _density(daily_values, status, 512, daily=daily),
        "per_person_ratio_stats": _query(
            f"SELECT s AS {status}, count(*) AS n, {_statistics('ratio')} FROM stat_rows GROUP BY s",
            **_ratio(side), stat_rows=ratio_rows,
        ),
        "per_person_ratio_anova": _anova(ratio_all, **_ratio(side)),
        "per_person_ratio_box": _box(ratio_all, status, **_ratio(side)),
        "per_person_ratio_density": _density(ratio_all, status, 512, **_ratio(side)),
        "active_people_box": _box(active_values, "status", active=active),
        "active_people_density": _density(active_values, "status", 512, active=active),
        "active_people_by_status": _query(
            f"SELECT status, count(*) AS n, {_statistics('persons')} FROM active WHERE status IS NOT NULL GROUP BY status",
            active=active,
        ),
        "yearly_status_stats": _query(_describe("per_person", f"year, {status}", "nb_email", 2), per_person=per_person),
        "monthly_status_volume": _query(
            f"SELECT {status}, year, month, count(*) AS n FROM exchange WHERE {known} GROUP BY ALL"
        ),
        "monthly_one_status_volume": _query(
            f"SELECT {status}, year, month, count(*) AS n FROM exchange WHERE {status} = '{STATUS}' GROUP BY ALL"
        ),
        "topic_flags": _query("SELECT * FROM mails", mails=_mails(side)),
        "topic_month_wide": _query("SELECT * FROM sums", **wide),
        "topic_month_long": _query(_long("sums", "year_month"), **wide),
        "topic_month_chosen": _query(_long("sums", "year_month", _chosen()), **wide),
        "topic_status_long": _query(_long("sums", f"year_month, {status}"), **by_status),
        "topic_status_chosen": _query(
            _long("sums", f"year_month, {status}", f"{status} = '{STATUS}' AND {_chosen()}"), **by_status
        ),
        "keyword_total": _query(_frequency("pairs"), **_topical(side)),
        "keyword_top": _query(
            f"SELECT * FROM ({_frequency('pairs')}) WHERE freq >= {C.min_word_frequency}", **_topical(side)
        ),
        "keyword_status_total": _query(_frequency("pairs", status), **_topical_status(side)),
        "keyword_top_status": _query(
            f"SELECT * FROM ({ranked}) WHERE rank <= 10", **_topical_status(side), freqs=_frequency("pairs", status)
        ),
        "compare_stats": _query(f"SELECT g AS source, count(*) AS n, {_statistics('v')} FROM counts GROUP BY g", **compare),
        "compare_box": _box(values, "source", **compare),
        "compare_welch": _welch(values, C.focus_label, **compare),
        "compare_welch_clipped": _welch(f"{values} WHERE v BETWEEN -10 AND 5", C.focus_label, **compare),
        "compare_density": _density(values, "source", 512, **compare),
        "person_mails": _query("SELECT * FROM persons", **_person(side)),
        "person_year_stats": _query(
            _describe("yearly", person, "nb_email", 2), **_person(side),
            yearly=f"""SELECT year, {person}, count(*) AS nb_email FROM
              (SELECT DISTINCT year, {person}, subject, reference FROM persons) GROUP BY ALL""",
        ),
        "person_monthly": _query(f"SELECT {person}, year, month, count(*) AS n FROM persons GROUP BY ALL", **_person(side)),
        "person_topics": _query(_long("sums", f"year_month, {person}"), **by_person),
        "person_topics_chosen": _query(
            _long("sums", f"year_month, {person}", f"{person} = '{PERSON}' AND {_chosen()}"), **by_person
        ),
    }


# --- other statements ---------------------------------------------------------------------------


def _top(address: str, source: str, digits: int) -> str:
    label = digits - 2
    return _query(
        f"""SELECT {address}, n, perc, printf('%.{label}f%%', perc * 100) AS labels FROM (
          SELECT {address}, n, {_r('n / sum(n) OVER ()', digits)} AS perc FROM counts)
        ORDER BY n DESC, {address} LIMIT 10""",
        counts=f"SELECT {address}, count(*) AS n FROM ({source}) GROUP BY {address}",
    )


def _group(column: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{g}'" for s, g in C.status_groups.items())
    return f"CASE {column} {cases} ELSE {column} END"


FLOW = f"""SELECT date, {_group('status_sender')} AS status_sender, {_group('status_recipient')} AS status_recipient,
  year, count(*) AS number_exchange FROM exchange WHERE status_sender IS NOT NULL AND status_recipient IS NOT NULL
  GROUP BY 1, 2, 3, 4"""


def _presence(where: str = "true") -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE status_recipient = '{x}') AS \"{x}\"" for x in C.flow_labels)
    return _query(
        f"""SELECT status_sender, {cells} FROM (SELECT DISTINCT status_sender, status_recipient FROM flow
        WHERE status_sender <> status_recipient AND {where}) GROUP BY status_sender""",
        flow=FLOW,
    )


def _share(where: str) -> str:
    return _query(
        f"""SELECT status, n, {_r('perc')} AS perc, printf('%.2f%%', perc * 100) AS labels FROM (
          SELECT status, n, n / sum(n) OVER () AS perc FROM (
            SELECT known AS status, count(*) AS n FROM staff WHERE {where} GROUP BY known))"""
    )


INTERNAL = {side: _match(side, C.internal_pattern) for side in ("sender", "recipient")}
MARKED = f"""SELECT *, sum(CASE WHEN {INTERNAL['sender']} THEN 1 ELSE 0 END) OVER w AS sum_sender,
  sum(CASE WHEN {INTERNAL['recipient']} THEN 1 ELSE 0 END) OVER w AS sum_recipient
  FROM exchange WINDOW w AS (PARTITION BY date, subject)"""
OUTSIDE = "sum_sender = 0 AND sum_recipient = 0"
EXTERN = {
    "marked": MARKED,
    "named": f"""SELECT *, {_flags()} FROM (SELECT DISTINCT date, year_month, sender, recipient, subject, reference
      FROM marked WHERE {OUTSIDE}) WHERE {_match('subject', C.company_pattern)} OR {_match('reference', C.company_pattern)}""",
    "sums": _sums("year_month", "named"),
}


def _categories(table: str, columns: list[str], k: int) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level FROM {table}" for c in columns)
    return _query(
        f"""SELECT "column", 'level' AS kind, level, n FROM ranked WHERE level IS NOT NULL AND rk <= {k}
        UNION ALL SELECT "column", 'other', NULL, {_big('sum(n)')} FROM ranked WHERE level IS NOT NULL AND rk > {k} GROUP BY 1
        UNION ALL SELECT "column", 'missing', NULL, n FROM ranked WHERE level IS NULL""",
        levels=f'SELECT "column", level, count(*) AS n FROM ({long}) GROUP BY ALL',
        ranked="""SELECT *, row_number() OVER (PARTITION BY "column", level IS NULL ORDER BY n DESC, level) AS rk
          FROM levels""",
    )


def _numbers(table: str, columns: list[str], **ctes: str) -> str:
    return _query(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_missing, min({c})::DOUBLE AS min,
            {_r(f'quantile_cont({c}, 0.25)')} AS q1, {_r(f'quantile_cont({c}, 0.5)')} AS median, {_r(f'avg({c})')} AS mean,
            {_r(f'quantile_cont({c}, 0.75)')} AS q3, max({c})::DOUBLE AS max FROM {table}"""
            for c in columns
        ),
        **ctes,
    )


def _dates() -> str:
    def day(days: str) -> str:
        return f"DATE '1970-01-01' + CAST(floor({days}) AS INT)"

    return _query(
        f"""SELECT 'date' AS "column", count(date) AS n, count(*) - count(date) AS n_missing, min(date) AS min,
        {day('quantile_cont(d, 0.25)')} AS q1, {day('quantile_cont(d, 0.5)')} AS median, {day('avg(d)')} AS mean,
        {day('quantile_cont(d, 0.75)')} AS q3, max(date) AS max
        FROM (SELECT date, date - DATE '1970-01-01' AS d FROM messages)"""
    )


def _alias_rows(source: str, column: str, side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{side}' AS side, '{a}' AS alias_column, count(*) AS n FROM {source} f JOIN employees e "
        f"ON f.{column} = e.{a} AND e.{a} <> ''"
        for a in ("email_id", "email2", "email3", "email4")
    )


def _selectors() -> str:
    parts, ctes = [], {}
    for side in ("sender", "recipient"):
        ctes[f"mails_{side}"] = _mails(side, _match(side, C.person_shortlist))
        parts.append(f"SELECT DISTINCT 'status_{side}', status_{side} FROM exchange WHERE status_{side} IS NOT NULL")
        parts.append(f"SELECT DISTINCT 'person_{side}', {_label(side)} FROM mails_{side}")
    parts.append("SELECT 'first_month', CAST(min(year_month) AS VARCHAR) FROM exchange")
    parts.append("SELECT 'last_month', CAST(max(year_month) AS VARCHAR) FROM exchange")
    union = " UNION ALL ".join(parts)
    return _query(f"SELECT * FROM ({union}) t(selector, value)", **ctes)


def _extreme(where: str, limit: str) -> str:
    return _query(
        f"""SELECT p.date, p.status_sender, p.sender, nb_send, nb_sender_per_gp, {_r('ratio_nb_email')} AS ratio_nb_email
        FROM people p JOIN days d ON p.date = d.date AND p.status_sender = d.status_sender""",
        **_ratio("sender"),
        days=f"SELECT * FROM ratio WHERE status_sender = '{STATUS}' AND {where} ORDER BY ratio_nb_email DESC, date {limit}",
    )


def _active_stats() -> str:
    columns = ", ".join(_statistics(f"nb_{s}_per_group", prefix=f"nb_{s}_per_group_") for s in ("sender", "recipient"))
    return _query(
        f"SELECT {columns} FROM active",
        active="""SELECT count(DISTINCT sender) OVER (PARTITION BY date, status_sender) AS nb_sender_per_group,
          count(DISTINCT recipient) OVER (PARTITION BY date, status_recipient) AS nb_recipient_per_group FROM exchange""",
    )


def _year_stats() -> str:
    names = ("mean", "median", "sd", "min", "q1", "q3", "max")
    wide = ", ".join(_statistics(s, 2, prefix=f"{s}_") for s in SUMS)
    parts = " UNION ALL ".join(
        f"SELECT year, '{s}_{n}' AS topics, {s}_{n} AS \"values\" FROM wide" for s in SUMS for n in names
    )
    windows = ", ".join(f"coalesce(sum({f}) OVER (PARTITION BY year_month), 0) AS sum_{f}" for f in FLAGS)
    return _query(
        parts,
        mails=_mails("sender"),
        marked=f"SELECT DISTINCT year_month, year, subject, reference, {', '.join(SUMS)} FROM "
        f"(SELECT *, {windows} FROM mails)",
        wide=f"SELECT year, {wide} FROM marked GROUP BY year",
    )


def _word_stats() -> str:
    word = r"[^\t\n\f\r\p{Z}]+"
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS text, len(regexp_extract_all({column}, '{word}')) AS words FROM pairs"
        for name, column in (("email_words", "reference"), ("subject_words", "subject"))
    )
    return _query(
        f"""SELECT text, count(*) AS n, count(*) FILTER (WHERE words IS NULL) AS n_missing, {_statistics('words')}
        FROM ({parts}) GROUP BY text""",
        pairs="SELECT DISTINCT reference, subject FROM exchange",
    )


def _single_statements() -> dict[str, str]:
    mail = "sender, recipient, subject, reference"
    direct = f"SELECT count(*) FROM (SELECT DISTINCT {mail} FROM exchange WHERE rtype = 'TO')"
    replies = f"SELECT count(*) FROM (SELECT DISTINCT {mail} FROM exchange WHERE {_match('subject', C.reply_pattern)})"
    known = f"""SELECT count(*) FROM (SELECT DISTINCT {mail}, status_sender, status_recipient FROM exchange
      WHERE status_sender IS NOT NULL OR status_recipient IS NOT NULL)"""
    generic = f"{_match('sender', C.generic_pattern)} OR {_match('recipient', C.generic_pattern)}"
    key = "sender, subject, recipient"
    ext = {
        s: f"SELECT count(*) AS total, count(*) FILTER (WHERE NOT {INTERNAL[s]}) AS ext FROM (SELECT DISTINCT {s} FROM exchange)"
        for s in INTERNAL
    }
    return {
        "corpus_exchange": _query(
            "SELECT date, year, month, sender, status_sender, rtype, recipient, status_recipient, subject, reference FROM exchange"
        ),
        "kpis": _query(
            f"""SELECT *, {_r('replies * 100 / direct_exchanges', 2)} AS reply_pct,
            {_r('known_status * 100 / direct_exchanges', 2)} AS known_status_pct FROM (
            SELECT (SELECT count(DISTINCT sender) FROM exchange) AS senders,
              (SELECT count(DISTINCT recipient) FROM exchange) AS recipients, ({direct}) AS direct_exchanges,
              ({replies}) AS replies, ({known}) AS known_status)"""
        ),
        "internal_pairs": _query(
            f"""SELECT count(*) AS pairs FROM (SELECT DISTINCT sender, recipient FROM exchange
            WHERE {INTERNAL['sender']} OR {INTERNAL['recipient']})"""
        ),
        "generic_rows": _query(f"SELECT count(*) AS n FROM exchange WHERE {generic}"),
        "external_share": _query(
            f"""SELECT s.ext AS sum_ext_sender, CAST(round(s.ext / s.total * 100) AS INT) || '%' AS pct_ext_sender,
            r.ext AS sum_ext_recipient, CAST(round(r.ext / r.total * 100) AS INT) || '%' AS pct_ext_recipient
            FROM ({ext['sender']}) s, ({ext['recipient']}) r"""
        ),
        "external_count": _query(f"SELECT count(*) AS n FROM marked WHERE {OUTSIDE}", marked=MARKED),
        "conversation_flags": _query(
            f"""SELECT date, sender, recipient, subject, {_big('sum_sender')} AS sum_sender,
            {_big('sum_recipient')} AS sum_recipient FROM marked""",
            marked=MARKED,
        ),
        "external_exchanges": _query(
            f"SELECT date, year, month, sender, recipient, subject, reference FROM marked WHERE {OUTSIDE}", marked=MARKED
        ),
        "internal_exchanges": _query(
            "SELECT date, sender, recipient, subject, reference FROM marked WHERE sum_sender <> 0 OR sum_recipient <> 0",
            marked=MARKED,
        ),
        "external_topics": _query("SELECT * FROM sums", **EXTERN),
        "external_topics_long": _query(_long("sums", "year_month"), **EXTERN),
        "external_subject_overlap": _query(
            f"""SELECT m.date, m.sender, m.recipient, m.subject, m.reference, t.* EXCLUDE (subject) FROM marked m
            JOIN (SELECT DISTINCT s.*, n.subject FROM named n JOIN sums s USING (year_month)
              WHERE {_match('n.subject', C.company_pattern)} AND ({' OR '.join(f'{s} <> 0' for s in C.subject_sums)})) t
            ON m.subject = t.subject WHERE m.sum_sender <> 0 OR m.sum_recipient <> 0""",
            **EXTERN,
        ),
        "employee_status_share": _share("true"),
        "employee_status_share_known": _share("known IS NOT NULL"),
        "monthly_volume": _query("SELECT year, month, count(*) AS n FROM exchange GROUP BY year, month"),
        "per_person_ratio_stats_by_recipient": _query(
            f"SELECT status_recipient, count(*) AS n, {_statistics('ratio')} FROM stat_rows GROUP BY status_recipient",
            **_ratio("recipient", "recipient"),
            stat_rows="SELECT DISTINCT date, status_recipient, recipient, nb, np, ratio FROM rows",
        ),
        "extreme_day": _extreme("true", "LIMIT 10"),
        "extreme_day_equal": _extreme(f"ratio_nb_email = {EXTREME_RATIO}", ""),
        "active_people_stats": _active_stats(),
        "flow_daily": _query("SELECT * FROM flow", flow=FLOW),
        "flow_by_year": _query(
            f"""SELECT year, status_sender, status_recipient, {_big('sum(number_exchange)')} AS sum FROM flow
            WHERE status_sender <> status_recipient GROUP BY ALL""",
            flow=FLOW,
        ),
        "flow_all_years": _query(
            f"""SELECT status_sender, status_recipient, {_big('sum(number_exchange)')} AS sum FROM flow
            WHERE status_sender <> status_recipient GROUP BY ALL""",
            flow=FLOW,
        ),
        "flow_presence": _presence(),
        "flow_presence_2000": _presence("year = 2000"),
        "topic_year_stats": _year_stats(),
        "word_count_stats": _word_stats(),
        "body_share": _query(
            f"SELECT count(reference) AS n, {_r('count(reference) / count(*) * 100')} AS pct FROM exchange"
        ),
        "keyword_subject": _query(
            _frequency("pairs", parts=("subject",)), pairs="SELECT DISTINCT year_month, subject, reference FROM exchange"
        ),
        "keyword_text": _query(
            _frequency("pairs", parts=("text",)), pairs="SELECT DISTINCT year_month, subject, reference FROM exchange"
        ),
        "top_senders": _top("sender", f"SELECT DISTINCT {key} FROM exchange", 3),
        "top_recipients_filter_first": _top("recipient", f"SELECT DISTINCT {key} FROM exchange WHERE rtype = 'TO'", 4),
        "top_recipients_dedupe_first": _top(
            "recipient",
            f"""SELECT recipient FROM (SELECT recipient, rtype, row_number() OVER (PARTITION BY {key} ORDER BY rid) AS rk
            FROM exchange) WHERE rk = 1 AND rtype = 'TO'""",
            3,
        ),
        "first_exchanges": _query(
            f"""SELECT date, year, month, sender, status_sender, rtype, recipient, status_recipient, subject, reference
            FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rid) AS rk FROM exchange) WHERE rk = 1"""
        ),
        "address_status": _query(
            f"SELECT max(status_sender) AS status_sender FROM exchange WHERE sender = '{C.focus_address}'"
        ),
        "profile_dimensions": _query(
            " UNION ALL ".join(
                f"SELECT '{name}' AS \"table\", count(*) AS n_rows, CAST({n} AS INT) AS n_columns FROM {table}"
                for name, table, n in (
                    ("employees", "employees", 9), ("messages", "messages", 5), ("recipients", "recipients", 4),
                    ("references", "refs", 3),
                )
            )
        ),
        "status_pairs": _query(
            "SELECT rtype, status_sender, status_recipient, count(*) AS n FROM exchange GROUP BY 1, 2, 3"
        ),
        "status_pairs_match_blank": _query(
            """SELECT rtype, coalesce(sp.known, st.known) AS status_sender, coalesce(rp.known, rt.known) AS status_recipient,
            count(*) AS n FROM blank_rows b
            LEFT JOIN staff sp ON b.sender IS NOT DISTINCT FROM sp.email_id
            LEFT JOIN staff st ON b.sender IS NOT DISTINCT FROM st.email3
            LEFT JOIN staff rp ON b.rvalue IS NOT DISTINCT FROM rp.email_id
            LEFT JOIN staff rt ON b.rvalue IS NOT DISTINCT FROM rt.email3 GROUP BY 1, 2, 3""",
            blank_rows="""SELECT rtype, CASE WHEN mid % 40 = 7 THEN '' ELSE sender END AS sender,
              CASE WHEN mid % 40 = 3 OR mid % 400 = 7 THEN '' WHEN mid % 40 = 5 THEN NULL ELSE rvalue END AS rvalue FROM complete""",
        ),
        "keyword_positions": _query(
            f"""SELECT word, count(place) AS n_bodies, {_r('avg(place)')} AS mean_first, CAST(min(place) AS INT) AS earliest
            FROM (SELECT word, nullif(strpos(reference, word), 0) AS place FROM refs,
              (VALUES {', '.join(f"('{w}')" for w in dict.fromkeys(C.words))}) w(word) WHERE reference IS NOT NULL) GROUP BY word"""
        ),
        "profile_missing_values": _query(
            " UNION ALL ".join(
                f"SELECT count(*) AS n_rows, '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM employees"
                for c in ("eid", "first_name", "last_name", "email_id", "email2", "email3", "email4", "folder", "status")
            )
        ),
        "profile_all_missing_values": _query(
            " UNION ALL ".join(
                f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, "
                f"count(*) - count({c}) AS n_missing FROM {table}"
                for name, (table, columns) in COLUMN_TYPES.items()
                for c, kind in columns.items()
            )
        ),
        "profile_employee_categories": _categories("employees", ["first_name", "last_name", "email_id", "email3", "folder"], 6),
        "profile_message_id_categories": _categories("messages", ["message_id"], 6),
        "profile_employee_numbers": _numbers("employees", ["eid"]),
        "profile_ratio_numbers": _numbers("ratio", ["nb_send", "nb_sender_per_gp", "ratio_nb_email"], **_ratio("sender")),
        "profile_message_numbers": _numbers("messages", ["mid"]),
        "profile_recipient_numbers": _numbers("recipients", ["mid"]),
        "profile_reference_numbers": _numbers("refs", ["rfid", "mid"]),
        "profile_message_dates": _dates(),
        "profile_categories": _categories("messages", ["sender", "subject"], 6),
        "profile_recipient_categories": _categories("recipients", ["rtype", "rvalue"], 6),
        "profile_status_categories": _categories("employees", ["status"], 3),
        "profile_blank_aliases": _query(
            " UNION ALL ".join(
                f"""SELECT '{c}' AS alias_column, count(*) FILTER (WHERE {c} = '') AS n_blank,
                count(*) - count({c}) AS n_missing, count(*) FILTER (WHERE {c} <> '') AS n_filled,
                count(DISTINCT CASE WHEN {c} <> '' THEN {c} END) AS n_distinct FROM employees"""
                for c in ("email_id", "email2", "email3", "email4")
            )
        ),
        "profile_out_of_period": _query(
            """SELECT CAST(year(date) AS INT) AS year, count(*) AS n FROM messages
            WHERE year(date) < 1999 OR year(date) > 2002 GROUP BY 1"""
        ),
        "profile_repeated_ids": _query(
            "SELECT message_id, mid, count(*) AS n FROM messages GROUP BY message_id, mid HAVING count(*) <> 1"
        ),
        "profile_ids_with_several_mids": _query(
            """SELECT message_id, count(DISTINCT mid) AS n_mid FROM messages GROUP BY message_id
            HAVING count(DISTINCT mid) > 1"""
        ),
        "profile_alias_coverage": _query(
            _alias_rows("messages", "sender", "sender") + " UNION ALL " + _alias_rows("recipients", "rvalue", "recipient")
        ),
        "profile_row_preservation": _query(
            f"""SELECT step, {_big('b')} AS rows_before, {_big('a')} AS rows_after, a = b AS preserved FROM (
            SELECT 'message_join' AS step, (SELECT count(*) FROM recipients) AS b, (SELECT count(*) FROM joined) AS a
            UNION ALL SELECT 'status_lookup', (SELECT count(*) FROM complete), (SELECT count(*) FROM exchange))"""
        ),
        "profile_incomplete_rows": _query(
            """SELECT mid, rtype, rvalue, sender, date, subject, reference FROM joined
            WHERE sender IS NULL OR subject IS NULL OR date IS NULL"""
        ),
        "profile_text_period": _query(
            """SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM complete
            WHERE reference IS NOT NULL"""
        ),
        "profile_match_counts": _query(
            """SELECT 'sender_primary' AS step, count(sp) AS n FROM s1
            UNION ALL SELECT 'sender_third', count(st) FROM s2
            UNION ALL SELECT 'sender_combined', count(coalesce(sp, st)) FROM s2
            UNION ALL SELECT 'recipient_primary', count(rp) FROM r1
            UNION ALL SELECT 'recipient_third', count(rt) FROM r2
            UNION ALL SELECT 'recipient_combined', count(coalesce(rp, rt)) FROM r2"""
        ),
        "profile_selectors": _selectors(),
        "peek_messages": _query("SELECT * FROM messages ORDER BY mid LIMIT 10"),
        "peek_references": _query("SELECT * FROM refs ORDER BY mid LIMIT 6 OFFSET 4"),
    }


def statements() -> dict[str, str]:
    found = _single_statements()
    for suffix, side in SIDES.items():
        for name, sql in _side_statements(side).items():
            found[f"{name}_{suffix}"] = sql
    return found
