"""The queries that SQL can express, restated for an independent engine."""

from __future__ import annotations

from mailscope.llm import chat_format, divergence, filter_audit, warc
from mailscope.llm.cover_tree import QUERY_EVERY, TOP
from mailscope.llm.mixing import MixPlan
from mailscope.llm.sharding import BITS, SHARD_BYTES

PLAN = MixPlan()
HASH = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SHARDING = f"""
WITH docs AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    {HASH.format("coalesce(CAST(doc_id AS VARCHAR), chr(0))")} AS h FROM documents),
levels AS (SELECT doc_id, n_bytes, h, CAST(d AS INT) AS depth FROM docs, range(0, {BITS + 1}) r(d)),
buckets AS (
  SELECT depth, h >> ({BITS} - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
  FROM levels GROUP BY ALL),
fitting AS (
  SELECT l.doc_id, l.n_bytes, l.h, l.depth, b.shard_bytes, b.shard_rows
  FROM levels l JOIN buckets b ON l.depth = b.depth AND l.h >> ({BITS} - l.depth) = b.prefix
  WHERE b.shard_bytes <= {SHARD_BYTES} OR b.shard_rows = 1),
first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS n FROM fitting)
SELECT doc_id, n_bytes, substr(lpad(bin(h), {BITS}, '0'), 1, depth) AS shard, depth, shard_bytes, shard_rows
FROM first WHERE n = 1"""

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size,
    {HASH.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS place FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM totals),
weighed AS (
  SELECT *, CAST(list_extract({list(PLAN.weights)}, 1 + (src - 1) % {len(PLAN.weights)}) AS DOUBLE) AS w,
    CAST({PLAN.repeats} * source_size AS DOUBLE) AS cap FROM ranked),
filling AS (
  SELECT *, row_number() OVER fill AS n,
    ({PLAN.share} * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW fill AS (ORDER BY cap / w, src),
    before AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT level FROM filling WHERE level <= cap / w ORDER BY n LIMIT 1),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM common) * w, cap)) AS target FROM weighed),
streams AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS wanted,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
    size * (wanted // greatest(source_size, 1))
    + least(size, greatest(0, wanted % greatest(source_size, 1) - start)) END AS taken
FROM streams"""

TOP_K = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_quoted(pattern)}, {by}, 'g')"


def _plain(html: str) -> str:
    hidden = "|".join(["<!--.*?-->", *(rf"<{name}\b[^>]*>.*?</{name}\s*>" for name in warc.HIDDEN)])
    text = _replaced(_replaced(html, f"(?is){hidden}", "''"), r"[\x09-\x0D]+", "' '")
    text = _replaced(text, rf"(?i)</?(?:{warc.LINES})(?:[\x20/][^>]*)?>", "chr(10)")
    text = _replaced(text, r"<[!?/a-zA-Z][^>]*>", "''")
    for name, character in warc.NAMED.items():
        text = f"replace({text}, '&{name};', {_quoted(character)})"
    text = _replaced(text, r"\x20*\n[\x20\n]*", "chr(10)")
    return f"trim({_replaced(text, r'\x20{2,}', repr(' '))}, ' ' || chr(10))"


def _digest(block: str) -> str:
    groups = " || ".join(
        f"to_base(CAST('0x' || substr(sha1({block}), {at}, 5) AS BIGINT), 32, 4)" for at in range(1, 41, 5)
    )
    return f"'sha1:' || translate(upper({groups}), '{warc.DIGITS}', '{warc.ALPHABET}')"


def _urn(*parts: str) -> str:
    digits = "md5(" + " || chr(10) || ".join(f"coalesce(CAST({p} AS VARCHAR), chr(0))" for p in parts) + ")"
    cuts = " || '-' || ".join(f"substr({digits}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cuts} || '>'"


END = "chr(13) || chr(10)"
WARC = f"""
WITH read AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, {_urn("'response'", "page_id", "url")} AS refers_to FROM pages),
plain AS (
  SELECT *, {_plain('payload')} AS plain_text, {_digest('payload')} AS source_payload_digest,
    {_urn("'metadata'", "refers_to", "page_id")} AS meta_id, {_urn("'conversion'", "refers_to", "page_id")} AS text_id FROM read),
blocks AS (
  SELECT page_id, refers_to, target_uri, source_payload_digest, 'metadata' AS warc_type, meta_id AS record_id,
    text_id AS concurrent_to, 'application/warc-fields' AS content_type,
    'source-headers: HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: ' || strlen(payload) || {END}
    || 'title: ' || trim({_replaced(f"regexp_extract(payload, {_quoted('(?is)<title[^>]*>(.*?)</title')}, 1)", r"[\x20\x09-\x0D]+", "' '")}, ' ') || {END}
    || 'language: ' || lower(regexp_extract(payload, {_quoted('''(?i)<html[^>]*\\blang=["']?([a-zA-Z-]+)''')}, 1)) || {END}
    || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\\b[^>]*\\bhref=')) || {END}
    || 'text-length: ' || strlen(plain_text) || {END} AS block
  FROM plain
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_payload_digest, 'conversion', text_id, meta_id, 'text/plain; charset=utf-8', plain_text
  FROM plain)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, '1970-01-01T00:00:00Z' AS date, content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, {_digest('block')} AS block_digest, source_payload_digest, block
FROM blocks"""

_LETTERS = [*(f.letter for f in filter_audit.FILTERS), filter_audit.DUPLICATES]
_BITS = ", ".join(f"('{letter}', {1 << bit})" for bit, letter in enumerate(_LETTERS))
_PLACES = range(1, len(_LETTERS) + 1)
_APART = " AND ".join(f"l{a}.letter <> l{b}.letter" for b in _PLACES for a in range(1, b))
_ORDER = " || ".join(f"l{n}.letter" for n in _PLACES)
FILTER_AUDIT = f"""
WITH read AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM read),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters(letter, bit) AS (VALUES {_BITS}),
orders AS (
  SELECT {_ORDER} AS filter_order FROM {", ".join(f"letters l{n}" for n in _PLACES)} WHERE {_APART}),
steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, substr(filter_order, s, 1) AS letter,
    (SELECT coalesce(sum(bit), 0) FROM letters WHERE contains(substr(filter_order, 1, s - 1), letter)) AS before
  FROM orders, range(1, {len(_LETTERS) + 1}) r(s)),
counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM masks, (SELECT filter_order, step, letter, CAST(before AS INT) AS before, bit FROM steps JOIN letters USING (letter))
  GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted"""

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations
  UNION ALL SELECT -1, r, {_quoted(chat_format.SAYS)}, n FROM (VALUES ('user', 0), ('assistant', 1)) v(r, n)),
placed AS (
  SELECT *, md5(role || chr(0) || text) AS place,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS shown_role,
    regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat_format.OPEN) + len(chat_format.CLOSE) + 2} + length(shown_role) + length(shown)) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""

AUDIT = divergence.AuditPlan()
DIVERGENCE = f"""
WITH read AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
long AS (SELECT n, lang, source, unnest(terms) AS term FROM read),
kept AS (SELECT lang, term FROM long GROUP BY ALL HAVING count(DISTINCT n) >= {AUDIT.min_documents}),
counts AS (SELECT lang, source, term, count(*) AS c FROM long JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM read),
totals AS (SELECT lang, source, sum(c) AS total FROM counts GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
    1 + CAST({divergence.SCALE} AS HUGEINT) * (coalesce(c, 0) + 1) // CAST(coalesce(total, 0) + v AS HUGEINT) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
common AS (
  SELECT lang, term, 1 + CAST({divergence.SCALE} AS HUGEINT) * (c + 1) // CAST(sum(c) OVER (PARTITION BY lang) + v AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL) JOIN sizes USING (lang)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT)
  FROM grid JOIN common USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM valued)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {AUDIT.top}"""

STATEMENTS = {
    "op1_sharding": SHARDING, "op2_mixing": MIXING, "op3_top_k": TOP_K, "op5_warc": WARC,
    "op11_chat_format": CHAT, "op12_filter_audit": FILTER_AUDIT, "op13_divergence": DIVERGENCE,
}
