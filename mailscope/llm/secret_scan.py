"""Secrets in texts: strong patterns on their own, weak ones only together with their complementary parts.

A credential has several parts: an identifier, a secret and an endpoint. Strong patterns are reported wherever they
match. A weak candidate - a long mixed token, a user name, an address of a service - is reported only when the
parts that make it a credential stand in the same scope of the same text, in other characters than its own: an identifier
for a secret, a secret for an identifier, both for an endpoint, linked ones. That is an interval join of spans by scope;
of a scope's parts only the first end and the last start count, so no pairs are made. All of it is Spark expressions.

A scope goes on from candidate to candidate and from assignment to assignment as long as the next starts within reach of
what came before, and ends at a blank line. So a block of assignments is one scope however long its values are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscope.llm.scan import bound, running
from mailscope.llm.scratch import materialise

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
#: Turns between letters and digits, and those from lower to upper case. Words joined by hyphens have few of them.
TURN = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
CASE_TURN = r"(?<=[a-z])(?=[A-Z])"
#: A mixed token has one turn in so many characters at least.
TURN_EVERY = 8


@dataclass(frozen=True)
class Kind:
    """`pattern` is searched leftmost and without overlaps; matches whose `group` has under `least` characters, or
    that lack one of `also` in it, are dropped, and so are those with under `turns` turns between letters and digits, or
    with turns of both sorts too far apart. `part` is what the match can be in a credential."""

    name: str
    pattern: str
    part: str | None
    group: int = 0
    least: int = 1
    also: tuple[str, ...] = ()
    weak: bool = False
    turns: int = 0


KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", SECRET, 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", IDENTIFIER, 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", SECRET, 0, 32),
    Kind("name", r"""((?i:access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""",
         IDENTIFIER, 2, 3, weak=True),
    Kind("value", r"[A-Za-z0-9/+=_-]{20,}", SECRET, 0, 20, ("[a-z]", "[A-Z]", "[0-9]"), weak=True, turns=2),
    Kind("service", r"""(?i:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+""",
         ENDPOINT, weak=True),
)
#: Assignments carry a scope on; a blank line ends it; secrets within an address without credentials are parts of that.
BRIDGE = Kind("bridge", r"""[A-Za-z_][A-Za-z0-9_.-]{0,63}["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"',;]+""", None)
BREAK = Kind("break", r"\n[\x20\t\r]*\n", None)
LOCATOR = Kind("locator", r"""(?i:https?|ftp|s3)://[^\x20\x09-\x0D"'<>@]+(?![^\x20\x09-\x0D"'<>]*@)""", None)
MARKS = (BRIDGE, BREAK, LOCATOR)


def _matches(text: Column, kind: Kind, rank: int) -> Column:
    """Spans of a kind: structs of `start`, `rank` (of the kind) and `end`, in code points, `end` exclusive.

    Where a match stands follows from the lengths of the matches and of what lies between them."""
    pattern = F.lit(kind.pattern)

    def spans(parts: Column) -> Column:
        def place(ends: Column) -> Column:
            found = F.transform(parts["match"], lambda m, i: F.struct(
                (ends[i] - F.length(m)).alias("start"), F.lit(rank).alias("rank"), ends[i].alias("end"), parts["value"][i].alias("value")
            ))

            def holds(s: Column) -> Column:
                ok = F.length(s["value"]) >= kind.least
                for wanted in kind.also:
                    ok = ok & s["value"].rlike(wanted)
                if kind.turns:
                    turns = F.regexp_count(s["value"], F.lit(TURN))
                    ok = ok & (turns >= kind.turns)
                    ok = ok & ((turns + F.regexp_count(s["value"], F.lit(CASE_TURN))) * TURN_EVERY >= F.length(s["value"]))
                return ok

            return F.transform(F.filter(found, holds), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

        steps = F.transform(parts["match"], lambda m, i: F.length(parts["between"][i]) + F.length(m))
        return bound(running(steps, lambda a, b: a + b), place)

    parts = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"),
        F.split(text, kind.pattern, -1).alias("between"),
    )
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return F.when(text.rlike(kind.pattern), bound(parts, spans)).otherwise(nothing)


def _candidates(documents: DataFrame, carry: Sequence[str], kinds: Sequence[Kind]) -> DataFrame:
    """`carry`, and the struct `_s`: `strong` (one array of spans per kind), `weak` and `marks` (one array each) and `key`.

    `key` names the row's text; it is null where no weak candidate can be linked, which is nearly everywhere, and there
    no marks are looked for."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {k.name: _matches(text, k, rank) for rank, k in enumerate(kinds)}
    strong = F.struct(*[found[k.name].alias(k.name) for k in kinds if not k.weak])
    weak = F.flatten(F.array(*[found[k.name] for k in kinds if k.weak]))
    first = documents.select(*carry, text.alias("_text"), F.struct(strong.alias("strong"), weak.alias("weak")).alias("_s"))
    parts = F.array_distinct(F.transform(_all_spans(kinds), lambda s: _part(s["rank"], kinds)))
    linkable = (F.size("_s.weak") > 0) & (F.size(parts) > 1)
    marks = F.flatten(F.array(*[_matches(F.col("_text"), m, len(kinds) + n) for n, m in enumerate(MARKS)]))
    key = F.concat_ws("/", F.hex(F.xxhash64("_text")), F.hex(F.xxhash64(F.lit(1), "_text")), F.length("_text"))
    kept = F.struct("_s.strong", "_s.weak", F.when(linkable, marks).alias("marks"), F.when(linkable, key).alias("key"))
    return materialise(first.select(*carry, kept.alias("_s")), "secret-spans")


def _all_spans(kinds: Sequence[Kind]) -> Column:
    strong = [F.col("_s.strong")[k.name] for k in kinds if not k.weak]
    return F.flatten(F.array(*strong, F.col("_s.weak")))


def _of_kind(rank: Column, values: Sequence) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), rank + 1)


def _part(rank: Column, kinds: Sequence[Kind]) -> Column:
    return _of_kind(rank, [k.part for k in kinds])


def _scoped(spans: DataFrame, kinds: Sequence[Kind], reach: int) -> DataFrame:
    """Spans that can be part of a credential, with `scope`, `part` and `weak`. A window holds the spans of one text."""
    every = [*kinds, *MARKS]
    rank = F.col("rank")
    before = Window.partitionBy("key").orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    so_far = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached, covered = F.max("end").over(before), F.max(F.when(rank == len(kinds) + MARKS.index(LOCATOR), F.col("end"))).over(so_far)
    opens = (rank == len(kinds) + MARKS.index(BREAK)) | (F.col("start") - reached > reach)
    marked = spans.withColumn("_opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("_covered", covered)
    marked = marked.withColumn("scope", F.sum("_opens").over(so_far)).withColumn("part", _part(rank, every))
    inside = (F.col("part") == SECRET) & F.coalesce(F.col("_covered") >= F.col("end"), F.lit(False))
    kept = marked.where(F.col("part").isNotNull() & ~inside)
    return kept.select("key", "scope", "part", "start", "rank", "end", _of_kind(rank, [k.weak for k in every]).alias("weak"))


def _beside(spans: DataFrame, parts: DataFrame, need: Column) -> DataFrame:
    """Spans that have a part of the kind `need` in their scope, in other characters: one that ends before, or starts after."""
    extents = parts.groupBy("key", "scope", F.col("part").alias("need")).agg(
        F.min("end").alias("first_end"), F.max("start").alias("last_start")
    )
    met = spans.withColumn("need", need).join(extents, ["key", "scope", "need"])
    return met.where((F.col("first_end") <= F.col("start")) | (F.col("last_start") >= F.col("end"))).select(spans.columns)


def linked(spans: DataFrame, kinds: Sequence[Kind], reach: int) -> DataFrame:
    """Weak spans whose complementary parts stand in their scope, by `key`: `key`, `start`, `rank`, `end`.

    `spans` has one row per span of every kind and mark. An endpoint needs an identifier and a secret that are linked.
    """
    scoped = _scoped(spans, kinds, reach)
    part = F.col("part")
    credentials = scoped.where(part != ENDPOINT)
    met = _beside(credentials, credentials, F.when(part == SECRET, IDENTIFIER).otherwise(SECRET))
    endpoints = scoped.where(part == ENDPOINT)
    for need in (IDENTIFIER, SECRET):
        endpoints = _beside(endpoints, met, F.lit(need))
    return met.union(endpoints).where("weak").select("key", "start", "rank", "end")


def _scanned(documents: DataFrame, carry: Sequence[str], kinds: Sequence[Kind], reach: int) -> DataFrame:
    """`carry` and `_s` with `linked`, the weak spans that are reported. Rows without a key go round the join."""
    found = _candidates(documents, carry, kinds)
    keyed = found.filter(F.col("_s.key").isNotNull())
    spans = keyed.select(F.col("_s.key").alias("key"), F.inline(F.concat(_all_spans(kinds), "_s.marks"))).distinct()
    span = F.struct("start", "rank", "end")
    reported = linked(spans, kinds, reach).groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("_linked"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    joined = keyed.withColumn("_key", F.col("_s.key")).join(reported, F.col("_key") == reported["key"], "left")
    joined = joined.select(*carry, "_s", F.coalesce("_linked", none).alias("_linked"))
    return joined.union(found.filter(F.col("_s.key").isNull()).select(*carry, "_s", none.alias("_linked")))


def _text_of(spans: Column, kinds: Sequence[Kind]) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def scan(documents: DataFrame, kinds: Sequence[Kind] = KINDS, reach: int = 200) -> DataFrame:
    """One row per document: `doc_id`, `n_<kind>` of each strong kind, `base_sha256` of the strong spans, `spans`.

    A span is `kind:start:end` in code points. Strong spans always stay; linked weak ones are added, also where they
    overlap strong ones. Scopes go on over gaps of up to `reach` characters. Null and empty texts have none. Repeated rows each get a row. Rows that agree in `doc_id`
    and text have the same spans. Other columns are ignored. No rows in, no rows out.
    """
    found = _scanned(documents, ["doc_id"], kinds, reach)
    strong = [k.name for k in kinds if not k.weak]
    base = F.flatten(F.array(*[F.col("_s.strong")[name] for name in strong]))
    counts = [F.size(F.col("_s.strong")[name]).cast("long").alias(f"n_{name}") for name in strong]
    return found.select(
        "doc_id", *counts, F.sha2(_text_of(base, kinds), 256).alias("base_sha256"),
        _text_of(F.concat(base, "_linked"), kinds).alias("spans"),
    )


def redacted(documents: DataFrame, kinds: Sequence[Kind] = KINDS, reach: int = 200, mark: str = "[secret]") -> DataFrame:
    """The documents, all columns, with every reported span replaced by `mark` and `n_chars`, if there, recounted.

    Spans that overlap or touch become one mark. Documents without spans stay as they are."""
    rows = documents.select("doc_id", "text", F.struct(*documents.columns).alias("it"))
    found = _scanned(rows, ["it"], kinds, reach)
    given = F.col("it.text")
    strong = [F.col("_s.strong")[k.name] for k in kinds if not k.weak]
    spans = F.sort_array(F.flatten(F.array(*strong, F.col("_linked"))))

    def rewritten(s: Column) -> Column:
        reached = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def join(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            pieces = F.transform(s, lambda x, i: F.when(
                (i == 0) | (x["start"] > before(i)),
                F.concat(F.substring(given, before(i) + 1, x["start"] - before(i)), F.lit(mark)),
            ).otherwise(""))
            return F.concat(F.array_join(pieces, ""), F.substring(given, F.element_at(ends, -1) + 1, F.length(given)))

        return bound(reached, join)

    changed = F.size(spans) > 0
    renewed = found.withColumn("text", F.when(changed, bound(spans, rewritten)).otherwise(given))
    new = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("it.n_chars"))
    return renewed.select(*[new.get(c, F.col("it")[c]).alias(c) for c in documents.columns])
