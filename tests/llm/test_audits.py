"""The audits of filters and of sources against plain loops."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mailscope.llm import divergence, filter_audit
from tests.llm.helpers import CLASHES, DOCUMENTS, awkward, corpus, prose
from tests.llm.test_operators import result, words_of

LABELS = "doc_id long, quality int, toxic int"

# --- filters


def documents():
    pick, rows = random.Random(8), awkward()
    for doc_id in range(100, 220):
        text = prose(pick.randint(0, 9), pick.choice([150, 230, 260]))
        text += pick.choice(["", "", " #", " & |"]) + pick.choice(["", "SHOUTING WORDS " * 20]) + pick.choice(["", " again" * 400])
        rows.append((doc_id, text, "en", pick.choice(["a", "b", "", None]), 1))
    return rows


def labels():
    pick = random.Random(9)
    rows = [(doc_id, pick.choice([0, 1, None]), pick.choice([0, 1])) for doc_id in range(90, 200)]
    return [*rows, (100, 1, 0), (100, 0, 1), (None, 1, 1), (6, 1, None)]


def failed(rows):
    found = []
    for doc_id, text, _, source, _ in rows:
        text, words = text or "", words_of(text)
        mask = ""
        mask += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        mask += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        if doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows):
            mask += "E"
        found.append((doc_id, source or "", mask))
    return found


def audited(rows, marks):
    good, toxic = ({m[0] for m in marks if m[n] == 1 and m[0] is not None} for n in (1, 2))
    found = []
    masks = failed(rows)
    for part in {p for _, p, _ in masks}:
        here = [(i, m) for i, p, m in masks if p == part]
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, letter in enumerate(order, start=1):
                gone, left = [x for x in left if letter in x[1]], [x for x in left if letter not in x[1]]
                removed[order, letter] = len(gone)
                redundant = sum(letter in m for _, m in here) - len(gone)
                unique = sum(m == letter for _, m in here)
                lost = (sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                found.append((part, order, step, len(left), len(gone), redundant, unique, *lost))
        totals = collections.Counter()
        for (_, letter), n in removed.items():
            totals[letter] += n
        found = [(*r, totals[r[1][r[2] - 1]]) if r[0] == part else r for r in found]
    return sorted(found, key=repr)


def test_filter_audit(spark):
    rows, marks = documents(), labels()
    assert {c for _, _, m in failed(rows) for c in m} == set("ABCDE")
    table, judged = corpus(spark, rows), spark.createDataFrame(marks, LABELS)
    expected = audited(rows, marks)
    assert result(filter_audit.audit(table, judged)) == expected
    more = filter_audit.audit(corpus(spark, rows, **CLASHES, mask=1, t1=2, good=3, _least=4, part="q"), judged.withColumn("mask", F.lit(1)))
    assert result(more) == expected


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(corpus(spark, []), none).count() == 0
    assert filter_audit.audit(corpus(spark), none).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_reach_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for level in filter_audit.swaps(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(n)


def test_swapped_diagrams_are_those_built_in_that_order():
    pick = random.Random(2)
    for _ in range(20):
        weights = {mask: (pick.randint(0, 2), 0, 0) for mask in range(32) if pick.random() < 0.6}
        diagram = filter_audit.Diagram("ABCDE", weights)
        for level in filter_audit.swaps(5):
            diagram.swap(level)
            moved = {sum((mask >> "ABCDE".index(c) & 1) << n for n, c in enumerate(diagram.order)): w for mask, w in weights.items()}
            built = filter_audit.Diagram(diagram.order, moved)
            assert diagram.sizes == built.sizes and list(diagram.steps()) == list(built.steps())


# --- sources


def share(n, total):
    return 1 + 10**9 * (n + 1) // total


def diverging(rows, plan):
    docs = [(lang or "", source or "", text or "") for _, text, lang, source, _ in rows]
    found = []
    for lang in {d[0] for d in docs}:
        held, in_documents = collections.defaultdict(collections.Counter), collections.Counter()
        for of, source, text in docs:
            if of == lang:
                table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
                terms = [t.translate(table) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
                held[source].update(terms)
                in_documents.update(set(terms))
        kept = {t for t, n in in_documents.items() if n >= plan.min_documents}
        counts = {s: {t: n for t, n in c.items() if t in kept} for s, c in held.items()}
        total = {t: sum(c.get(t, 0) for c in counts.values()) for t in kept}

        def shares(c):
            return {t: share(c.get(t, 0), sum(c.values()) + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        apart = lambda a, b: (a - b) * (a - b) // b
        for source in counts:
            pairs = [(o, sum(apart(p[source][t], p[o][t]) for t in kept)) for o in counts if o != source]
            more = [(t, apart(p[source][t], q[t])) for t in counts[source] if p[source][t] > q[t]]
            for part, values in (("pair", pairs), ("term", more)):
                values.sort(key=lambda v: (-v[1], v[0].encode()))
                values = values if part == "pair" else values[: plan.top]
                found += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(values, start=1)]
    return sorted(found, key=repr)


def sources():
    pick, rows = random.Random(6), awkward()
    for doc_id in range(300, 380):
        text = prose(pick.randint(0, 30), pick.choice([20, 60])) + pick.choice([" ÉTÉ Été été", " naïve_word x1y", "  日本\u0085", ""])
        rows.append((doc_id, text, pick.choice(["en", "de", "", None]), pick.choice(["a", "b", "c", "", None]), 1))
    return [*rows, (900, "alone", "xx", "s", 1), (901, "1 2 3", "yy", "s", 1), (902, None, "yy", "t", 1)]


@pytest.mark.parametrize(("vocabulary", "top", "chunk"), [(1 << 22, 200, 1 << 16), (1500, 3, 5)])
def test_divergence(spark, monkeypatch, vocabulary, top, chunk):
    monkeypatch.setattr(divergence, "WIDTH", 1 << 23 if vocabulary > 1500 else 500)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows, plan = sources(), divergence.AuditPlan(top=top, vocabulary=vocabulary)
    expected = diverging(rows, plan)
    assert any(r[4] for r in expected if r[2] == "pair") and ("yy", "s", "pair", "t", 0, 1) in expected
    assert result(divergence.audit(corpus(spark, rows).repartition(4), plan)) == expected
    if top == 200:
        more = corpus(spark, rows, **CLASHES, cell=1, terms=2, p=3, q=4, zero=5, v=6, n=7, term="t", item="i", vector=8)
        assert result(divergence.audit(more, plan)) == expected


def test_documents_of_a_group_are_added_up(spark, monkeypatch):
    """Rows go out by group and not by document, and still tell which terms three documents have."""
    rows = [(i, "All alike " + "rare " * (i < 2) + "twice twice", "en", "ab"[i % 2], 0) for i in range(40)]
    table = corpus(spark, rows).coalesce(1)
    found = {r.source: r for r in divergence.term_counts(table, 3).collect()}
    assert found.keys() == {"a", "b"} and all(len(r.terms) == 4 and list(r.held) == [4, 3, 3] for r in found.values())
    assert dict(zip(found["a"].terms, found["a"].counts)) == {"en\0all": 20, "en\0alike": 20, "en\0twice": 40, "en\0rare": 1}
    for together in (1, 7, 1 << 17):
        monkeypatch.setattr(divergence, "TOGETHER", together)
        sums, kept = divergence.group_sums(table.repartition(3))
        assert {(r.source, r.term, r.n) for r in sums.collect()} == {(s, t, 20 * (1 + (t == "twice"))) for s in "ab" for t in ("all", "alike", "twice")}
        assert [tuple(r) for r in kept.collect()] == [("en", 3)]


def test_terms_of_a_language_go_out_once_for_all_sources(spark):
    rows = [(i, "Alike, all " + "rare " * (i < 2) + f"of{'xyz'[i % 3]} twice twice", "en", "abc"[i % 3], 0) for i in range(30)]
    rows += [(40, "été;ÉTÉ", "fr", None, 0), (41, "1 2 3", "fr", "d", 0), (42, None, "de", "d", 0), (43, "end", "en", "a", 0), (44, "Start", "en", "a", 0)]
    found = {r.terms[0].split("\0")[0]: r for r in divergence.group_vectors(corpus(spark, rows).coalesce(1), 3).collect()}
    assert found.keys() == {"en", "fr"} and sorted(found["fr"].terms) == ["fr\0ÉtÉ", "fr\0été"] and list(found["fr"].held) == [2, 0, 0]
    terms, held, vectors = (found["en"][c] for c in ("terms", "held", "vectors"))
    assert len(terms) == len(set(terms)) == held[0] == 9 and set(terms[held[2]:]) == {"en\0rare", "en\0end", "en\0start"}
    assert list(held) == [9, 7, 6] and terms[6] == "en\0rare"
    counts = {v.source: {terms[at].removeprefix("en\0of"): n for at, n in zip(v.at, v.n)} for v in vectors}
    shared = {"en\0alike": 10, "en\0all": 10, "en\0twice": 20}
    assert counts["c"] == shared | {"z": 10} and counts["b"] == shared | {"y": 10, "en\0rare": 1}
    assert counts["a"] == shared | {"x": 10, "en\0rare": 1, "en\0end": 1, "en\0start": 1}


def test_sums_by_key_and_by_place_agree(spark, monkeypatch):
    """Many sources with few terms each are added up by sorting, few sources by place."""
    rows = [(i, f"word{i % 7} " * 3 + "same " + f"own{i}", "en", f"s{i % many}", 0) for many in (2, 200) for i in range(400)]
    sums, _ = divergence.group_sums(corpus(spark, rows).repartition(2))
    expected = collections.Counter()
    for _, text, _, source, _ in rows:
        expected.update((source, t) for t in re.findall("[a-z]+", text))
    assert {(r.source, r.term): r.n for r in sums.collect()} == {k: n for k, n in expected.items()}


def test_divergence_of_nothing(spark):
    assert divergence.audit(corpus(spark, [])).count() == 0
    assert divergence.audit(corpus(spark, [(1, None, None, None, None)])).count() == 0


def test_vocabularies_stay_within_their_bound(spark):
    table = corpus(spark, sources())
    whole, kept = divergence.group_sums(table)
    cut, same = divergence.group_sums(table, divergence.AuditPlan(vocabulary=1500))
    assert result(whole) == result(cut) and result(kept) == result(same)


def test_long_shares_do_not_overflow(spark):
    n, total = 8 * 10**15, 9 * 10**15
    found = spark.range(1).select(F.expr(divergence._share(f"{n}L", f"{total}L"))).first()[0]
    assert found == share(n, total)
    assert spark.createDataFrame([], DOCUMENTS).select(F.expr(divergence._share("1", "0"))).count() == 0
