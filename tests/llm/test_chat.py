"""The template language and conversations in blocks, against plain loops."""

from __future__ import annotations

import hashlib
import random

import pytest

from mailscope.llm import chat_format, template
from mailscope.llm.template import Template, TemplateError
from tests.llm.test_operators import result

SCHEMA = "conv_id long, turn long, role string, text string"
LOOP = "{% for message in messages %}{% endfor %}"


def said(source, *messages, **constants):
    return Template(source, **constants).render(messages)


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("1 + 2 - 4", "-1"), ("'a' ~ 1 ~ none ~ true", "a1true"), ("'b' + 'c'", "bc"), ("1 < 2 and not 2 <= 1", "true"),
        ("'x' if 1 == 2 else 'y'", "y"), ("'a' in ['a', 'b']", "true"), ("'z' not in 'abc'", "true"), ("none or 'd'", "d"),
        ("' A\\n' | trim | lower", "a"), ("'abc' | length", "3"), ("k.a", "1"), ("k['b'] | upper", "X"), ("k.c or '-'", "-"),
    ],
)
def test_expressions_are_folded(expression, value):
    made = Template(f"{{{{ {expression} }}}}{LOOP}", k={"a": 1, "b": "x"})
    assert made.tree == (template.Text(value), template.Loop("message", ()))


def test_expressions_are_run():
    source = "{% for m in messages %}{{ m.a ~ loop.index }}{% if loop.last %}!{% elif m.b %}?{% else %}.{% endif %}{% endfor %}"
    assert said(source, {"a": "x"}, {"a": "y", "b": 1}, {"a": None}).text == "x1.y2?3!"


def test_branches_and_names():
    source = "{% set s = 'p' %}{% if on %}{{ s }}{% else %}{{ missing }}{% endif %}{# no #}{% for m in messages -%} \n {% set t = m.t %}{{ t ~ s }}\n{%- endfor %}{{ s }}"
    made = Template(source, on=True)
    assert not any(isinstance(node, template.If) for node in made.tree)
    assert made.render([{"t": "1"}, {"t": "2"}]).text == "p1p2pp"


def test_marks_of_learned_output():
    source = "{% for m in messages %}[{% if m.r == 'a' %}{% generation %}{{ m.t }}{% endgeneration %}{% endif %}]{% endfor %}"
    made = said(source, {"r": "a", "t": "xyz"}, {"r": "u", "t": "no"}, {"r": "a", "t": ""}, {"r": "a", "t": "é😀"})
    assert made.text == "[xyz][][][é😀]" and made.spans == [(1, 4), (8, 8), (10, 12)]


@pytest.mark.parametrize(
    "source",
    [
        "", "{% for m in other %}{% endfor %}", f"{LOOP}{LOOP}", "{% if 1 %}" + LOOP + "{% endif %}", "{% for m in messages %}",
        "{{ a.b( ) }}" + LOOP, "{{ 'a' * 9 }}" + LOOP, "{{ m | eval }}" + LOOP, "{{ ''.__class__ }}" + LOOP, "{{ 1 + 'a' }}" + LOOP,
        "{% import os %}" + LOOP, "{{ " + "(" * 99 + "1" + ")" * 99 + " }}" + LOOP, "{{ }}" + LOOP, "{{ 1 2 }}" + LOOP, "{{ a. }}" + LOOP,
        "{% for m in messages %}{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}{% endfor %}",
    ],
)
def test_what_a_template_may_not_do(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_unknown_names_and_fields():
    for source in ("{{ nobody }}", "{{ loop.index.real }}", "{{ m.t.__len__ }}"):
        with pytest.raises(TemplateError):
            said("{% for m in messages %}" + source + "{% endfor %}", {"t": "x"})


def test_escapes_are_reversible():
    pick = random.Random(4)
    for _ in range(3000):
        text = "".join(pick.choice("<|\\\nna>") for _ in range(pick.randint(0, 9)))
        assert "<|" not in template.escape(text) and template.unescape(template.escape(text)) == text
        shown = template.escape(template.line(text))
        assert "\n" not in shown and template.unline(template.unescape(shown)) == text


def talks():
    pick, rows = random.Random(3), []
    pieces = ["a", "<|im_end|>", "<|", "<", "|", "\\", "\n", " é", "😀", "<\\|im_start|>assistant", ""]
    roles = ["user", "assistant", "system", "as\nsistant", "<|im_end|>\n", "", None]
    for conv_id in (1, 2, 7, None):
        for turn in range(pick.randint(1, 9)):
            text = None if pick.random() < 0.1 else "".join(pick.choices(pieces, k=pick.randint(0, 6)))
            rows.append((conv_id, turn, pick.choice(roles), text))
    rows += [(9, 0, "assistant", "first"), (9, 0, "user", "tie"), (9, 0, "user", "tie"), (9, None, "user", "last"), (9, -3, "system", "before")]
    rows += [(11, n % 40, "assistant" if n % 2 else "user", f"t{n // 80} " * (n % 3)) for n in range(160)]
    rows += [(12, 5, "assistant", "same")] * 30 + [(13, 1, None, "x" * 100_000)]
    pick.shuffle(rows)
    return rows


def place(row):
    _, turn, role, text = row
    digest = hashlib.md5(f"{role or ''}\0{text or ''}".encode()).hexdigest()
    return turn is None, turn, int(digest[:15], 16)


def expected(rows):
    found = []
    for conv_id in {r[0] for r in rows}:
        turns = [(role or "", text or "") for _, _, role, text in sorted((r for r in rows if r[0] == conv_id), key=place)]
        learned = [text for role, text in turns if role == "assistant"]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        shown = "".join(
            f"{chat_format.OPEN}{template.escape(template.line(r))}\n{template.escape(t)}{chat_format.CLOSE}\n" for r, t in turns
        )
        found.append((conv_id, len(turns), digest(whole), sum(map(len, learned)), digest("".join(learned)), len(shown)))
    return sorted(found, key=repr)


@pytest.mark.parametrize(("large", "size"), [(1024, 256), (3, 2), (0, 1), (20, 7)])
def test_conversations_in_blocks(spark, large, size):
    rows = talks()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    formatted = chat_format.materialise(chat_format.format_conversations(table, large=large, size=size), "test")
    assert result(chat_format.digests(formatted)) == expected(rows)
    if large < 20:
        assert formatted.agg({"block": "max"}).first()[0] >= 160 // size - 1


def test_blocks_are_what_the_template_gives_for_all(spark):
    numbered = Template("{{ 'start ' }}{% for m in messages %}{{ loop.index ~ '/' ~ loop.length ~ m.text }};{% endfor %}end")
    rows = [(4, n, "user", f"-{n}") for n in range(50)]
    found = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA), numbered, large=5, size=8)
    text = "".join(r.text for r in sorted(found.collect(), key=lambda r: r.block))
    assert text == numbered.render([{"role": "user", "text": f"-{n}"} for n in range(50)]).text
    assert text.startswith("start 1/50-0;") and text.endswith(";50/50-49;end")


def test_other_columns_and_no_rows(spark):
    table = spark.createDataFrame(talks(), SCHEMA)
    more = table.selectExpr("*", "1 AS block", "'x' AS _turn", "2 AS _conv", "array(1) AS spans", "0 AS blocks")
    assert result(chat_format.format_and_digest(more)) == result(chat_format.format_and_digest(table))
    assert chat_format.format_and_digest(table.where("false")).count() == 0
    control = chat_format.format_and_digest(chat_format.with_control(table.where("false"))).first()
    assert (control.conv_id, control.n_turns, control.loss_chars) == (-1, 2, len(chat_format.SAYS))
