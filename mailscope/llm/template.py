"""A small template language for conversations, compiled to closures.

    {% for message in messages %}{{ '<|im_start|>' ~ message.role ~ '\\n' }}{% generation %}...{% endgeneration %}{% endfor %}

`{{ }}` puts out a value, `{# #}` is a comment, `{%- -%}` takes the white space beside it away. There are `for message in
messages` (once, at the top level), `if`, `elif`, `else`, `set` and `generation`, whose output a model is to learn.
Expressions have strings, whole numbers, true, false, none, lists, names, `a.b`, `a['b']`, `|` with a filter, `~`, `+`, `-`,
comparisons, `in`, `and`, `or`, `not` and `a if b else c`.

A template cannot reach anything but its constants, the message and the loop: names are looked up in these, fields in
mappings only, and nothing can be called but the filters. No loop runs over anything but messages, so output is bounded.

The source is parsed into a syntax tree; parts without a name are computed once (:func:`folded`), branches that are
never taken go, texts side by side become one; what is left becomes nested functions.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

Value = Any
Env = Mapping[str, Value]

# --- texts that may hold control strings

_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """A text without `<|`: a backslash more between the two, wherever they stand with none or some between."""
    return _OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def line(text: str) -> str:
    """A text on one line."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[Value], Value]] = {
    "escape": lambda v: escape(_text(v)), "line": lambda v: line(_text(v)), "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v),
}


class TemplateError(ValueError):
    """A template that cannot be parsed, or that asks for what is not there."""


def _text(value: Value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str | int):
        return str(value)
    raise TemplateError(f"no text: {type(value).__name__}")


# --- syntax tree


@dataclass(frozen=True)
class Const:
    value: Value


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Node
    key: Node


@dataclass(frozen=True)
class Apply:
    """A filter, an operator or a list over its operands."""

    what: str
    operands: tuple[Node, ...]


@dataclass(frozen=True)
class Choice:
    """`and`, `or` and conditional expressions: only what is chosen is computed."""

    test: Node
    yes: Node | None
    no: Node | None


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Node


@dataclass(frozen=True)
class Set:
    name: str
    value: Node


@dataclass(frozen=True)
class If:
    test: Node
    yes: tuple[Node, ...]
    no: tuple[Node, ...]


@dataclass(frozen=True)
class Generation:
    body: tuple[Node, ...]


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple[Node, ...]


Node = Const | Name | Field | Apply | Choice | Text | Output | Set | If | Generation | Loop


def _add(a: Value, b: Value) -> Value:
    if isinstance(a, str) != isinstance(b, str) or not isinstance(a, str | int):
        raise TemplateError("+ takes two texts or two numbers")
    return a + b


OPERATORS: dict[str, Callable[..., Value]] = {
    "~": lambda a, b: _text(a) + _text(b), "+": _add, "-": operator.sub, "==": operator.eq, "!=": operator.ne,
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b,
    "not": operator.not_, "list": lambda *items: list(items),
}
OPERATORS |= {f"|{name}": function for name, function in FILTERS.items()}


def _field(of: Value, key: Value) -> Value:
    if not isinstance(of, Mapping):
        raise TemplateError(f"no fields in {type(of).__name__}")
    return of.get(key)


# --- parser

_PARTS = re.compile(r"\{\{-?(?P<value>.*?)-?\}\}|\{%-?(?P<statement>.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKENS = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<word>[A-Za-z_]\w*)"""
    r"""|(?P<sign>==|!=|<=|>=|[-~+<>|.,()\[\]=]))""",
    re.DOTALL,
)
_CHARACTERS = {"n": "\n", "t": "\t", "r": "\r"}
DEPTH = 50


def _tokens(source: str) -> list[tuple[str, str]]:
    found, at, source = [], 0, source.strip()
    while at < len(source):
        match = _TOKENS.match(source, at)
        if not match:
            raise TemplateError(f"cannot read {source[at : at + 20]!r}")
        found.append((match.lastgroup, match[match.lastgroup]))
        at = match.end()
    return found


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def whole(self) -> Node:
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, token = self.peek()
        if kind != "string" and token in wanted:
            self.at += 1
            return token
        return None

    def need(self, token: str) -> None:
        if not self.take(token):
            raise TemplateError(f"{token!r} is missing before {self.peek()[1]!r}")

    def choice(self) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("expressions are nested too deeply")
        found = self.either()
        if self.take("if"):
            test = self.either()
            no = self.choice() if self.take("else") else Const(None)
            found = Choice(test, found, no)
        self.depth -= 1
        return found

    def either(self) -> Node:
        found = self.both()
        while self.take("or"):
            found = Choice(found, None, self.both())
        return found

    def both(self) -> Node:
        found = self.negated()
        while self.take("and"):
            found = Choice(found, self.negated(), None)
        return found

    def negated(self) -> Node:
        if self.take("not"):
            return Apply("not", (self.negated(),))
        found = self.sum()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                found = Apply(sign, (found, self.sum()))
            elif self.take("not"):
                self.need("in")
                found = Apply("not", (Apply("in", (found, self.sum())),))
            else:
                return found

    def sum(self) -> Node:
        found = self.postfix()
        while sign := self.take("~", "+", "-"):
            found = Apply(sign, (found, self.postfix()))
        return found

    def postfix(self) -> Node:
        found = self.primary()
        while sign := self.take(".", "[", "|"):
            if sign == "[":
                found = Field(found, self.choice())
                self.need("]")
                continue
            kind, word = self.peek()
            if kind != "word":
                raise TemplateError(f"a name is missing after {sign!r}")
            self.at += 1
            if sign == "|" and word not in FILTERS:
                raise TemplateError(f"no filter {word!r}")
            found = Field(found, Const(word)) if sign == "." else Apply(f"|{word}", (found,))
        return found

    def primary(self) -> Node:
        kind, token = self.peek()
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _CHARACTERS.get(m[1], m[1]), token[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(token))
        if kind == "word":
            known = {"true": True, "false": False, "none": None}
            return Const(known[token]) if token in known else Name(token)
        if token == "(":
            found = self.choice()
            self.need(")")
            return found
        if token == "[":
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.take(","):
                    self.need("]")
                    break
            return Apply("list", tuple(items))
        raise TemplateError(f"unexpected {token!r}" if token else "an expression is missing")


def parse(source: str) -> tuple[Node, ...]:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for match in _PARTS.finditer(source):
        text = source[at : match.start()]
        text = text.lstrip() if strip else text
        marked = match[0].startswith(("{{-", "{%-"))
        pieces.append(("text", text.rstrip() if marked else text))
        if match.lastgroup:
            pieces.append((match.lastgroup, match[match.lastgroup]))
        at, strip = match.end(), match[0].endswith(("-}}", "-%}"))
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    parser = _Statements(pieces)
    return parser.block((), 0)[0]


class _Statements:
    def __init__(self, pieces: list[tuple[str, str]]):
        self.pieces, self.at, self.looped = pieces, 0, False

    def block(self, ends: tuple[str, ...], depth: int, inside: frozenset[str] = frozenset()) -> tuple[tuple[Node, ...], list]:
        """Statements up to one of `ends`, and the tokens of that."""
        if depth > DEPTH:
            raise TemplateError("statements are nested too deeply")
        found: list[Node] = []
        while self.at < len(self.pieces):
            kind, piece = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                found += [Text(piece)] if piece else []
                continue
            tokens = _tokens(piece)
            if kind == "value":
                found.append(Output(_Expression(tokens).whole()))
                continue
            word = tokens[0][1] if tokens else ""
            if word in ends:
                return tuple(found), tokens
            found.append(self.statement(word, tokens, depth, inside))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(found), []

    def statement(self, word: str, tokens: list, depth: int, inside: frozenset[str]) -> Node:
        if word == "if":
            yes, then = self.block(("elif", "else", "endif"), depth + 1, inside)
            return If(_Expression(tokens[1:]).whole(), yes, self.otherwise(then, depth + 1, inside))
        if word == "set" and len(tokens) > 3 and tokens[1][0] == "word" and tokens[2][1] == "=":
            return Set(tokens[1][1], _Expression(tokens[3:]).whole())
        if word == "generation" and "generation" not in inside:
            return Generation(self.block(("endgeneration",), depth + 1, inside | {"generation"})[0])
        if word == "for" and not depth and not self.looped and [t[1] for t in tokens[2:]] == ["in", "messages"]:
            self.looped = True
            return Loop(tokens[1][1], self.block(("endfor",), 1, inside | {"for"})[0])
        raise TemplateError(f"cannot take {' '.join(t[1] for t in tokens)!r} here")

    def otherwise(self, tokens: list, depth: int, inside: frozenset[str]) -> tuple[Node, ...]:
        if tokens[0][1] == "endif":
            return ()
        if tokens[0][1] == "else":
            return self.block(("endif",), depth, inside)[0]
        yes, then = self.block(("elif", "else", "endif"), depth, inside)
        return (If(_Expression(tokens[1:]).whole(), yes, self.otherwise(then, depth + 1, inside)),)


# --- constants


def _fold(node: Node, constants: Env) -> Node:
    match node:
        case Name(name) if name in constants:
            return Const(constants[name])
        case Field(of, key):
            of, key = _fold(of, constants), _fold(key, constants)
            both = isinstance(of, Const) and isinstance(key, Const)
            return Const(_field(of.value, key.value)) if both else Field(of, key)
        case Apply(what, operands):
            operands = tuple(_fold(o, constants) for o in operands)
            if all(isinstance(o, Const) for o in operands):
                return Const(OPERATORS[what](*[o.value for o in operands]))
            return Apply(what, operands)
        case Choice(test, yes, no):
            test, yes, no = (n and _fold(n, constants) for n in (test, yes, no))
            if isinstance(test, Const):
                chosen = yes if test.value else no
                return test if chosen is None else chosen
            return Choice(test, yes, no)
    return node


def folded(nodes: Iterable[Node], constants: Env) -> tuple[Node, ...]:
    """The same template with constant parts computed, dead branches gone and texts joined."""
    found: list[Node] = []

    def add(node: Node) -> None:
        if isinstance(node, Text) and found and isinstance(found[-1], Text):
            found[-1] = Text(found[-1].text + node.text)
        elif not isinstance(node, Text) or node.text:
            found.append(node)

    constants = dict(constants)
    nodes = tuple(nodes)
    for name in _assigned(nodes):  # what a template sets is no constant
        constants.pop(name, None)
    for node in nodes:
        match node:
            case Output(value):
                value = _fold(value, constants)
                for part in _parts(value):
                    add(Text(_text(part.value)) if isinstance(part, Const) else Output(part))
            case Set(name, value):
                add(Set(name, _fold(value, constants)))
            case If(test, yes, no):
                test = _fold(test, constants)
                if isinstance(test, Const):
                    for inner in folded(yes if test.value else no, constants):
                        add(inner)
                else:
                    add(If(test, folded(yes, constants), folded(no, constants)))
            case Generation(body):
                add(Generation(folded(body, constants)))
            case Loop(name, body):
                inner = {k: v for k, v in constants.items() if k not in (name, "loop")}
                add(Loop(name, folded(body, inner)))
            case _:
                add(node)
    return tuple(found)


def _parts(value: Node) -> Iterator[Node]:
    """What a value that is put out is joined from."""
    if isinstance(value, Apply) and value.what == "~":
        for operand in value.operands:
            yield from _parts(operand)
    else:
        yield value


def _assigned(nodes: Iterable[Node]) -> Iterator[str]:
    for node in nodes:
        match node:
            case Set(name, _):
                yield name
            case If(_, yes, no):
                yield from _assigned((*yes, *no))
            case Generation(body) | Loop(_, body):
                yield from _assigned(body)


# --- closures


@dataclass
class Rendered:
    """A text in pieces, and where what a model is to learn starts and ends in it, in code points."""

    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)


Action = Callable[[dict, Rendered], None]


def _value(node: Node) -> Callable[[Env], Value]:
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):
            def look(env: Env) -> Value:
                if name not in env:
                    raise TemplateError(f"no {name!r}")
                return env[name]

            return look
        case Field(of, key):
            of, key = _value(of), _value(key)
            return lambda env: _field(of(env), key(env))
        case Apply(what, (one,)):
            function, one = OPERATORS[what], _value(one)
            return lambda env: function(one(env))
        case Apply(what, (one, two)):
            function, one, two = OPERATORS[what], _value(one), _value(two)
            return lambda env: function(one(env), two(env))
        case Apply(what, operands):
            function, operands = OPERATORS[what], [_value(o) for o in operands]
            return lambda env: function(*[o(env) for o in operands])
        case Choice(test, yes, no):
            test, yes, no = _value(test), yes and _value(yes), no and _value(no)

            def choose(env: Env) -> Value:
                found = test(env)
                chosen = yes if found else no
                return found if chosen is None else chosen(env)

            return choose
    raise TemplateError(f"no value: {node}")


def _action(node: Node) -> Action:
    match node:
        case Text(text):
            return lambda env, out: out.add(text)
        case Output(value):
            value = _value(value)
            return lambda env, out: out.add(_text(value(env)))
        case Set(name, value):
            value = _value(value)
            return lambda env, out: env.__setitem__(name, value(env))
        case If(test, yes, no):
            test, yes, no = _value(test), _sequence(yes), _sequence(no)
            return lambda env, out: (yes if test(env) else no)(env, out)
        case Generation(body):
            body = _sequence(body)

            def learn(env: dict, out: Rendered) -> None:
                start = out.length
                body(env, out)
                out.spans.append((start, out.length))

            return learn
    raise TemplateError(f"cannot run {node}")


def _sequence(nodes: Iterable[Node]) -> Action:
    actions = [_action(node) for node in nodes]
    if len(actions) == 1:
        return actions[0]

    def run(env: dict, out: Rendered) -> None:
        for action in actions:
            action(env, out)

    return run


class Template:
    """A compiled template; `constants` are the names it may use beside the message and the loop.

    Everything before the loop over messages belongs to the first message of a conversation, what follows it to the last,
    so a long conversation can be rendered piece by piece: names set before the loop hold in all of it, names set
    inside for the rest of the message only.
    """

    def __init__(self, source: str, **constants: Value):
        self.tree = folded(parse(source), constants)
        at = next((i for i, node in enumerate(self.tree) if isinstance(node, Loop)), None)
        if at is None:
            raise TemplateError("the loop over messages is missing")
        loop = self.tree[at]
        self.constants, self.name = constants, loop.name
        self._before, self._body, self._after = map(_sequence, (self.tree[:at], loop.body, self.tree[at + 1 :]))

    def start(self) -> dict:
        """The names that hold for all messages."""
        env = dict(self.constants)
        self._before(env, Rendered())
        return env

    def render_turn(self, env: dict, message: Mapping, index: int, count: int, out: Rendered) -> None:
        """Add message number `index` (from 0) of `count`."""
        first, last = index == 0, index == count - 1
        if first:
            self._before(dict(self.constants), out)
        loop = {"index": index + 1, "first": first, "last": last, "length": count}
        self._body(env | {self.name: message, "loop": loop}, out)
        if last:
            self._after(dict(env), out)

    def render(self, messages: Iterable[Mapping]) -> Rendered:
        """A whole conversation."""
        messages, env, out = list(messages), self.start(), Rendered()
        for index, message in enumerate(messages):
            self.render_turn(env, message, index, len(messages), out)
        return out
