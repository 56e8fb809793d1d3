"""Compiler of a small, sandboxed template language for conversations.

Source text is lexed, parsed to a syntax tree, folded (constant expressions, constant branches, neighbouring text)
and turned into Python closures. Each closure is a generator of ``(text, in_generation)`` pieces, so a conversation
renders while its messages are read and is never held as a whole.

Language: ``{{ expr }}``, ``{% for x in xs %}``, ``{% if %} {% elif %} {% else %}``, ``{% set x = expr %}``,
``{% generation %} ... {% endgeneration %}`` and ``{# comment #}``. Expressions have literals, names, ``a.b`` and
``a['b']`` on mappings only, ``~ + - * %``, comparisons, ``in``, ``not``, ``and``, ``or`` and filters. In a loop,
``loop.index0``, ``loop.index``, ``loop.first`` and ``loop.last`` are known. There are no calls, no attributes of
Python objects and no way to reach either.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template's source is wrong, or it asks for something outside the sandbox."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class Assign:
    name: str
    expr: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body); a condition of Const(True) is "else"


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- control strings ----------------------------------------------------------------------------------------------

# The strings that mark turns.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """No control string survives: each ``<``, backslashes, ``|`` gets one backslash more. Reversible."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def header(text: str) -> str:
    """A text on one line, for headers. Reversible."""
    return escape(text).replace("%", "%25").replace("\n", "%0A")


def unheader(text: str) -> str:
    return unescape(text.replace("%0A", "\n").replace("%25", "%"))


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "header": lambda x: header(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "lower": lambda x: _text(x).lower(),
    "upper": lambda x: _text(x).upper(),
    "length": len,
    "default": lambda x, y="": y if x is None else x,
}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _number(x: Any) -> int | float:
    """Texts are neither repeated nor formatted: a short template must not make a long text."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise TemplateError(f"not a number: {x!r}")
    return x


OPERATORS: dict[str, Callable] = {
    "~": lambda a, b: _text(a) + _text(b), "+": operator.add, "-": operator.sub, "*": lambda a, b: _number(a) * _number(b), "%": lambda a, b: _number(a) % _number(b),
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "not": operator.not_,
}

# -- lexer --------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#-?.*?-?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    found, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        number, string, name, sign = m.groups()
        if number is not None:
            found.append(("const", int(number)))
        elif string is not None:
            found.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
        else:
            found.append(("name", name) if name else ("sign", sign))
        at = m.end()
    return found


# -- parser -------------------------------------------------------------------------------------------------------


@dataclass
class _Expression:
    tokens: list
    at: int = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def identifier(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        name = self.tokens[self.at - 1][1]
        if name.startswith("_"):
            raise TemplateError(f"{name!r} is outside the sandbox")
        return name

    def whole(self) -> Any:
        found = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.summed()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            left = Op(op, (left, self.summed()))
        return left

    def summed(self) -> Any:
        left = self.multiplied()
        while op := self.take("+", "-", "~"):
            left = Op(op, (left, self.multiplied()))
        return left

    def multiplied(self) -> Any:
        left = self.filtered()
        while op := self.take("*", "%"):
            left = Op(op, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        left = self.primary()
        while self.take("|"):
            name, args = self.identifier(), [left]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
            left = Filter(name, tuple(args))
        return left

    def primary(self) -> Any:
        if self.take("("):
            found = self.either()
            self.need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            found = Const(self.tokens[self.at - 1][1])
        else:
            name = self.identifier()
            found = {"true": Const(True), "false": Const(False), "none": Const(None)}.get(name, Name(name))
        while True:
            if self.take("."):
                found = Item(found, Const(self.identifier()))
            elif self.take("["):
                found = Item(found, self.either())
                self.need("]")
            else:
                return found


def _expression(source: str) -> Any:
    return _Expression(_tokens(source)).whole()


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    pieces: list[tuple[str, str]] = []
    at = 0
    cut = False  # does the tag before trim what follows it?
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if cut else text
        text = text.rstrip() if m[0][2] == "-" else text
        cut = m[0][-3] == "-"
        if text:
            pieces.append(("text", text))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    text = source[at:].lstrip() if cut else source[at:]
    if text:
        pieces.append(("text", text))
    body, at, _ = _body(pieces, 0, ())
    return body


def _body(pieces: list, at: int, ends: tuple) -> tuple[tuple, int, str]:
    nodes: list = []
    while at < len(pieces):
        kind, source = pieces[at]
        at += 1
        if kind == "text":
            nodes.append(Text(source))
            continue
        if kind == "out":
            nodes.append(Output(_expression(source)))
            continue
        word, _, rest = source.partition(" ")
        if word in ends:
            return tuple(nodes), at, source
        if word == "if":
            branches, condition, tag = [], _expression(rest), ""
            while tag != "endif":
                inner, at, tag = _body(pieces, at, ("elif", "else", "endif"))
                branches.append((condition, inner))
                condition = _expression(tag.partition(" ")[2]) if tag.startswith("elif") else Const(True)
            nodes.append(If(tuple(branches)))
        elif word == "for":
            name, _, of = rest.partition(" in ")
            target = _Expression(_tokens(name)).identifier()
            inner, at, _ = _body(pieces, at, ("endfor",))
            nodes.append(For(target, _expression(of), inner))
        elif word == "set":
            name, _, value = rest.partition("=")
            nodes.append(Assign(_Expression(_tokens(name)).identifier(), _expression(value)))
        elif word == "generation":
            inner, at, _ = _body(pieces, at, ("endgeneration",))
            nodes.append(Generation(inner))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if ends:
        raise TemplateError(f"expected {' or '.join(ends)}")
    return tuple(nodes), at, ""


# -- constant folding ---------------------------------------------------------------------------------------------


def fold_expression(e: Any) -> Any:
    if isinstance(e, Item):
        return Item(fold_expression(e.of), fold_expression(e.key))
    if isinstance(e, Filter):
        args = tuple(map(fold_expression, e.args))
        return Const(FILTERS[e.name](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Filter(e.name, args)
    if isinstance(e, Op):
        args = tuple(map(fold_expression, e.args))
        if e.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.op == "and") else args[0]
        if e.op in OPERATORS and all(isinstance(a, Const) for a in args):
            try:
                return Const(OPERATORS[e.op](*(a.value for a in args)))
            except (TypeError, ZeroDivisionError) as error:
                raise TemplateError(str(error)) from error
        return Op(e.op, args)
    return e


def fold(nodes: Iterable) -> tuple:
    """The same template with constants folded: fewer nodes, never another output."""
    out: list = []

    def add(node):
        if isinstance(node, Text) and (not node.text or out and isinstance(out[-1], Text)):
            if node.text:
                out[-1] = Text(out[-1].text + node.text)
        else:
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            e = fold_expression(node.expr)
            add(Text(_text(e.value)) if isinstance(e, Const) else Output(e))
        elif isinstance(node, Assign):
            add(Assign(node.name, fold_expression(node.expr)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body)))
        elif isinstance(node, For):
            add(For(node.name, fold_expression(node.of), fold(node.body)))
        elif isinstance(node, If):
            branches = []
            for condition, body in node.branches:
                c = fold_expression(condition)
                if isinstance(c, Const) and not c.value:
                    continue
                branches.append((c, fold(body)))
                if isinstance(c, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(If(tuple(branches)))
        else:
            add(node)
    return tuple(out)


# -- closures -----------------------------------------------------------------------------------------------------


def _value(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        value = e.value
        return lambda scope: value
    if isinstance(e, Name):
        name = e.name
        return lambda scope: scope.get(name)
    if isinstance(e, Item):
        of, key = _value(e.of), _value(e.key)

        def item(scope):
            whole = of(scope)
            if not isinstance(whole, dict):
                raise TemplateError("only mappings have items")
            return whole.get(key(scope))

        return item
    if isinstance(e, Filter):
        f, args = FILTERS[e.name], [_value(a) for a in e.args]
        if len(args) == 1:
            only = args[0]
            return lambda scope: f(only(scope))
        return lambda scope: f(*[a(scope) for a in args])
    args = [_value(a) for a in e.args]
    if e.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if e.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    f = OPERATORS[e.op]
    if len(args) == 1:
        return lambda scope: f(args[0](scope))
    return lambda scope: f(args[0](scope), args[1](scope))


Renderer = Callable[[dict, bool], Iterator[Piece]]


def _block(nodes: tuple) -> Renderer:
    parts = [_node(n) for n in nodes]
    if len(parts) == 1:
        return parts[0]

    def block(scope, inside):
        for part in parts:
            yield from part(scope, inside)

    return block


def _node(node: Any) -> Renderer:
    if isinstance(node, Text):
        text = node.text

        def constant(scope, inside):
            yield text, inside

        return constant
    if isinstance(node, Output):
        value = _value(node.expr)

        def output(scope, inside):
            yield _text(value(scope)), inside

        return output
    if isinstance(node, Assign):
        name, value = node.name, _value(node.expr)

        def assign(scope, inside):
            scope[name] = value(scope)
            return iter(())

        return lambda scope, inside: assign(scope, inside)
    if isinstance(node, Generation):
        body = _block(node.body)
        return lambda scope, inside: body(scope, True)
    if isinstance(node, If):
        branches = [(_value(c), _block(b)) for c, b in node.branches]

        def choose(scope, inside):
            for condition, body in branches:
                if condition(scope):
                    yield from body(scope, inside)
                    return

        return choose
    if isinstance(node, For):
        name, of, body = node.name, _value(node.of), _block(node.body)

        def loop(scope, inside):
            rest, index = iter(of(scope) or ()), 0
            done = object()
            now = next(rest, done)
            while now is not done:
                following = next(rest, done)
                inner = scope | {name: now, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": following is done}}
                yield from body(inner, inside)
                now, index = following, index + 1

        return loop
    raise TemplateError(f"unknown node {node!r}")


@dataclass(frozen=True)
class Template:
    """A compiled template; pickles as its source."""

    source: str
    tree: tuple = field(init=False, compare=False, repr=False)
    render_pieces: Renderer = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "tree", fold(parse(self.source)))
        object.__setattr__(self, "render_pieces", _block(self.tree))

    def __reduce__(self):
        return Template, (self.source,)

    def pieces(self, **values: Any) -> Iterator[Piece]:
        return self.render_pieces(dict(values), False)

    def render(self, **values: Any) -> str:
        return "".join(text for text, _ in self.pieces(**values))


DEFAULT = Template(
    "{% for m in messages %}<|im_start|>{{ m.role | header }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
