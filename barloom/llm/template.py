"""A sandboxed template language, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% statement %}`` and ``{# comment #}``; a ``-`` inside a delimiter strips white
space on that side. Statements: ``for NAME in expression``, ``if``/``elif``/``else``, ``set NAME = expression`` and
``generation``, whose body is what a model learns to write. Expressions: literals, lists, names, ``a.b`` and ``a['b']`` on
mappings and lists, ``not and or``, comparisons, ``in``, ``+ - * // %`` on numbers, ``~`` on text, ``x if c else y``, ``is [not] defined``
and ``is [not] none``, and filters ``x | name(arguments)``.

There is nothing to break out of: values are text, numbers, booleans, none, lists and mappings; a dot looks up a key, never an
attribute; nothing can be called but the filters handed to ``compile_template``; ``for`` runs over lists and the
conversation's messages only, so every rendering ends.

Parsing gives a syntax tree of tuples, ``fold`` computes what is constant (operators and pure filters of literals, branches
of decided conditions, neighbouring text), and each node of what is left becomes one closure. A rendering is a generator of
text pieces and of the markers ``BEGIN`` and ``END``: with an iterator as ``messages`` a conversation of any length
needs the memory of two messages.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

#: Markers around what a generation block writes.
BEGIN, END = object(), object()
MISSING = object()

TOKEN = re.compile(
    r"""\s*(?:(?P<close>-?[%}]\})|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<sign>==|!=|<=|>=|//|[-+*%~<>()\[\].,|=]))""",
    re.S,
)
OPEN = re.compile(r"\{([{%#])(-?)")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = frozenset("and or not in is if else for set true false none True False None".split())
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "//": operator.floordiv, "%": operator.mod}
MAX_DEPTH = 50


class TemplateError(ValueError):
    """The template is not of this language, or asks for what its values cannot give."""


def _text(value: Any) -> str:
    if value is None or value is MISSING:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only text, numbers and booleans can be written")


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v),
    "default": lambda v, other="": other if v is MISSING or v is None else v,
    "replace": lambda v, old, new: _text(v).replace(old, new),
}


class Parser:
    """Template text to a syntax tree: a list of statement tuples."""

    def __init__(self, source: str) -> None:
        self.source, self.at, self.depth, self.strip = source, 0, 0, False
        self.kind = self.value = ""

    def fail(self, what: str) -> TemplateError:
        return TemplateError(f"{what} at character {self.at}")

    def step(self) -> None:
        m = TOKEN.match(self.source, self.at)
        if not m:
            raise self.fail("unknown token")
        self.at, self.kind, self.value = m.end(), m.lastgroup, m[m.lastgroup]

    def take(self, *values: str) -> bool:
        if self.kind in ("sign", "name") and self.value in values:
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.fail(f"expected {value}")

    def name(self) -> str:
        if self.kind != "name" or self.value in WORDS:
            raise self.fail("expected a name")
        name = self.value
        self.step()
        return name

    def finish(self, mark: str) -> None:
        """The closing delimiter has been read as a token."""
        if self.kind != "close" or self.value.lstrip("-") != mark:
            raise self.fail(f"expected {mark}")
        self.strip = self.value[0] == "-"

    def body(self, *ends: str) -> tuple[list[tuple], str]:
        """Statements up to one of ``ends``; the end's own tag is read up to its first argument."""
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.fail("nested too deeply")
        out: list[tuple] = []
        while True:
            m = OPEN.search(self.source, self.at)
            plain = self.source[self.at : m.start() if m else None]
            plain = plain.lstrip() if self.strip else plain
            plain = plain.rstrip() if m and m[2] else plain
            self.strip = False
            if plain:
                out.append(("text", plain))
            if not m:
                self.at = len(self.source)
                if ends:
                    raise self.fail(f"expected {' or '.join(ends)}")
                break
            self.at = m.end()
            if m[1] == "#":
                end = self.source.find("#}", self.at)
                if end < 0:
                    raise self.fail("open comment")
                self.strip, self.at = self.source[end - 1] == "-", end + 2
                continue
            self.step()
            if m[1] == "{":
                out.append(("write", self.expression()))
                self.finish("}}")
                continue
            word = self.value if self.kind == "name" else ""
            self.step()
            if word in ends:
                self.depth -= 1
                return out, word
            out.append(self.statement(word))
        self.depth -= 1
        return out, ""

    def statement(self, word: str) -> tuple:
        if word == "set":
            name = self.name()
            self.need("=")
            value = self.expression()
            self.finish("%}")
            return ("set", name, value)
        if word == "for":
            name = self.name()
            self.need("in")
            items = self.expression()
            self.finish("%}")
            inner, _ = self.body("endfor")
            self.finish("%}")
            return ("for", name, items, inner)
        if word == "generation":
            self.finish("%}")
            inner, _ = self.body("endgeneration")
            self.finish("%}")
            return ("generation", inner)
        if word == "if":
            return self.branch()
        raise self.fail(f"unknown statement {word}")

    def branch(self) -> tuple:
        condition = self.expression()
        self.finish("%}")
        yes, end = self.body("elif", "else", "endif")
        no: list[tuple] = []
        if end == "elif":
            return ("if", condition, yes, [self.branch()])
        self.finish("%}")
        if end == "else":
            no, _ = self.body("endif")
            self.finish("%}")
        return ("if", condition, yes, no)

    def expression(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise self.fail("nested too deeply")
        value = self.either()
        if self.take("if"):
            condition = self.either()
            other = self.expression() if self.take("else") else ("const", None)
            value = ("choose", condition, value, other)
        self.depth -= 1
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        odd = False
        while self.take("not"):
            odd = not odd
        value = self.comparison()
        return ("not", value) if odd else value

    def comparison(self) -> tuple:
        left = self.sum()
        while True:
            if self.kind == "sign" and self.value in COMPARE:
                sign = self.value
                self.step()
                left = ("compare", sign, left, self.sum())
            elif self.take("in"):
                left = ("in", left, self.sum())
            elif self.take("not"):
                self.need("in")
                left = ("not", ("in", left, self.sum()))
            elif self.take("is"):
                odd = self.take("not")
                if not (self.kind == "name" and self.value in ("defined", "none")):
                    raise self.fail("expected defined or none")
                left = ("is", self.value, left)
                self.step()
                left = ("not", left) if odd else left
            else:
                return left

    def _chain(self, signs: tuple[str, ...], part: Callable[[], tuple]) -> tuple:
        left = part()
        while self.kind == "sign" and self.value in signs:
            sign = self.value
            self.step()
            left = ("calc", sign, left, part())
        return left

    def sum(self) -> tuple:
        return self._chain(("+", "-", "~"), self.product)

    def product(self) -> tuple:
        return self._chain(("*", "//", "%"), self.filtered)

    def filtered(self) -> tuple:
        value = self.primary()
        while True:
            if self.take("."):
                value = ("get", value, ("const", self.name()))
            elif self.take("["):
                value = ("get", value, self.expression())
                self.need("]")
            elif self.take("|"):
                name, arguments = self.name(), []
                if self.take("("):
                    arguments = self.listed(")")
                value = ("filter", name, value, arguments)
            else:
                return value

    def listed(self, end: str) -> list[tuple]:
        items = []
        while not self.take(end):
            items.append(self.expression())
            if not self.take(","):
                self.need(end)
                break
        return items

    def primary(self) -> tuple:
        kind, value = self.kind, self.value
        if kind == "text":
            self.step()
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            self.step()
            return ("const", int(value))
        if kind == "name" and value.lower() in ("true", "false", "none"):
            self.step()
            return ("const", {"true": True, "false": False, "none": None}[value.lower()])
        if self.take("-"):
            return ("calc", "-", ("const", 0), self.filtered())
        if self.take("("):
            inner = self.expression()
            self.need(")")
            return inner
        if self.take("["):
            return ("list", self.listed("]"))
        return ("name", self.name())


def parse(source: str) -> list[tuple]:
    return Parser(source).body()[0]


def _calc(sign: str, a: Any, b: Any) -> Any:
    if sign == "~":
        return _text(a) + _text(b)
    if sign == "+" and isinstance(a, str) and isinstance(b, str):
        return a + b
    if any(isinstance(v, bool) or not isinstance(v, int) for v in (a, b)):
        raise TemplateError(f"{sign} needs numbers")
    try:
        return ARITHMETIC[sign](a, b)
    except ZeroDivisionError as e:
        raise TemplateError("division by zero") from e


def _get(holder: Any, key: Any) -> Any:
    if isinstance(holder, Mapping):
        return holder.get(key, MISSING) if isinstance(key, (str, int)) else MISSING
    if isinstance(holder, (list, str)) and isinstance(key, int) and -len(holder) <= key < len(holder):
        return holder[key]
    return MISSING


def _compare(sign: str, a: Any, b: Any) -> bool:
    try:
        return COMPARE[sign](a, b)
    except TypeError as e:
        raise TemplateError(f"{sign} needs values of one kind") from e


def _within(a: Any, b: Any) -> bool:
    try:
        return a in b
    except TypeError as e:
        raise TemplateError("in needs text, a list or a mapping") from e


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The node with its constant parts computed; lists of statements lose what can never run."""
    if isinstance(node, list):
        return _fold_body([fold(n, filters) for n in node])
    if not isinstance(node, tuple) or node[0] in ("const", "text", "name"):
        return node
    kind = node[0]
    parts = tuple(fold(p, filters) if isinstance(p, (tuple, list)) else p for p in node[1:])
    node = (kind, *parts)
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[0] if bool(parts[0][1]) == (kind == "or") else parts[1]
    if kind == "choose" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("not", "in", "compare", "calc", "is", "filter", "get", "list"):
        inner = [q for p in parts for q in (p if isinstance(p, list) else [p]) if isinstance(q, tuple)]
        if all(q[0] == "const" for q in inner):
            return ("const", _value(node, filters)({}))
    return node


def _fold_body(body: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in body:
        if node[0] == "write" and node[1][0] == "const":
            node = ("text", _text(node[1][1]))
        if node[0] == "if" and node[1][0] == "const":
            more = node[2] if node[1][1] else node[3]
        elif node[0] == "generation" and not node[1]:
            more = []
        else:
            more = [node]
        for n in more:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


def _value(node: tuple, filters: Mapping[str, Callable]) -> Callable[[Mapping], Any]:
    """The closure of an expression: names to value."""
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda names: constant
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name, MISSING)
    if kind == "list":
        items = [_value(n, filters) for n in node[1]]
        return lambda names: [i(names) for i in items]
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]}")
        apply, base, arguments = filters[node[1]], _value(node[2], filters), [_value(n, filters) for n in node[3]]

        def filtered(names: Mapping) -> Any:
            try:
                return apply(base(names), *[a(names) for a in arguments])
            except (TypeError, AttributeError) as e:
                raise TemplateError(f"filter {node[1]} cannot take these values") from e

        return filtered
    if kind == "is":
        inner = _value(node[2], filters)
        return (lambda names: inner(names) is not MISSING) if node[1] == "defined" else (lambda names: inner(names) is None)
    if kind in ("compare", "calc"):
        sign, a, b = node[1], _value(node[2], filters), _value(node[3], filters)
        act = _compare if kind == "compare" else _calc
        return lambda names: act(sign, a(names), b(names))
    values = [_value(n, filters) for n in node[1:]]
    first, second = values[0], values[-1]
    if kind == "not":
        return lambda names: not _true(first(names))
    if kind == "and":
        return lambda names: second(names) if _true(v := first(names)) else v
    if kind == "or":
        return lambda names: v if _true(v := first(names)) else second(names)
    if kind == "in":
        return lambda names: _within(first(names), second(names))
    if kind == "get":
        return lambda names: _get(first(names), second(names))
    chosen = values[1]
    return lambda names: chosen(names) if _true(first(names)) else second(names)


def _true(value: Any) -> bool:
    return value is not MISSING and bool(value)


Render = Callable[[dict], Iterator]


def _loop(name: str, items: Callable, inner: Render) -> Render:
    def run(names: dict) -> Iterator:
        source = items(names)
        if isinstance(source, (str, Mapping)) or not isinstance(source, Iterable):
            raise TemplateError("for runs over lists and messages")
        ahead, at = iter(source), 0
        item = next(ahead, MISSING)
        while item is not MISSING:
            following = next(ahead, MISSING)
            loop = {"index0": at, "index": at + 1, "first": at == 0, "last": following is MISSING}
            yield from inner({**names, name: item, "loop": loop})
            item, at = following, at + 1

    return run


def _statements(body: list[tuple], filters: Mapping[str, Callable]) -> Render:
    """The closure of a list of statements: names to pieces. ``set`` holds to the end of the list."""
    steps = [_statement(n, filters) for n in body]

    def run(names: dict) -> Iterator:
        names = dict(names)
        for step in steps:
            yield from step(names)

    return run


def _statement(node: tuple, filters: Mapping[str, Callable]) -> Render:
    kind = node[0]
    if kind == "text":
        piece = (node[1],)
        return lambda names: piece
    if kind == "write":
        value = _value(node[1], filters)
        return lambda names: (_text(value(names)),)
    if kind == "set":
        name, value = node[1], _value(node[2], filters)

        def put(names: dict) -> tuple:
            names[name] = value(names)
            return ()

        return put
    if kind == "for":
        return _loop(node[1], _value(node[2], filters), _statements(node[3], filters))
    if kind == "generation":
        inner = _statements(node[1], filters)

        def marked(names: dict) -> Iterator:
            yield BEGIN
            yield from inner(names)
            yield END

        return marked
    condition, yes, no = _value(node[1], filters), _branch(node[2], filters), _branch(node[3], filters)
    return lambda names: (yes if _true(condition(names)) else no)(names)


def _branch(body: list[tuple], filters: Mapping[str, Callable]) -> Render:
    """A branch shares the names of the list it stands in."""
    steps = [_statement(n, filters) for n in body]

    def run(names: dict) -> Iterator:
        for step in steps:
            yield from step(names)

    return run


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Render:
    """A function from names to a generator of pieces and markers; further ``filters`` are pure functions of values."""
    known = {**FILTERS, **(filters or {})}
    return _statements(fold(parse(source), known), known)
