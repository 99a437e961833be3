"""A sandboxed template language: parsed to a syntax tree, folded, and compiled to Python closures.

    {{ expression }}    {# comment #}    a dash inside a tag ({%- -%}, {{- -}}) strips white space beside it
    {% for x in e %} ... {% endfor %}          loop.index, loop.first and loop.last inside
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set x = e %}     {% generation %} ... {% endgeneration %}   (what a model is trained on)

Expressions: strings, integers, true, false, none, names, e.key, e[e], == != < <= > >=, in, not, and, or, + and ~
(joins texts), parentheses, and filters `e | name(arguments)` out of FILTERS or those given. A name or key that is
missing gives none, and none prints as an empty text. Keys are looked up in mappings and sequences only: Python
attributes can't be reached, nothing can be called but filters, and loops run over given values only.

compile_template() returns a function (variables, emit): emit(text, trained) is called for every piece in order, so
that a loop over an iterator renders without holding what it has rendered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

Emit = Callable[[str, bool], None]
Render = Callable[[Mapping, Emit], None]


class TemplateError(ValueError):
    pass


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} can't be printed")


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: 0 if x is None else len(x),
    "default": lambda x, y="": y if x is None else x,
    "replace": lambda x, a, b: _text(x).replace(a, b),
}

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>+~|.,()\[\]=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"and", "or", "not", "in", "true", "false", "none", "True", "False", "None"}


def _tokens(source: str) -> list[tuple[str, str]]:
    found, at, source = [], 0, source.rstrip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        kind = m.lastgroup
        value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[0]), m["text"][1:-1]) if kind == "text" else m[kind]
        found.append(("word" if kind == "name" and value in _WORDS else kind, value))
        at = m.end()
    return found


class _Expression:
    """Recursive descent over one tag's tokens; nodes are tuples, ("const", value) among them."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("mark", "word") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.either()
        self.end()
        return node

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = ("compare", op, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while op := self.take("+", "~"):
            node = ("join", op, node, self.filtered())
        return node

    def filtered(self):
        node = self.reached()
        while self.take("|"):
            name, args = self.name(), []
            if self.take("(") and not self.take(")"):
                args.append(self.either())
                while self.take(","):
                    args.append(self.either())
                self.need(")")
            node = ("filter", name, node, tuple(args))
        return node

    def reached(self):
        node = self.single()
        while op := self.take(".", "["):
            if op == ".":
                node = ("get", node, ("const", self.name()))
            else:
                node = ("get", node, self.either())
                self.need("]")
        return node

    def single(self):
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if word := self.take("true", "True", "false", "False", "none", "None"):
            return ("const", {"true": True, "false": False, "none": None}[word.lower()])
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        if kind not in ("text", "number", "name"):
            raise TemplateError(f"{value!r} isn't expected")
        self.at += 1
        return ("name", value) if kind == "name" else ("const", int(value) if kind == "number" else value)


def parse(source: str) -> tuple:
    """The syntax tree: ("block", nodes)."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        before, after = (m[1] or m[4]), (m[3] or m[6])
        parts.append(("text", text.rstrip() if before else text))
        if m[2] is not None:
            parts.append(("print", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(after)
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    spot = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal spot
        nodes = []
        while spot < len(parts):
            kind, value = parts[spot]
            spot += 1
            if kind == "text":
                nodes.append(("text", value))
            elif kind == "print":
                nodes.append(("print", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return ("block", tuple(nodes)), value
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", tuple(nodes)), ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            return ("for", name, e.whole(), block("endfor")[0])
        if word == "if":
            test = _Expression(rest).whole()
            body, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                return ("if", test, body, ("block", (statement("if", end[4:]),)))
            return ("if", test, body, block("endif")[0] if end == "else" else ("block", ()))
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            return ("set", name, e.whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"{word!r} isn't a statement")

    return block()[0]


def _get(value, key):
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, Sequence) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _join(op: str, a, b):
    return a + b if op == "+" and all(isinstance(x, int) for x in (a, b)) else _text(a) + _text(b)


_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: b is not None and a in b,
}


def fold(node: tuple, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The tree with constant parts worked out, and texts that touch joined."""
    kind = node[0]
    if kind in ("text", "const", "name"):
        return node
    if kind == "block":
        nodes: list[tuple] = []
        for x in (fold(x, filters) for x in node[1]):
            for y in x[1] if x[0] == "block" else (x,):
                if y[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + y[1])
                elif y != ("text", ""):
                    nodes.append(y)
        return ("block", tuple(nodes))
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "filter":
        made = ("filter", node[1], fold(node[2], filters), tuple(fold(x, filters) for x in node[3]))
        inner = (made[2], *made[3])
    else:
        made = tuple(fold(x, filters) if isinstance(x, tuple) else x for x in node)
        inner = tuple(x for x in made[1:] if isinstance(x, tuple))
    if kind == "if":
        return (made[2] if made[1][1] else made[3]) if made[1][0] == "const" else made
    if kind == "print":
        return ("text", _text(made[1][1])) if made[1][0] == "const" else made
    if kind in ("set", "generation") or any(x[0] != "const" for x in inner):
        return made
    return ("const", _value(made, filters)({}))


def _value(node: tuple, filters: Mapping[str, Callable]) -> Callable[[Mapping], object]:
    """The closure that works out an expression."""
    kind = node[0]
    if kind == "const":
        return lambda _, x=node[1]: x
    if kind == "name":
        return lambda scope, name=node[1]: scope.get(name)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"there is no filter {node[1]!r}")
        call, of, args = filters[node[1]], _value(node[2], filters), [_value(x, filters) for x in node[3]]
        return lambda scope: call(of(scope), *(x(scope) for x in args))
    if kind == "compare":
        call, a, b = _COMPARE[node[1]], _value(node[2], filters), _value(node[3], filters)
        return lambda scope: call(a(scope), b(scope))
    if kind == "join":
        op, a, b = node[1], _value(node[2], filters), _value(node[3], filters)
        return lambda scope: _join(op, a(scope), b(scope))
    a = _value(node[1], filters)
    if kind == "not":
        return lambda scope: not a(scope)
    b = _value(node[2], filters)
    if kind == "get":
        return lambda scope: _get(a(scope), b(scope))
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    return lambda scope: a(scope) or b(scope)


def _looked_ahead(values: Iterable):
    """(value, whether it is the last)."""
    values = iter(values)
    for value in values:
        for following in values:
            yield value, False
            value = following
        yield value, True


def _statement(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Emit, bool], None]:
    """The closure that renders a statement; its last argument says if generation markers enclose it."""
    kind = node[0]
    if kind == "block":
        parts = [_statement(x, filters) for x in node[1]]

        def block(scope, emit, trained):
            for part in parts:
                part(scope, emit, trained)

        return block
    if kind == "text":
        return lambda scope, emit, trained, text=node[1]: emit(text, trained)
    if kind == "print":
        shown = _value(node[1], filters)
        return lambda scope, emit, trained: emit(_text(shown(scope)), trained)
    if kind == "generation":
        body = _statement(node[1], filters)
        return lambda scope, emit, trained: body(scope, emit, True)
    if kind == "set":
        name, value = node[1], _value(node[2], filters)
        return lambda scope, emit, trained: scope.__setitem__(name, value(scope))
    if kind == "if":
        test, then, other = _value(node[1], filters), _statement(node[2], filters), _statement(node[3], filters)
        return lambda scope, emit, trained: (then if test(scope) else other)(scope, emit, trained)
    name, values, body = node[1], _value(node[2], filters), _statement(node[3], filters)

    def loop(scope, emit, trained):
        for i, (value, last) in enumerate(_looked_ahead(values(scope) or ())):
            inner = scope | {name: value, "loop": {"index": i + 1, "first": i == 0, "last": last}}
            body(inner, emit, trained)

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Render:
    known = FILTERS | dict(filters or {})
    run = _statement(fold(parse(source), known), known)
    return lambda variables, emit: run(dict(variables), emit, False)
