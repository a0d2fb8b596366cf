"""A sandboxed template language for conversations, compiled to Python closures.

Text outside of tags is copied. ``{{ expression }}`` prints a value; ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in y %} {% endfor %}``, ``{% set x = y %}`` and ``{% generation %} {% endgeneration %}`` control it; the last
marks what is printed inside as text to be learned. ``{%-`` and ``-%}`` (and ``{{-``, ``-}}``) eat the white space
beside them. Expressions have strings, numbers, true, false, none, names, fields of mappings (``x.y`` or ``x['y']``),
``+ == != < <= > >= in not and or``, parentheses, and filters: ``x | escape``, ``trim``, ``upper``, ``lower``, ``length``,
``default('x')``. There are no calls, no attributes of Python objects, no imports and no loops over anything but
given lists, so a template ends after a number of steps set by the data and reaches nothing but its variables.

Constant parts are folded while compiling: expressions of literals, branches of constant conditions, neighbouring text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

_TAG = re.compile(r"(\{\{-?|\{%-?)\s*(.*?)\s*(-?\}\}|-?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>()\[\].|,=]))""")


class TemplateError(ValueError):
    """A template that the language has no meaning for."""


class Output:
    """Printed text and the spans of it that are to be learned."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)

    def clear(self) -> None:
        self.parts, self.size, self.spans = [], 0, []


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    what: str
    args: tuple


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Choose:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Repeat:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else _text(a) + _text(b)


def _field(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


OPERATORS: dict[str, Callable[..., Any]] = {
    "+": _plus, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}
FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x or ""), "default": lambda x, y="": y if x is None else x,
}


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unknown sign at {source[at:].strip()[:20]!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.tokens.append(("value", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text[1:-1])))
            elif number is not None:
                self.tokens.append(("value", float(number) if "." in number else int(number)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *what: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "value" and self.tokens[self.at][1] in what

    def take(self, *what: str) -> Any:
        if self.at >= len(self.tokens) or what and not self.peek(*what):
            raise TemplateError(f"expected {' or '.join(what) or 'a value'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def name(self) -> str:
        kind, value = self.take()
        if kind != "name":
            raise TemplateError("expected a name")
        return value

    def all(self) -> Any:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.peek("or"):
            self.take()
            out = Apply("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.peek("and"):
            self.take()
            out = Apply("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        if self.peek("not"):
            self.take()
            return Apply("not", (self.negated(),))
        out = self.sum()
        if self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
            return Apply(self.take()[1], (out, self.sum()))
        return out

    def sum(self) -> Any:
        out = self.filtered()
        while self.peek("+"):
            self.take()
            out = Apply("+", (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.simple()
        while self.peek("|"):
            self.take()
            name, args = self.name(), [out]
            if self.peek("("):
                self.take()
                args.append(self.either())
                self.take(")")
            out = Apply("|" + name, tuple(args))
        return out

    def simple(self) -> Any:
        kind, value = self.take()
        if kind == "value":
            out: Any = Literal(value)
        elif kind == "sign":
            if value != "(":
                raise TemplateError(f"unexpected {value!r}")
            out = self.either()
            self.take(")")
        else:
            out = Literal({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        while self.peek(".", "["):
            if self.take()[1] == ".":
                out = Field(out, Literal(self.name()))
            else:
                out = Field(out, self.either())
                self.take("]")
        return out


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    stack: list[tuple[str, list, list]] = [("", [], [])]  # opening word, its data, nodes so far
    at, eat = 0, False

    def put(node: Any) -> None:
        stack[-1][2].append(node)

    def close(word: str) -> None:
        if stack[-1][0] not in {"endif": ("if", "else"), "endfor": ("for",), "endgeneration": ("generation",)}[word]:
            raise TemplateError(f"{word} closes nothing")
        if word == "endfor":
            _, (name, over), body = stack.pop()
            put(Repeat(name, over, tuple(body)))
        elif word == "endgeneration":
            _, _, body = stack.pop()
            put(Generation(tuple(body)))
        else:
            other: tuple = ()
            if stack[-1][0] == "else":
                other = tuple(stack.pop()[2])
            while True:
                _, (test, chained), body = stack.pop()
                node = Choose(test, tuple(body), other)
                if not chained:
                    put(node)
                    return
                other = (node,)

    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if eat else text
        text = text.rstrip() if m[1].endswith("-") else text
        if text:
            put(Print(Literal(text)))
        at, eat = m.end(), m[3].startswith("-")
        if m[1].startswith("{{") != m[3].endswith("}}"):
            raise TemplateError(f"a tag ends unlike it began: {m[0]!r}")
        if m[1].startswith("{{"):
            put(Print(_Expression(m[2]).all()))
            continue
        word, _, rest = m[2].partition(" ")
        if word == "if":
            stack.append(("if", [_Expression(rest).all(), False], []))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"{word} outside of if")
            stack.append(("if", [_Expression(rest).all(), True], []) if word == "elif" else ("else", [], []))
        elif word == "for":
            e = _Expression(rest)
            name = e.name()
            e.take("in")
            stack.append(("for", [name, e.all()], []))
        elif word == "generation":
            if any(x[0] == "generation" for x in stack):
                raise TemplateError("generation inside of generation")
            stack.append(("generation", [], []))
        elif word == "set":
            e = _Expression(rest)
            name = e.name()
            e.take("=")
            put(Assign(name, e.all()))
        elif word in ("endif", "endfor", "endgeneration") and not rest:
            close(word)
        else:
            raise TemplateError(f"unknown tag {word!r}")
    text = source[at:].lstrip() if eat else source[at:]
    if text:
        put(Print(Literal(text)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return tuple(stack[0][2])


def fold(node: Any, filters: Mapping[str, Callable[..., Any]]) -> Any:
    """The tree with constant parts worked out."""
    again = lambda x: fold(x, filters)
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in map(again, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Print) and isinstance(y.value, Literal):
                    y = Print(Literal(_text(y.value.value)))
                    if out and isinstance(out[-1], Print) and isinstance(out[-1].value, Literal):
                        y = Print(Literal(out.pop().value.value + y.value.value))
                out.append(y)
        return tuple(out)
    if isinstance(node, Field):
        of, key = again(node.of), again(node.key)
        return Literal(_field(of.value, key.value)) if isinstance(of, Literal) and isinstance(key, Literal) else Field(of, key)
    if isinstance(node, Apply):
        args = tuple(map(again, node.args))
        if node.what[0] == "|" and node.what[1:] not in filters:
            raise TemplateError(f"unknown filter {node.what[1:]!r}")
        if all(isinstance(x, Literal) for x in args):
            try:
                return Literal((filters[node.what[1:]] if node.what[0] == "|" else OPERATORS[node.what])(*[x.value for x in args]))
            except TypeError:
                pass  # left to fail, or not to be reached, when rendering
        if node.what in ("and", "or") and isinstance(args[0], Literal):
            return args[1] if bool(args[0].value) == (node.what == "and") else args[0]
        return Apply(node.what, args)
    if isinstance(node, Print):
        return Print(again(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, again(node.value))
    if isinstance(node, Choose):
        test, then, other = again(node.test), again(node.then), again(node.other)
        return (then if test.value else other) if isinstance(test, Literal) else Choose(test, then, other)
    if isinstance(node, Repeat):
        return Repeat(node.name, again(node.over), again(node.body))
    if isinstance(node, Generation):
        return Generation(again(node.body))
    return node


def _value(node: Any, filters: Mapping[str, Callable[..., Any]]) -> Callable[[dict], Any]:
    if isinstance(node, Literal):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Field):
        of = _value(node.of, filters)
        if isinstance(node.key, Literal):
            fixed = node.key.value
            return lambda scope: _field(of(scope), fixed)
        key = _value(node.key, filters)
        return lambda scope: _field(of(scope), key(scope))
    args = [_value(x, filters) for x in node.args]
    if node.what in ("and", "or"):
        a, b = args
        return (lambda scope: a(scope) and b(scope)) if node.what == "and" else (lambda scope: a(scope) or b(scope))
    call = filters[node.what[1:]] if node.what[0] == "|" else OPERATORS[node.what]
    if len(args) == 1:
        only = args[0]
        return lambda scope: call(only(scope))
    left, right = args
    return lambda scope: call(left(scope), right(scope))


def _block(nodes: tuple, filters: Mapping[str, Callable[..., Any]]) -> Callable[[dict, Output], None]:
    steps = [_step(x, filters) for x in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: Any, filters: Mapping[str, Callable[..., Any]]) -> Callable[[dict, Output], None]:
    if isinstance(node, Print):
        if isinstance(node.value, Literal):
            fixed = _text(node.value.value)
            return lambda scope, out: out.write(fixed)
        value = _value(node.value, filters)
        return lambda scope, out: out.write(_text(value(scope)))
    if isinstance(node, Assign):
        name, value = node.name, _value(node.value, filters)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if isinstance(node, Choose):
        test, then, other = _value(node.test, filters), _block(node.then, filters), _block(node.other, filters)
        return lambda scope, out: then(scope, out) if test(scope) else other(scope, out)
    body = _block(node.body, filters)
    if isinstance(node, Generation):

        def marked(scope: dict, out: Output) -> None:
            start = out.size
            body(scope, out)
            out.spans.append((start, out.size))

        return marked
    name, over = node.name, _value(node.over, filters)

    def loop(scope: dict, out: Output) -> None:
        outer = scope.get(name)
        for x in over(scope) or ():
            scope[name] = x
            body(scope, out)
        scope[name] = outer

    return loop


def compile_steps(source: str, filters: Mapping[str, Callable[..., Any]] | None = None) -> Callable[[dict, Output], Iterator[None]]:
    """A generator function that renders variables into an output step by step.

    It pauses after every outermost part of the template and every turn of an outermost loop, whose values may come from an
    iterator; so what has been rendered can be taken out of the output in between.
    """
    known = {**FILTERS, **(filters or {})}
    steps = []
    for node in fold(parse(source), known):
        if isinstance(node, Repeat):
            steps.append((node.name, _value(node.over, known), _block(node.body, known)))
        else:
            steps.append((None, None, _step(node, known)))

    def render(variables: dict, out: Output) -> Iterator[None]:
        scope = dict(variables)
        for name, over, run in steps:
            if over is None:
                run(scope, out)
                yield
                continue
            outer = scope.get(name)
            for x in over(scope) or ():
                scope[name] = x
                run(scope, out)
                yield
            scope[name] = outer

    return render


def compile_template(source: str, filters: Mapping[str, Callable[..., Any]] | None = None) -> Callable[[dict], Output]:
    """A function from variables to output; ``filters`` adds to the language's own."""
    known = {**FILTERS, **(filters or {})}
    run = _block(fold(parse(source), known), known)

    def render(variables: dict) -> Output:
        out = Output()
        run(dict(variables), out)
        return out

    return render
