"""The keyword language: words, prefixes, phrases, NEAR, AND, OR, NOT and parentheses, compiled to a filter.

A query becomes a tree of phrases, and the tree one boolean Column over normalized text (``functions.text.normalized``),
which the optimizer can push and fold like any other. Adjacent phrases mean AND and bind first, then NOT, AND, OR; a
parenthesis must stand between operators. What the language has no meaning for raises ``QuerySyntaxError``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold_literal

#: What changes on the way from a user's words to the language: operators that stand alone, two signs, spaces; not what is quoted.
_REWRITTEN = re.compile(r'(?P<quoted>"[^"]*")|(?P<operator>(?<!\S)(?:and|or|not)(?!\S))|(?P<sign>[\\^])|(?P<space>\s+)', re.I)
_LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*")|([0-9A-Za-z_\x1a\x80-\U0010ffff]+)|([()*+:,{}]))')
_TOKENS = re.compile(r"[^\W_]+")


class QuerySyntaxError(ValueError):
    """A keyword query outside of the language."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; with ``prefix`` the last one may go on."""

    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


@dataclass(frozen=True)
class Nothing:
    """A phrase without tokens: it matches no row, and is skipped among adjacent phrases."""


def sanitize(query: str) -> str:
    """Operators in upper case; backslashes and carets outside of quotes escaped; parts apart by one space."""

    def rewritten(found: re.Match) -> str:
        kind, text = found.lastgroup, found[0]
        return {"quoted": text, "operator": text.upper(), "sign": "\\" + text, "space": " "}[kind]

    return _REWRITTEN.sub(rewritten, query).strip()


def _lexemes(query: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(query.rstrip())
    while at < end:
        m = _LEXEME.match(query, at)
        if not m:
            raise QuerySyntaxError(f"no meaning for {query[at:].strip()[:20]!r}")
        text, word, sign = m.groups()
        if text is not None:
            out.append(("text", text[1:-1].replace('""', '"')))
        elif word is not None:
            out.append(("operator" if word in ("AND", "OR", "NOT") else "word", word))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Parser:
    """Precedence climbing over the lexemes."""

    POWER = {"OR": 1, "AND": 2, "NOT": 3}
    NODE = {"OR": Either, "AND": Both, "NOT": Without}

    def __init__(self, query: str, column: str):
        self.lexemes, self.at, self.column = _lexemes(query), 0, column

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.lexemes[k] if k < len(self.lexemes) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.peek(-1)

    def expect(self, sign: str) -> None:
        if self.next() != ("sign", sign):
            raise QuerySyntaxError(f"expected {sign!r}")

    def query(self) -> object:
        out = self.expression(0)
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return out

    def expression(self, least: int) -> object:
        left = self.operand()
        while self.peek()[0] == "operator" and self.POWER[self.peek()[1]] > least:
            word = self.next()[1]
            left = self.NODE[word](left, self.expression(self.POWER[word]))
        return left

    def restriction(self) -> None:
        """A column filter before a phrase or parenthesis; the text column is the only one."""
        if self.peek()[0] in ("word", "text") and self.peek(1) == ("sign", ":"):
            names = [self.next()[1]]
        elif self.peek() == ("sign", "{"):
            self.next()
            names = []
            while self.peek()[0] in ("word", "text"):
                names.append(self.next()[1])
            self.expect("}")
            if not names:
                raise QuerySyntaxError("no column named")
        else:
            return
        self.expect(":")
        if any(n.lower() != self.column for n in names):
            raise QuerySyntaxError(f"no such column: {names}")

    def operand(self) -> object:
        self.restriction()
        if self.peek() == ("sign", "("):
            self.next()
            out = self.expression(0)
            self.expect(")")
            if self.peek()[0] in ("word", "text") or self.peek()[1] in ("(", "{"):
                raise QuerySyntaxError("an operator must follow a parenthesis")
            return out
        out = self.nearset()
        while self.peek()[0] in ("word", "text") or self.peek() == ("sign", "{"):
            self.restriction()
            if self.peek() == ("sign", "("):
                raise QuerySyntaxError("an operator must stand before a parenthesis")
            right = self.nearset()
            out = right if isinstance(out, Nothing) else out if isinstance(right, Nothing) else Both(out, right)
        if self.peek()[1] == "(" and self.peek()[0] == "sign":
            raise QuerySyntaxError("an operator must stand before a parenthesis")
        return out

    def nearset(self) -> object:
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.at += 2
            phrases, distance = [self.phrase()], 10
            while self.peek()[0] in ("word", "text"):
                phrases.append(self.phrase())
            if self.peek() == ("sign", ","):
                self.next()
                kind, number = self.next()
                if kind != "word" or not number.isascii() or not number.isdigit():
                    raise QuerySyntaxError("the distance of NEAR must be a number")
                distance = int(number)
            self.expect(")")
            kept = tuple(p for p in phrases if p.tokens)
            if not kept:
                return Nothing()
            return kept[0] if len(kept) == 1 else Near(kept, distance)
        out = self.phrase()
        return out if out.tokens else Nothing()

    def phrase(self) -> Phrase:
        tokens: tuple[str, ...] = ()
        while True:
            kind, text = self.next()
            if kind not in ("word", "text"):
                raise QuerySyntaxError(f"expected a word, not {text!r}" if text else "the query ends too early")
            tokens += tuple(_TOKENS.findall(fold_literal(text)))
            prefix = self.peek() == ("sign", "*")
            if prefix:
                self.next()
            if self.peek() != ("sign", "+"):
                return Phrase(tokens, prefix and bool(tokens))
            self.next()


def parse(query: str, column: str = "content") -> object:
    """The tree of a (sanitized) query."""
    if "\\" in query or "^" in re.sub(r'"[^"]*"', "", query):
        raise QuerySyntaxError("carets and backslashes have no meaning outside of quotes")
    return _Parser(query, column).query()


def _contains(phrase: Phrase, norm: Column) -> Column:
    return F.contains(norm, F.lit(" " + " ".join(phrase.tokens) + ("" if phrase.prefix else " ")))


def _positions(phrase: Phrase, tokens: Column) -> Column:
    """Where a phrase begins, counted in tokens."""
    n = len(phrase.tokens)

    def starts(i: Column) -> Column:
        tests = [F.get(tokens, i + k) == t for k, t in enumerate(phrase.tokens)]
        if phrase.prefix:
            tests[-1] = F.startswith(F.get(tokens, i + n - 1), F.lit(phrase.tokens[-1]))
        return reduce(and_, tests)

    return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - n)), lambda i: F.coalesce(starts(i), F.lit(False)))


def _near(node: Near, norm: Column) -> Column:
    """All phrases begin at or before the last of them, each ending at most ``distance`` tokens before it.

    Arrays of one element give tokens and positions a name, so that each is made once per row; rows without all
    phrases are ruled out before.
    """
    names, sizes = [f"p{i}" for i in range(len(node.phrases))], [len(p.tokens) for p in node.phrases]

    def before(x: Column, places: Column, n: int) -> Column:
        return F.exists(places, lambda y: (y <= x) & (x - y - n <= node.distance))

    def last(s: Column, j: int) -> Column:
        return F.exists(s[names[j]], lambda x: reduce(and_, [before(x, s[name], n) for i, (name, n) in enumerate(zip(names, sizes)) if i != j]))

    def close(s: Column) -> Column:
        return reduce(or_, [last(s, j) for j in range(len(names))])

    def placed(tokens: Column) -> Column:
        return F.exists(F.array(F.struct(*[_positions(p, tokens).alias(name) for p, name in zip(node.phrases, names)])), close)

    return F.when(reduce(and_, [_contains(p, norm) for p in node.phrases]), F.exists(F.array(F.split(F.trim(norm), " ")), placed)).otherwise(F.lit(False))


def compile_filter(node: object, norm: Column) -> Column:
    """A boolean Column over normalized text."""
    if isinstance(node, Phrase):
        return _contains(node, norm)
    if isinstance(node, Near):
        return _near(node, norm)
    if isinstance(node, Nothing):
        return F.lit(False)
    left, right = compile_filter(node.left, norm), compile_filter(node.right, norm)
    return left & right if isinstance(node, Both) else left | right if isinstance(node, Either) else left & ~right


def keyword_filter(query: str, norm: Column) -> Column:
    """Sanitize, parse and compile a user's query; a blank one keeps everything.

    Where the query looks at the text more than once, an array of one element gives the normalized text a name, so
    that it is made once per row and not once per phrase.
    """
    if not query or not query.strip():
        return F.lit(True)
    tree = parse(sanitize(query))
    return compile_filter(tree, norm) if looks(tree) < 2 else F.coalesce(F.exists(F.array(norm), lambda n: compile_filter(tree, n)), F.lit(False))


def looks(node: object) -> int:
    """How often a compiled tree reads its text."""
    if isinstance(node, (Phrase, Nothing)):
        return int(isinstance(node, Phrase))
    return len(node.phrases) + 1 if isinstance(node, Near) else looks(node.left) + looks(node.right)


def required_terms(node: object) -> list[set[str]] | None:
    """For lookups in postings: a set of whole tokens per alternative, all of which each match holds; None if an
    alternative has no whole token."""
    if isinstance(node, Phrase):
        whole = set(node.tokens[:-1] if node.prefix else node.tokens)
        return [whole] if whole else None
    if isinstance(node, Near):
        whole = {t for p in node.phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)}
        return [whole] if whole else None
    if isinstance(node, Nothing):
        return []
    if isinstance(node, Without):
        return required_terms(node.left)
    left, right = required_terms(node.left), required_terms(node.right)
    if isinstance(node, Either):
        return None if left is None or right is None else left + right
    if left is None or right is None:
        return right if left is None else left
    return [a | b for a in left for b in right]
