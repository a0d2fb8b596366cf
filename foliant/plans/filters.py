"""Filters of a search besides keywords: case number, dates, shards, excluded terms."""

from __future__ import annotations

import datetime
import re
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond so many excluded terms, each text is read once for all of them.
MANY_TERMS = 16
_TERM = re.compile(r'"[^"]*"|\S+')


def number_filter(part: str | None, column: Column) -> Column | None:
    """Case numbers that hold ``part``, whatever the case of letters; % and _ stand for any signs."""
    if not part or not part.strip():
        return None
    return F.ilike(column, F.lit("%" + part.replace("\\", "\\\\") + "%"))


def parse_date(text: str | datetime.date | None) -> datetime.date | None:
    """A date bound: yyyy-mm-dd, or nothing if blank."""
    if text is None or isinstance(text, datetime.date):
        return text
    if not text.strip():
        return None
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()):
        raise ValueError(f"not a yyyy-mm-dd date: {text!r}")
    return datetime.date.fromisoformat(text.strip())


def date_filters(start: str | datetime.date | None, end: str | datetime.date | None, column: Column) -> list[Column]:
    low, high = parse_date(start), parse_date(end)
    return [c for c in ((column >= F.lit(low)) if low else None, (column <= F.lit(high)) if high else None) if c is not None]


def shard_overlaps(start: str | datetime.date | None, end: str | datetime.date | None, first: Column, last: Column) -> Column:
    """Shards whose dates meet the bounds; with a bound, shards without dates don't."""
    low, high = parse_date(start), parse_date(end)
    tests = [c for c in ((last >= F.lit(low)) if low else None, (first <= F.lit(high)) if high else None) if c is not None]
    return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(True)


def exclusion_terms(text: str | None) -> list[str]:
    """Terms in lower case: quoted ones without their quotes, else what stands between spaces.

    An empty pair of quotes is the empty term, which every text holds.
    """
    terms = _TERM.findall(text or "")
    return [(t[1:-1] if len(t) > 1 and t[0] == t[-1] == '"' else t).lower() for t in terms]


def holds_term(terms: list[str], text: Column) -> Column:
    """Whether a text holds any of many terms: one automaton passes over it once, however many there are."""
    known = sorted(set(terms))

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        import ahocorasick

        if "" in known:
            return texts.notna()
        machine = ahocorasick.Automaton()
        for term in known:
            machine.add_word(term, True)
        machine.make_automaton()
        return texts.map(lambda t: t is not None and next(machine.iter(t), None) is not None)

    return holds(text)


def holds_excluded(text: str | None, content: Column) -> Column | None:
    """Whether a content holds any excluded term, as a part of words too; None without terms.

    More than ``MANY_TERMS`` are looked for together, with the same answer.
    """
    terms = exclusion_terms(text)
    if not terms:
        return None
    if len(terms) > MANY_TERMS:
        return F.coalesce(holds_term(terms, F.lower(content)), F.lit(False))
    return F.coalesce(reduce(or_, [F.contains(F.lower(content), F.lit(t)) for t in terms]), F.lit(False))


def all_of(tests: list[Column]) -> Column:
    return reduce(and_, tests, F.lit(True))
