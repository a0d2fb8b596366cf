"""Substring searches through trigrams of dictionaries: of case numbers, and of the tokens of contents.

A part of a number or of a word is looked for among distinct values, not rows: the trigrams that it must have choose values from a
sorted table, the whole condition is tested on those, and the values' rows are found by the postings or the number. Contents of candidate rows
are then tested as a scan would test all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_literal
from ..plans.filters import exclusion_terms, holds_excluded, number_filter
from .index import KEY, met

_PIECE = re.compile(r"[^\W_]+")


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(...))"), F.lit(1)))


def write_grams(values: DataFrame, column: str, path: str) -> None:
    """(gram, value) of all distinct values, sorted; values with null are left out."""
    each = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    pairs = each.select(F.explode(grams(F.col("value"))).alias("gram"), "value")
    pairs.repartitionByRange("gram", "value").sortWithinPartitions("gram", "value").write.mode("overwrite").option("compression", "zstd").parquet(path)


def needed_grams(parts: list[str]) -> list[str]:
    """Trigrams that a value holds if it holds all parts."""
    return sorted({p.lower()[i : i + 3] for p in parts for i in range(len(p.lower()) - 2)})


def with_parts(table: DataFrame, parts: list[str]) -> DataFrame | None:
    """(value) of the values in a table of trigrams that have all trigrams of the parts; None if the parts have none.

    What a file's statistics rule out isn't read, and each value meets its few trigrams in partial sums.
    """
    needed = needed_grams(parts)
    if not needed:
        return None
    return table.where(F.col("gram").isin(needed)).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") == len(needed)).select("value")


def literal_parts(pattern: str) -> list[str]:
    """What stands between the wildcards % and _ of a number pattern."""
    return [p for p in re.split(r"[%_]", pattern) if p]


def with_number(paragraphs: DataFrame, table: DataFrame, pattern: str | None) -> DataFrame:
    """Rows whose case number holds ``pattern`` (``number_filter``), by a table of trigrams of the numbers.

    A pattern without three signs in a row is tested on all rows.
    """
    test = number_filter(pattern, F.col("process_number"))
    if test is None:
        return paragraphs
    found = with_parts(table, literal_parts(pattern))
    if found is None:
        return paragraphs.where(test)
    numbers = found.withColumnRenamed("value", "process_number").where(test)
    return met(paragraphs, numbers, ("process_number",))


def holding(paragraphs: DataFrame, index: DataFrame, table: DataFrame, term: str) -> DataFrame:
    """(db_id, id) of rows that may hold a term: for each of its words, a token of the row holds that word as a part.

    ``table`` has the trigrams of the index's tokens. A word that is too short for trigrams asks for nothing; without any
    other word, all rows are candidates.
    """
    out = None
    for piece in sorted(set(_PIECE.findall(fold_literal(term))), key=len, reverse=True):
        tokens = with_parts(table, [piece])
        if tokens is not None:
            tokens = tokens.where(F.contains(F.col("value"), F.lit(piece))).withColumnRenamed("value", "token")
            rows = met(index, tokens, ("token",)).select(*KEY)
            out = rows if out is None else met(out, rows)
    return paragraphs.select(*KEY) if out is None else out.distinct()


def without_excluded(found: DataFrame, paragraphs: DataFrame, index: DataFrame, table: DataFrame, exclusion: str | None) -> DataFrame:
    """``search.without_excluded`` that reads only the contents of rows which the index can't rule out.

    ``found`` needs no contents: keys and case numbers of matched rows; ``paragraphs`` has them.
    """
    terms = exclusion_terms(exclusion)
    if not terms:
        return found
    keys = None
    for term in terms:
        some = holding(found, index, table, term)
        keys = some if keys is None else keys.unionAll(some)
    suspects = met(found.select(*KEY, "process_number"), keys)
    contents = paragraphs.select(*KEY, "content")
    bad = met(contents, suspects).where(holds_excluded(exclusion, F.col("content"))).select(*KEY)
    cases = met(suspects, bad).select("process_number").distinct()
    return met(found, cases, ("process_number",), "left_anti")
