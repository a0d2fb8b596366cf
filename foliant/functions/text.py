"""String functions on columns: folding, case numbers, currency, dates from file names, previews."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CASE_NUMBER

#: White space as Python's regular expressions see it, in Java's.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with one diacritic, and what is left without it (U+00C0 to U+024F)."""
    pairs = {}
    for code in range(0xC0, 0x250):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and len(chr(code).lower()) == 1 and len(parts[0]) == 4 and chr(int(parts[0], 16)).isascii():
            pairs[chr(code).lower()] = chr(int(parts[0], 16)).lower()
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _PLAIN = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), _ACCENTED, _PLAIN)


def fold_literal(text: str) -> str:
    """``fold`` for a string of the driver's."""
    return text.replace("İ", "i").lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def normalized(text: Column) -> Column:
    """Folded tokens between single spaces, with one before the first and after the last."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def squeezed(text: Column) -> Column:
    """White space runs as one space each, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def is_case_number(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{CASE_NUMBER}$"), F.lit(False))


def case_numbers(text: Column) -> Column:
    """All case numbers in a text."""
    return F.regexp_extract_all(text, F.lit(f"({CASE_NUMBER})"), 1)


def number_parts(number: Column) -> tuple[Column, Column]:
    """The two parts that a search form takes: the first 15 signs and the last 4."""
    return F.substring(number, 1, 15), F.right(number, F.lit(4))


def currency(text: Column) -> Column:
    """``R$`` and one space before the amount, no other white space; null if nothing is left."""
    bare = F.regexp_replace(text, SPACE, "")
    return F.when(bare == "", None).when(F.startswith(bare, F.lit("R$")), F.concat(F.lit("R$ "), F.substring(bare, 3, 1_000_000))).otherwise(bare)


def currency_value(text: Column) -> Column:
    """The amount as a number, null if there is none (to be sorted last)."""
    digits = F.regexp_replace(text, r"[^\d,]", "")
    return F.replace(F.regexp_extract(digits, r"^(\d*(?:,\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def leading_count(text: Column) -> Column:
    """The integer that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*(\d+)(?:\s|$)", 1).try_cast("int"), F.lit(0))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def file_date(path: Column) -> Column:
    """The date in a file name's first eight signs, or null."""
    return F.try_to_timestamp(F.substring(file_stem(path), 1, 8), F.lit("yyyyMMdd")).cast("date")


def shard_of(date: Column) -> Column:
    return F.concat(F.lit("legal_documents_"), F.year(date).cast("string"))


def shard_year(db_id: Column) -> Column:
    """The number at the end of a shard's name, else this year."""
    return F.coalesce(F.element_at(F.split(db_id, "_"), -1).try_cast("int"), F.year(F.current_date()))


def preview(text: Column, size: int = 400, mark: str = "…") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def cell(text: Column, size: int = 30) -> Column:
    """A table cell: longer texts end in three dots."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def date_range(start: Column, end: Column) -> Column:
    return F.coalesce(F.concat(start.cast("string"), F.lit(" to "), end.cast("string")), F.lit("Unknown"))


def title(name: str) -> str:
    """A column's heading."""
    return name.replace("_", " ").title()
