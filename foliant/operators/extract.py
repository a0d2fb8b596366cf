"""Case records from case pages, with errors as rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import page_fields
from ..functions.text import currency, is_case_number
from ..schema import RECORD_FIELDS, SEALED_TEXT
from .ordered import ordinals

#: Words in a page (or an error message) that tell what went wrong, tested in this order.
PAGE_ERRORS = (
    ("confidential", SEALED_TEXT, ("segredo de justiça", "acesso negado", "processo sigiloso", "não localizado", "não foi possível localizar", "processo inexistente", "acesso restrito")),
    ("not_found", "Processo não encontrado", ("processo não encontrado", "não encontrado", "não existe", "inexistente")),
    ("system_error", "Erro do sistema", ("erro interno", "sistema indisponível", "erro no servidor", "erro inesperado")),
)
MESSAGE_ERRORS = (
    ("timeout", ("timeout", "timed out")),
    ("ui_interception", ("click intercepted",)),
    ("browser_error", ("connection", "network", "dns")),
    ("confidential", ("segredo", "justiça", "sigiloso", "confidencial", "não localizado")),
)
NO_DATA, NO_RESULT = "Nenhum dado encontrado na página", "No result returned"
FORMAT_ERROR = "Invalid process number; expected NNNNNNN-DD.AAAA.J.TR.OOOO"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def page_error(html: Column) -> Column:
    """(error_type, error) that a page's words tell, or null."""
    lower, out = F.lower(html), F.lit(None)
    for kind, message, words in reversed(PAGE_ERRORS):
        out = F.when(_any(lower, words), F.struct(F.lit(kind).alias("error_type"), F.lit(message).alias("error"))).otherwise(out)
    return out


def message_error(message: Column) -> Column:
    """The type of a failed fetch by its message."""
    lower, out = F.lower(message), F.lit("unknown")
    for kind, words in reversed(MESSAGE_ERRORS):
        out = F.when(_any(lower, words), kind).otherwise(out)
    return out


def records(pages: DataFrame) -> DataFrame:
    """(number, html) to case records: a bad number, a sealed case, a page's error or an empty page is a row with ``error``."""
    readable = F.when(is_case_number(F.col("number")), F.col("html"))  # pages of bad numbers aren't read
    found = pages.select("number", "html", page_fields(readable).alias("f"))
    valid, sealed = is_case_number(F.col("number")), F.contains(F.lower("f.status"), F.lit(SEALED_TEXT.lower()))
    empty = F.coalesce("f.class_type", "f.subject", "f.plaintiff", "f.defendant").isNull()
    problem = F.struct(F.col("e.error_type"), F.col("e.error"))
    trouble = lambda kind, text: F.struct(F.lit(kind).alias("error_type"), F.lit(text).alias("error"))
    found = found.withColumn("e", page_error(F.col("html")))
    found = found.withColumn("p", F.when(~valid, trouble("format_error", FORMAT_ERROR)).when(sealed, trouble("confidential", SEALED_TEXT)).when(empty, F.coalesce(F.when(F.col("e").isNotNull(), problem), trouble("no_data", NO_DATA))))
    values = {"initial_date": F.substring("f.initial_date", 1, 10), "value": currency(F.col("f.value"))}
    shown = [F.when(F.col("p").isNull(), values.get(c, F.col(f"f.{c}"))).alias(c) for c in RECORD_FIELDS]
    return found.select("number", *shown, F.lit(None).cast("int").alias("other_processes"), F.col("p.error").alias("error"), F.col("p.error_type").alias("error_type"))


def with_other_processes(found: DataFrame) -> DataFrame:
    """How many records name the same defendant; sums per name are joined, so one name may have most rows."""
    counts = found.where("defendant is not null and error is null").groupBy("defendant").agg(F.count("*").cast("int").alias("n"))
    return found.drop("other_processes").join(counts, "defendant", "left").withColumn("other_processes", F.when(F.col("error").isNull(), F.col("n"))).select(found.columns)


def in_input_order(numbers: DataFrame, results: DataFrame) -> DataFrame:
    """(ordinal, number) with each number's record, repeats repeated, and ``No result returned`` where there is none."""
    marked = results.withColumn("_there", F.lit(True))
    joined = numbers.join(marked, "number", "left")
    return joined.withColumn("error", F.when(F.col("_there").isNull(), NO_RESULT).otherwise(F.col("error"))).drop("_there").orderBy("ordinal")


def remaining(numbers: DataFrame, done: DataFrame) -> DataFrame:
    """Numbers that earlier runs haven't processed."""
    return numbers.join(done.select("number"), "number", "left_anti")


def outcome(results: DataFrame) -> DataFrame:
    """One row: total, successes (no error), errors, and both in percent."""
    bad = F.coalesce(F.col("error") != "", F.lit(False))
    counted = results.agg(F.count("*").alias("total"), F.count_if(~bad).alias("successful"), F.count_if(bad).alias("errors"))
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.col("total") * 100, 1)).otherwise(0.0)
    return counted.withColumn("success_percent", share("successful")).withColumn("error_percent", share("errors"))


def error_histogram(results: DataFrame) -> DataFrame:
    return results.where("error_type is not null").groupBy("error_type").agg(F.count("*").alias("n")).orderBy("error_type")


def _sort_key(column: str) -> Column:
    from ..functions.text import currency_value

    return currency_value(F.col(column)) if column == "value" else F.col(column) if column == "other_processes" else F.nullif(F.lower(column), F.lit(""))


def sorted_records(results: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Records by one column as a table shows them: amounts by value, texts whatever their case, empty ones last."""
    key = _sort_key(column)
    return results.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "number")


def placed_records(results: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """The same with every record's ``place`` from 1, so any page of the table is a range of places."""
    keyed = results.withColumn("_key", _sort_key(column))
    by = F.col("_key").desc_nulls_last() if descending else F.col("_key").asc_nulls_last()
    return ordinals(keyed, [by, F.col("number").asc_nulls_first()], "place").withColumn("place", F.col("place") + 1).drop("_key")
