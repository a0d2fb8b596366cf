"""Case numbers from CSV files, search exports among them, and from plain lists."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import case_numbers, is_case_number
from ..schema import CASE_NUMBER, EXPORT_COLUMNS

_NUMBER = re.compile(CASE_NUMBER)


def numbers_in_csv(raw: bytes) -> list[str]:
    """Distinct case numbers of one CSV file, in order.

    The header is the first line that names the column, else the first line; the column is the one whose heading holds
    the name. Without such a column, or if the file can't be read as CSV, all of it is searched.
    """
    text = raw.decode("utf-8-sig", "replace")
    lines, name = text.splitlines(keepends=True), EXPORT_COLUMNS[0]
    first = next((k for k, line in enumerate(lines) if name in line), 0)
    try:
        rows = csv.reader(io.StringIO("".join(lines[first:])))
        place = next((k for k, h in enumerate(next(rows, [])) if name in h), None)
        if place is not None:
            return list(dict.fromkeys(n for row in rows if len(row) > place for n in _NUMBER.findall(row[place])))
    except csv.Error:
        pass
    return list(dict.fromkeys(_NUMBER.findall(text)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _numbers(files: pd.Series) -> pd.Series:
    return files.map(numbers_in_csv)


def read_case_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct case numbers of all CSV files at a path; a file is a row, so files are read in parallel."""
    return csv_case_numbers(spark.read.format("binaryFile").load(path))


def csv_case_numbers(files: DataFrame) -> DataFrame:
    """Distinct case numbers of CSV files, each whole in ``content``."""
    return files.select(F.explode(_numbers("content")).alias("number")).distinct()


def scan_case_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct case numbers anywhere in text files, line by line."""
    return numbers_in(spark.read.text(path), F.col("value"))


def numbers_in(lines: DataFrame, text: Column) -> DataFrame:
    return lines.select(F.explode(case_numbers(text)).alias("number")).distinct()


def listed_numbers(texts: DataFrame, text: Column, strict: bool = False) -> DataFrame:
    """The non-empty trimmed lines of typed lists; ``strict`` keeps whole case numbers only."""
    lines = texts.select(F.explode(F.split(text, "\n")).alias("number")).select(F.trim(F.regexp_replace("number", r"[\r\t]", " ")).alias("number")).where("number != ''")
    return lines.where(is_case_number(F.col("number"))) if strict else lines
