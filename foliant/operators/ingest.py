"""From gazette texts to paragraphs: one per case mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, file_date, shard_of, squeezed
from ..schema import CASE_NUMBER

_HEAD = f"Processo {CASE_NUMBER}"


def segments(text: Column) -> Column:
    """A text cut before every case mention."""
    return F.split(text, f"(?={_HEAD})")


def segment(documents: DataFrame) -> DataFrame:
    """(file_path, text) to (file_path, position, process_number, content); what stands before the first case is dropped."""
    cut = documents.select("file_path", F.posexplode(segments(F.col("text"))).alias("position", "piece"))
    piece = F.regexp_replace(F.regexp_replace("piece", f"^{SPACE}", ""), f"{SPACE}$", "")
    cut = cut.withColumn("piece", piece).where(F.col("piece").rlike(f"^{_HEAD}"))
    return cut.select("file_path", "position", F.regexp_extract("piece", f"^Processo ({CASE_NUMBER})", 1).alias("process_number"), squeezed(F.col("piece")).alias("content"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """(file_path, text) to corpus rows; files without a date in their names give none."""
    dated = segment(documents).withColumn("document_date", file_date(F.col("file_path"))).where("document_date is not null")
    return dated.select(F.xxhash64("file_path", "position").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).alias("id"), "process_number", "content", "file_path", "document_date", shard_of(F.col("document_date")).alias("db_id"))


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger doesn't have."""
    return files.join(ledger.select("file_path"), "file_path", "left_anti")


def files_by_year(files: DataFrame) -> DataFrame:
    """How many files each year has; names without a date count for none."""
    return files.select(F.year(file_date(F.col("file_path"))).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("files"))


def ledger_rows(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.current_timestamp().alias("processed_date"))
