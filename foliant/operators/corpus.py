"""The corpus table, its shards' manifest and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_range, normalized
from ..plans.filters import shard_overlaps


def load(spark: SparkSession, path: str) -> DataFrame:
    """A corpus as ``write`` left it: Parquet with one partition per shard."""
    return spark.read.parquet(path)


def write(paragraphs: DataFrame, path: str, mode: str = "append", shards: bool = True) -> None:
    """Store paragraphs by shard, sorted for date and number statistics, with normalized text beside the content.

    Rows are dealt by shard and date ranges, so a shard with most rows is written by many tasks. Texts are normalized after
    that, so they are normalized once and don't go through the shuffle. Without ``shards``, the rows are one shard's, and ``path`` is its folder.
    """
    order = ("db_id", "document_date", "process_number") if shards else ("document_date", "process_number")
    out = paragraphs.repartitionByRange(*order).sortWithinPartitions(*order)
    out = out if "content_norm" in out.columns else out.withColumn("content_norm", normalized(F.col("content")))
    out.write.mode(mode).partitionBy(*order[:1] if shards else ()).option("compression", "zstd").option("parquet.bloom.filter.enabled#process_number", "true").parquet(path)


def manifest(paragraphs: DataFrame) -> DataFrame:
    """First and last date of each shard."""
    return paragraphs.groupBy("db_id").agg(F.min("document_date").alias("start_date"), F.max("document_date").alias("end_date"))


def relevant_shards(shards: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Ids of the shards that a date range touches, in order."""
    return shards.where(shard_overlaps(start, end, F.col("start_date"), F.col("end_date"))).select("db_id").orderBy("db_id")


def pruned(paragraphs: DataFrame, shards: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The shards' partitions that a date range touches; the list of shard names becomes a partition filter."""
    if not (start and start.strip()) and not (end and end.strip()):
        return paragraphs
    return paragraphs.where(F.col("db_id").isin([r.db_id for r in relevant_shards(shards, start, end).collect()]))


def shard_statistics(paragraphs: DataFrame) -> DataFrame:
    """Rows, cases and dates of each shard."""
    stats = paragraphs.groupBy("db_id").agg(F.count("*").alias("total_entries"), F.countDistinct("process_number").alias("unique_processes"), F.min("document_date").alias("start_date"), F.max("document_date").alias("end_date"))
    return stats.withColumn("date_range", date_range(F.col("start_date"), F.col("end_date")))


def corpus_statistics(shards: DataFrame) -> DataFrame:
    """One row over the manifest: number of shards, first and last date."""
    return shards.agg(F.count("*").alias("total_databases"), F.min("start_date").alias("earliest"), F.max("end_date").alias("latest"))


def validation(paragraphs: DataFrame) -> DataFrame:
    """Per year: files, paragraphs, cases, dates."""
    by_year = paragraphs.groupBy(F.year("document_date").alias("year"))
    return by_year.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("paragraphs"), F.countDistinct("process_number").alias("processes"), F.min("document_date").alias("start_date"), F.max("document_date").alias("end_date"))


def validation_totals(per_year: DataFrame) -> DataFrame:
    """Sums over years; a case of several years counts in each."""
    return per_year.agg(F.sum("files").alias("files"), F.sum("paragraphs").alias("paragraphs"), F.sum("processes").alias("processes"))
