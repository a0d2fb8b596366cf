"""Incremental ingest: every new file once, through a file stream with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import write
from ..operators.index import met
from ..operators.ingest import ledger_rows, paragraphs
from ..operators.maintain import keep_first
from ..storage import stored


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 200) -> DataFrame:
    """New text files as (file_path, text)."""
    return spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).schema("value string").format("text").load(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def ingest(spark: SparkSession, source: str, corpus: str, ledger: str, checkpoint: str, files_per_batch: int = 200, digests: str | None = None) -> StreamingQuery:
    """``ingest_files`` of the text files below a folder."""
    return ingest_files(text_stream(spark, source, files_per_batch), corpus, ledger, checkpoint, digests)


def ingest_files(files: DataFrame, corpus: str, ledger: str, checkpoint: str, digests: str | None = None) -> StreamingQuery:
    """Append paragraphs of a stream of (file_path, text) to the corpus, and the files to the ledger; ends when all that is there is done.

    The checkpoint gives each file to one batch. A batch that is run again after a failure replaces what it wrote: its
    rows and ledger entries lie in folders named after the batch. With ``digests`` (a folder), a paragraph whose shard has an equal one
    already, from this batch or one before, isn't appended again.
    """

    def batch(some: DataFrame, number: int) -> None:
        some = some.persist()
        rows = paragraphs(some)
        if digests is not None:
            rows = stored(first_seen(rows, digests, number), "first-seen")
            rows.select("db_id", F.md5("content").alias("digest")).sort("digest").write.mode("overwrite").option("parquet.bloom.filter.enabled#digest", "true").parquet(f"{digests}/batch={number}")
        write(rows, f"{corpus}/batch={number}", "overwrite")
        ledger_rows(some).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        some.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(rows: DataFrame, digests: str, number: int) -> DataFrame:
    """Of a batch's paragraphs those that no earlier batch has in the same shard, and of equal ones that with the smallest id.

    Only digests of batches before this one count, so a batch that is run again finds the same. The batch's
    own digests are grouped first; those of earlier batches are joined to them by shard and digest.
    """
    spark = rows.sparkSession
    kept = keep_first(rows).withColumn("digest", F.md5("content"))
    if number == 0:
        return kept.drop("digest")
    earlier = spark.read.option("basePath", digests).schema("db_id string, digest string, batch int").parquet(f"{digests}/batch=*").where(F.col("batch") < number)
    return met(kept, earlier.select("db_id", "digest"), ("db_id", "digest"), "left_anti").drop("digest")


def ingested(spark: SparkSession, corpus: str) -> DataFrame:
    """What all batches have written."""
    return spark.read.option("basePath", corpus).parquet(f"{corpus}/batch=*").drop("batch")


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Progress of jobs over time: events per window and type, late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
