"""Gazette files as (file_path, text): text files, or PDF pages through an extractor that is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Whole text files, folders below included."""
    return spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, extract: Callable[[bytes], str], pattern: str = "*.pdf") -> DataFrame:
    """(file_path, text, error) of files read by ``extract``; one that raises gives an empty text and its error, and others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read(content: bytes) -> tuple[str, str | None]:
            try:
                return extract(content), None
            except Exception as e:
                return "", f"{type(e).__name__}: {e}"

        for batch in batches:
            texts, errors = zip(*map(read, batch.content)) if len(batch) else ((), ())
            yield pd.DataFrame({"file_path": batch.path, "text": texts, "error": errors})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, "file_path string, text string, error string")
