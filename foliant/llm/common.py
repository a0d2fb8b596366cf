"""Helpers that the training-data operators share: table access, sizes of shuffles, Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..storage import scratch, shared_dir, small, stored  # noqa: F401  (for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parts_for(df: DataFrame, part_bytes: int = 64 << 20) -> int:
    """Into how many parts a shuffle of ``df`` should go: by its size as the optimizer knows it, the session's setting at least."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(known / part_bytes)) if known < 1 << 55 else least  # plans of unknown size say 2**63 or so


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each, one row at least."""
    for batch in batches:
        start, n, size = 0, batch.num_rows, batch.column(column).nbytes
        if size <= max_bytes or n == 1:
            if n:
                yield batch
            continue
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0))
        total = np.cumsum(lengths, dtype=np.int64)
        while start < n:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers live on
