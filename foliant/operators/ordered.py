"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small, stored

#: Bytes of a range of rows; a range is sorted by one task.
RANGE_BYTES = 32 << 20
#: Bytes of a group's key and numbers, as a broadcast holds them.
GROUP_BYTES = 128


def ranges_for(df: DataFrame) -> int:
    """How many ranges ``df`` is dealt to: by its size as the optimizer knows it, the session's setting at least."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(known / RANGE_BYTES)) if known < 1 << 50 else least


def ordinals(rows: DataFrame, order: list[Column], name: str = "ordinal", ranges: int | None = None) -> DataFrame:
    """All rows with their place from 0 in ``order``, whose last parts should tell rows apart.

    Rows are dealt to ranges of the whole order, so equal values of its first part are spread by the next ones. A row's
    place is that in its range and the number of rows in the ranges before. The ranges are written once, since they come from a sample.
    """
    dealt = rows.repartitionByRange(ranges or ranges_for(rows), *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    counts = placed.groupBy("_range").agg(F.count("*").alias("n"))  # a row per range
    before = counts.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).select(*rows.columns, name)


def places(rows: DataFrame, group: list[str], order: list[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """All rows with their place from 0 within their group, and the group's size as ``<name>_of``.

    Places in the order of all groups, less that of the group's first row: a group of most rows is spread over ranges like any.
    """
    everywhere = ordinals(rows, [*(F.col(c).asc_nulls_first() for c in group), *order], "_ordinal", ranges)
    first = everywhere.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(F.min("_ordinal").alias("_first"), F.count("*").alias(f"{name}_of"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    joined = everywhere.join(small(first, GROUP_BYTES), same)  # few groups: whole rows aren't dealt by group, all of one to a task
    return joined.withColumn(name, F.col("_ordinal") - F.col("_first")).select(*rows.columns, name, f"{name}_of")
