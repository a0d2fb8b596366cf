"""Distinct cases of any dates from stored bitmaps.

Every case has a dense code. For each shard, month and day, and each block of 32,768 codes, a bitmap tells which cases occur. The
cases of a range of dates are the union of the bitmaps of its whole months and of the days at its ends, so no
range counts rows again and none counts a case twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordinals


def case_codes(paragraphs: DataFrame) -> DataFrame:
    """(process_number, code): every case's place among all, from 1."""
    cases = paragraphs.select("process_number").where("process_number is not null").distinct()
    return ordinals(cases, [F.col("process_number").asc()], "place").select("process_number", (F.col("place") + 1).alias("code"))


def bitmaps(paragraphs: DataFrame, codes: DataFrame) -> DataFrame:
    """(db_id, level, period, block, bits): cases of each shard in each month and day; rows without a date or case have none."""
    coded = paragraphs.where("document_date is not null").select("db_id", "process_number", "document_date").join(codes, "process_number")
    days = coded.groupBy("db_id", F.col("document_date").alias("period"), F.bitmap_bucket_number("code").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
    months = days.groupBy("db_id", F.trunc("period", "month").alias("month"), "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return days.select("db_id", F.lit("day").alias("level"), "period", "block", "bits").unionAll(months.select("db_id", F.lit("month").alias("level"), F.col("month").alias("period"), "block", "bits"))


def write_bitmaps(paragraphs: DataFrame, path: str) -> None:
    table = bitmaps(paragraphs, case_codes(paragraphs))
    table.repartitionByRange("level", "period", "block").sortWithinPartitions("level", "period", "block").write.mode("overwrite").partitionBy("level").option("compression", "zstd").parquet(path)


def periods(ranges: DataFrame) -> DataFrame:
    """(range_id, level, period): whole months inside each range of dates (both ends count), and the days around them."""
    first = F.when(F.trunc("start_date", "month") == F.col("start_date"), F.col("start_date")).otherwise(F.add_months(F.trunc("start_date", "month"), 1))
    after = F.trunc(F.date_add("end_date", 1), "month")  # the month that isn't whole any more
    cut = ranges.where("start_date <= end_date").select("range_id", "start_date", "end_date", first.alias("first"), after.alias("after"))
    whole = F.col("first") < F.col("after")
    day = F.expr("interval 1 day")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b, day)).otherwise(F.array().cast("array<date>"))
    around = F.when(whole, F.concat(span(F.col("start_date"), F.date_sub("first", 1)), span(F.col("after"), F.col("end_date")))).otherwise(span(F.col("start_date"), F.col("end_date")))
    days = cut.select("range_id", F.lit("day").alias("level"), F.explode(around).alias("period"))
    months = cut.where(whole).select("range_id", F.lit("month").alias("level"), F.explode(F.sequence("first", F.add_months("after", -1), F.expr("interval 1 month"))).alias("period"))
    return days.unionAll(months)


def distinct_cases(table: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, n_cases) of every range of dates that has any case, by a table of bitmaps."""
    met = periods(ranges).join(table.select("level", "period", "block", "bits"), ["level", "period"])
    blocks = met.groupBy("range_id", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return blocks.groupBy("range_id").agg(F.sum(F.bitmap_count("bits")).alias("n_cases"))
