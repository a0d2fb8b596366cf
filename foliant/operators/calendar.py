"""Download plans: working days by booklets, without what is there already."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The gazette's booklets, number and name.
BOOKLETS = (("12", "Judicial_Capital_1"), ("20", "Judicial_Capital_2"), ("18", "Judicial_Interior_1"), ("13", "Judicial_Interior_2"), ("15", "Judicial_Interior_3"))


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from start to end."""
    first, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    return spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))


def working_days(dates: DataFrame, today: str | None = None) -> DataFrame:
    """Monday to Friday, none after today."""
    limit = F.lit(datetime.date.fromisoformat(today)) if today else F.current_date()
    return dates.where((F.weekday("date") < 5) & (F.col("date") <= limit))


def download_plan(spark: SparkSession, start: str, end: str, existing: DataFrame | None = None, today: str | None = None) -> DataFrame:
    """(date, booklet_value, booklet_name, form_date, path) for each working day and booklet that isn't in ``existing`` (path)."""
    booklets = spark.createDataFrame(BOOKLETS, "booklet_value string, booklet_name string")
    path = F.concat(F.date_format("date", "yyyy/MM/yyyyMMdd"), F.lit("_"), F.col("booklet_name"), F.lit(".pdf"))
    plan = working_days(days(spark, start, end), today).crossJoin(F.broadcast(booklets)).select("date", "booklet_value", "booklet_name", F.date_format("date", "dd/MM/yyyy").alias("form_date"), path.alias("path"))  # five fixed rows
    return plan if existing is None else plan.join(existing.select("path"), "path", "left_anti").select(plan.columns)
