"""Tables and constants of the gazette corpus."""

from __future__ import annotations

from pyspark.sql import types as T

#: The shape of a case number, page limits, and the mark of a sealed case.
CASE_NUMBER = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"
PAGE_SIZE, MAX_PAGE_SIZE, DEADLINE_SECONDS = 100, 500, 30
SEALED_TEXT = "Segredo de justiça"

PARAGRAPHS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("process_number", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("file_path", T.StringType()), T.StructField("document_date", T.DateType()), T.StructField("db_id", T.StringType()),
])
LEDGER = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("processed_date", T.TimestampType())])
RECORD_FIELDS = ("initial_date", "class_type", "subject", "value", "last_movement", "status", "plaintiff", "defendant")
CASE_RECORDS = T.StructType([
    T.StructField("number", T.StringType()), *[T.StructField(f, T.StringType()) for f in RECORD_FIELDS],
    T.StructField("other_processes", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("error_type", T.StringType()),
])
EXPORT_COLUMNS = ("Process Number", "Mention Count", "Document Date", "Database", "File Path", "Content")
