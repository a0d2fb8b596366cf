"""Bulk export as a data source: parts are written side by side, and appear together when all are done.

``df.write.format("case_export").option("path", ...)`` writes CSV parts of ``df`` (in the order of its partitions) into a hidden folder
of the target. The commit writes the heading file with the byte order mark, summary and column names, then renames
the parts, and last writes a list of them; readers go by that list. A job that fails leaves no list, and its hidden folder is
removed. Parts are read by the same module that writes them, a part as a stream, so that line breaks of any kind inside texts come back as they were.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

MARK, LIST, HEAD = "﻿", "export.json", "head.csv"
BATCH_SIGNS = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    name: str
    partition: int
    rows: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _cells(cells) -> str:
    out = io.StringIO()
    csv.writer(out).writerow(["" if c is None else c for c in cells])
    return out.getvalue()


class CaseExportWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], head: str):
        self.path, self.columns, self.head, self.hidden = path.rstrip("/"), columns, head, f"_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        store, folder = _place(f"{self.path}/{self.hidden}")
        context = TaskContext.get()
        name, rows = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.csv", 0
        with store.open_output_stream(f"{folder}/{name}") as out:  # not after the folder was removed
            for row in iterator:
                out.write(_cells(row).encode("utf-8"))
                rows += 1
        return Part(name, context.partitionId(), rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        store, folder = _place(self.path)
        with store.open_output_stream(f"{folder}/{HEAD}") as out:
            out.write((MARK + self.head + _cells(self.columns)).encode("utf-8"))
        for m in parts:
            store.move(f"{folder}/{self.hidden}/{m.name}", f"{folder}/{m.name}")
        with store.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps({"head": HEAD, "columns": self.columns, "parts": [m.name for m in parts], "rows": sum(m.rows for m in parts)}).encode())
        store.delete_dir(f"{folder}/{self.hidden}")

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = _place(f"{self.path}/{self.hidden}")
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class PartFile(InputPartition):
    def __init__(self, name: str):
        self.name = name


class CaseExportReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], parts: list[str]):
        self.path, self.columns, self.parts = path.rstrip("/"), columns, parts

    def partitions(self) -> list[PartFile]:
        return [PartFile(p) for p in self.parts]

    def _batch(self, rows: list[list[str]]) -> pa.RecordBatch:
        cells = [pa.array([c or None for c in column], pa.string()) for column in zip(*rows)]
        return pa.record_batch(cells, schema=pa.schema([pa.field(c, pa.string()) for c in self.columns]))

    def read(self, partition: PartFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an export without parts
            return
        csv.field_size_limit((1 << 31) - 1)
        store, place = _place(f"{self.path}/{partition.name}")
        with store.open_input_stream(place) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as lines:
            rows, signs = [], 0
            for row in csv.reader(lines):
                rows.append(row)
                signs += sum(map(len, row))
                if signs >= BATCH_SIGNS:
                    yield self._batch(rows)
                    rows, signs = [], 0
            if rows:
                yield self._batch(rows)


class CaseExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "case_export"

    def _listed(self) -> dict:
        store, place = _place(f"{self.options['path'].rstrip('/')}/{LIST}")
        with store.open_input_stream(place) as f:
            return json.loads(f.read())

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self._listed()["columns"]])

    def reader(self, schema: StructType) -> CaseExportReader:
        return CaseExportReader(self.options["path"], schema.names, self._listed()["parts"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        store, folder = _place(path)
        if store.get_file_info(f"{folder}/{LIST}").type != fs.FileType.NotFound:
            if not overwrite:
                raise ValueError(f"there is an export at {path} already")
            store.delete_file(f"{folder}/{LIST}")
        made = CaseExportWriter(path, schema.names, self.options.get("head", ""))
        store.create_dir(f"{folder}/{made.hidden}", recursive=True)
        return made


def write_export(rows: DataFrame, path: str, head: str = "", overwrite: bool = False) -> None:
    """Export ``rows`` in their order, all as texts; ``head`` stands before the column names."""
    rows.sparkSession.dataSource.register(CaseExport)
    texts = rows.select([F.col(c).cast("string").alias(c) for c in rows.columns])
    texts.write.format("case_export").mode("overwrite" if overwrite else "append").option("path", path).option("head", head).save()


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an export, as texts, empty ones as null; one that never was committed isn't there."""
    spark.dataSource.register(CaseExport)
    return spark.read.format("case_export").load(path)
