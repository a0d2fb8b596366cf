"""Older shards: SQLite files with a paragraphs table, as a Spark data source.

``spark.dataSource.register(ShardSource)``, then ``spark.read.format("sqlite_corpus").load(folder)``. Every file of the folder
that has the table is a partition; date bounds and equal case numbers are passed on to SQLite. The folder must be one that
executors see as the driver does.
"""

from __future__ import annotations

import datetime
import glob
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from ..functions.blobs import inflate

_SCHEMA = "id long, process_number string, content string, file_path string, document_date date, db_id string"
_SIGNS = {EqualTo: "=", GreaterThanOrEqual: ">=", LessThanOrEqual: "<="}


class ShardFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _readable(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def shard_files(folder: str) -> list[str]:
    """The SQLite files of a folder that have a paragraphs table, in order; others are passed over."""
    out = []
    for path in sorted(glob.glob(os.path.join(folder, "*.db"))):
        try:
            with _readable(path) as db:
                if db.execute("select 1 from sqlite_master where type = 'table' and name = 'paragraphs'").fetchone():
                    out.append(path)
        except sqlite3.Error:
            continue
    return out


class ShardReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.tests, self.values = folder, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            sign = _SIGNS.get(type(f))
            if sign and f.attribute in (("document_date",), ("process_number",)) and (sign == "=" or f.attribute == ("document_date",)):
                self.tests.append(f"{f.attribute[0]} {sign} ?")
                self.values.append(f.value.isoformat() if isinstance(f.value, datetime.date) else f.value)
            else:
                yield f

    def partitions(self) -> list[ShardFile]:
        return [ShardFile(p) for p in shard_files(self.folder)]

    def read(self, partition: ShardFile) -> Iterator[tuple]:
        name = os.path.splitext(os.path.basename(partition.path))[0]
        where = " where " + " and ".join(self.tests) if self.tests else ""
        with _readable(partition.path) as db:
            for i, number, content, path, date in db.execute(f"select id, process_number, content, file_path, document_date from paragraphs{where}", self.values):
                yield i, number, inflate(content), path, datetime.date.fromisoformat(date) if date else None, name


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_corpus"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"])


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardSource)
    return spark.read.format("sqlite_corpus").load(folder)
