"""Pages of cases without all of their matches: newest shards first, cursors, and an index of places."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.filters import holds_excluded
from ..schema import PAGE_SIZE
from ..storage import stored
from .index import met
from .ordered import ordinals
from .search import by_recency, cases, matches, one_of

CASE = "process_number string, mention_count long, last_date date"


@dataclass
class NewestPage:
    """The newest cases, how many shards were read to find them, and how many there are that the dates touch."""

    cases: DataFrame
    shards_read: int
    shards: int


def newest_cases(paragraphs: DataFrame, manifest: DataFrame, size: int = PAGE_SIZE, keywords: str | None = None, start: str | None = None, end: str | None = None, exclusion: str | None = None) -> NewestPage:
    """The first page of a search: (process_number, mention_count, last_date) of the ``size`` newest cases.

    Shards are read by descending last date, twice as many each time, until the last case of the page is newer than all
    that shards which haven't been read can hold. Then that page's cases, and only those, are looked up in the older shards, for excluded
    terms and their number of mentions; if that excludes any, the search goes on without them. Contents of older shards
    are read by case number, which files know by their statistics and Bloom filters.
    """
    spark = paragraphs.sparkSession
    listed = manifest.orderBy(F.col("end_date").desc_nulls_last(), "db_id").select("db_id", "end_date").collect()  # a row per shard
    names, ends = [r.db_id for r in listed], [r.end_date for r in listed]
    hit = lambda rows: matches(rows, keywords, None, start, end)
    keys, barred, read, step = None, None, 0, 1
    while True:
        if read < len(names):
            own = hit(paragraphs.where(one_of("db_id", names[read : read + step])))
            bad = holds_excluded(exclusion, F.col("content"))
            seen = own.groupBy("process_number").agg(F.max("document_date").alias("last_date"), F.bool_or(bad if bad is not None else F.lit(False)).alias("bad"))
            seen = stored(seen, "newest")
            keys = seen if keys is None else stored(keys.unionAll(seen).groupBy("process_number").agg(F.max("last_date").alias("last_date"), F.bool_or("bad").alias("bad")), "newest")
            read, step = read + step, 2 * step
        if keys is None:
            return NewestPage(spark.createDataFrame([], CASE), 0, 0)
        open_ = keys.where("not bad")
        if barred is not None:
            open_ = met(open_, barred, ("process_number",), "left_anti")
        top = by_recency(open_).limit(size).collect()  # a page
        left = ends[read:]
        sure = not left or (len(top) == size and top[-1].last_date is not None and (left[0] is None or top[-1].last_date > left[0]))
        if not sure:
            continue
        numbers = spark.createDataFrame([(r.process_number, r.last_date) for r in top], "process_number string, last_date date")
        own = hit(paragraphs.where(one_of("process_number", [r.process_number for r in top])))
        counted = cases(own, exclusion)
        kept = stored(counted.select("process_number", "mention_count", "last_date"), "newest-page")
        n = kept.count()  # a page at most
        if n == len(top):
            return NewestPage(by_recency(kept), min(read, len(names)), len(names))
        gone = stored(met(numbers.select("process_number"), kept, ("process_number",), "left_anti"), "newest-barred")
        barred = gone if barred is None else barred.unionAll(gone)


def page_after(keys: DataFrame, last_date: datetime.date | None, process_number: str, size: int = PAGE_SIZE) -> DataFrame:
    """The cases that follow a given one (the last of the page before) by recency: no page before it is sorted or counted."""
    number = F.col("process_number") > process_number
    if last_date is None:
        rest = F.col("last_date").isNull() & number
    else:
        rest = (F.col("last_date") < F.lit(last_date)) | ((F.col("last_date") == F.lit(last_date)) & number) | F.col("last_date").isNull()
    return by_recency(keys.where(rest)).limit(size)


class PageIndex:
    """All cases of a search with their places, written once; any page is a range of the places.

    Cases are sorted in ranges, so no task holds all of them, and a page reads the rows whose places it asks for: files know them by
    their statistics. The number of cases is known without a count.
    """

    def __init__(self, keys: DataFrame):
        placed = ordinals(keys, [F.col("last_date").desc_nulls_last(), F.col("process_number").asc()], "place")
        self.keys = stored(placed, "places")
        self.total = self.keys.agg(F.coalesce(F.max("place") + 1, F.lit(0)).alias("n")).first().n

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        return self.keys.where(F.col("place").between((number - 1) * size, number * size - 1)).drop("place")

    def pages(self, size: int = PAGE_SIZE) -> int:
        return max(1, -(-self.total // size))

    def cursors(self, size: int = PAGE_SIZE) -> DataFrame:
        """(page, last_date, process_number): the case before each page, from which ``page_after`` goes on."""
        before = self.keys.where((F.col("place") + 1) % size == 0)
        return before.select(F.floor((F.col("place") + 1) / size + 1).cast("long").alias("page"), "last_date", "process_number")
