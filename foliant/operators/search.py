"""Search: matching mentions, case-level exclusion, recency order, pages, summaries."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..plans.filters import all_of, date_filters, holds_excluded, number_filter
from ..plans.keywords import QuerySyntaxError, keyword_filter
from ..schema import MAX_PAGE_SIZE, PAGE_SIZE
from ..storage import stored
from .corpus import pruned
from .index import IndexSearch, met
from .ordered import places

#: Mentions of a case in one row of a nested result.
MENTIONS_A_ROW = 200
MENTION = ("process_number", "content", "document_date", "file_path", "db_id")


def newest() -> list:
    """Mentions' order: newest first, then by shard and id."""
    return [F.col("document_date").desc_nulls_last(), F.col("db_id").asc(), F.col("id").asc()]


def one_of(column: str, values: list) -> Column:
    """Whether a column has one of the values, null among them."""
    known = F.col(column).isin([v for v in values if v is not None])
    return F.coalesce(known, F.lit(False)) | F.col(column).isNull() if None in values else known


def matches(paragraphs: DataFrame, keywords: str | None = None, process_number: str | None = None, start: str | None = None, end: str | None = None, shards: DataFrame | None = None, on_error: str = "raise", index: IndexSearch | None = None) -> DataFrame:
    """Mentions that fit all given conditions; none given keeps all.

    With ``shards`` (the manifest), only partitions that the dates touch are read; with ``index``, keywords are looked up
    there and no text is read for them. A keyword query outside of the
    language raises, or with ``on_error='empty'`` matches nothing.
    """
    corpus = pruned(paragraphs, shards, start, end) if shards is not None else paragraphs
    tests = date_filters(start, end, F.col("document_date"))
    if (number := number_filter(process_number, F.col("process_number"))) is not None:
        tests.append(number)
    if keywords and keywords.strip():
        norm = F.col("content_norm") if "content_norm" in corpus.columns else normalized(F.col("content"))
        try:
            if index is not None:
                corpus = index.matches(corpus, keywords)
            else:
                tests.append(keyword_filter(keywords, norm))
        except QuerySyntaxError:
            if on_error != "empty":
                raise
            tests.append(F.lit(False))
    return corpus.where(all_of(tests)).select("id", *MENTION)


def without_excluded(found: DataFrame, exclusion: str | None) -> DataFrame:
    """Mentions of cases of which no matched mention holds an excluded term."""
    bad = holds_excluded(exclusion, F.col("content"))
    if bad is None:
        return found
    return found.join(found.where(bad).select("process_number").distinct(), "process_number", "left_anti").select(found.columns)


def cases(found: DataFrame, exclusion: str | None = None) -> DataFrame:
    """One narrow row per case: number of mentions and latest date; excluded cases are left out in the same pass."""
    bad = holds_excluded(exclusion, F.col("content"))
    per_case = found.groupBy("process_number").agg(F.count("*").alias("mention_count"), F.max("document_date").alias("last_date"), F.bool_or(bad if bad is not None else F.lit(False)).alias("excluded"))
    return per_case.where("not excluded").drop("excluded")


def by_recency(keys: DataFrame) -> DataFrame:
    return keys.orderBy(F.col("last_date").desc_nulls_last(), F.col("process_number").asc())


def page_of(keys: DataFrame, page: int = 1, page_size: int | None = PAGE_SIZE) -> DataFrame:
    """A page of cases by recency; ``page_size=None`` is all of them."""
    if page < 1 or page_size is not None and not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page from 1, page_size from 1 to {MAX_PAGE_SIZE}")
    ordered = by_recency(keys)
    return ordered if page_size is None else ordered.offset((page - 1) * page_size).limit(page_size)


def mentions_of(found: DataFrame, keys: DataFrame, small: bool = True) -> DataFrame:
    """Mentions of the given cases; a page's keys, at most ``MAX_PAGE_SIZE``, are broadcast."""
    keys = keys.select("process_number", "last_date")
    return found.join(F.broadcast(keys) if small else keys, "process_number")


def labelled(found: DataFrame) -> DataFrame:
    """Each mention's place among its case's, newest first, as ``i/n``; a case of most mentions is spread over tasks."""
    placed = places(found, ["process_number"], newest(), "_at")
    counted = placed.withColumn("mention_count", F.col("_at_of")).withColumn("mention_index", F.col("_at") + 1).drop("_at", "_at_of")
    return counted.withColumn("mention_label", F.concat_ws("/", "mention_index", "mention_count"))


def nested(found: DataFrame, most: int = MENTIONS_A_ROW) -> DataFrame:
    """Cases by recency with their mentions in order: a row per case, and for every ``most`` mentions of it (``part`` from 0).

    So no row, and no task, grows with a case.
    """
    mention = F.struct("document_date", "db_id", "file_path", "content")
    parted = labelled(found).withColumn("part", F.floor((F.col("mention_index") - 1) / most).cast("int"))
    rows = parted.groupBy("process_number", "part").agg(F.first("mention_count").cast("int").alias("mention_count"), F.sort_array(F.collect_list(F.struct("mention_index", mention.alias("m")))).alias("all"))
    last = parted.groupBy(F.col("process_number").alias("_case")).agg(F.max("document_date").alias("last_date"))  # of what is stored with places
    dated = rows.join(last, F.col("process_number").eqNullSafe(F.col("_case")))
    ordered = dated.orderBy(F.col("last_date").desc_nulls_last(), F.col("process_number").asc(), "part")
    return ordered.select("process_number", "mention_count", "part", F.transform("all", lambda x: x["m"]).alias("mentions"))


def newest_per_case(found: DataFrame, n: int) -> DataFrame:
    """The n newest mentions of each case."""
    rank = F.row_number().over(Window.partitionBy("process_number").orderBy(*newest()))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def summary(found: DataFrame) -> DataFrame:
    """One row: cases, mentions, first and last date."""
    return found.agg(F.countDistinct("process_number").alias("total_processes"), F.count("*").alias("total_mentions"), F.min("document_date").alias("earliest"), F.max("document_date").alias("latest"))


def per_shard(found: DataFrame) -> DataFrame:
    return found.groupBy("db_id").agg(F.count("*").alias("mentions"))


def total_pages(total: int, page_size: int = PAGE_SIZE) -> int:
    return max(1, -(-total // page_size))


def pages_of(total: Column, page_size: Column) -> Column:
    """``total_pages`` for columns: pages that so many cases fill, one at least."""
    return F.greatest(F.lit(1), F.ceil(total / page_size))


def page_buttons(page: Column, pages: Column, shown: int = 5) -> Column:
    """The page numbers that are offered around a page: ``shown`` at most, from two before it."""
    first = F.greatest(F.lit(1), page - 2)
    return F.sequence(first, F.greatest(first, F.least(pages, first + shown - 1)))


@dataclass
class SearchPage:
    """A page of cases; ``results`` has one row per case with its mentions."""

    results: DataFrame
    total_processes: int
    page: int
    page_size: int | None
    truncated: bool = False


def search(paragraphs: DataFrame, keywords: str | None = None, process_number: str | None = None, start: str | None = None, end: str | None = None, exclusion: str | None = None, page: int = 1, page_size: int | None = PAGE_SIZE, shards: DataFrame | None = None, deadline_seconds: float | None = None, on_error: str = "raise", index: IndexSearch | None = None) -> SearchPage:
    """Search, exclude, order and page.

    Keys are paged before contents are fetched, and a page's mentions are fetched once. With a deadline, shards are searched as jobs of their own, and those that
    don't end in time are left out and the page marked as truncated.
    """
    conditions = dict(keywords=keywords, process_number=process_number, start=start, end=end, shards=shards, on_error=on_error, index=index)
    found, held, seen, truncated = matches(paragraphs, **conditions), paragraphs, None, False
    if deadline_seconds is not None:
        seen, done, truncated = _shards_in_time(paragraphs, conditions, exclusion, deadline_seconds)
        held = paragraphs.where(one_of("db_id", done))
        found = met(matches(held, **conditions), seen)
        per_case = seen.groupBy("process_number").agg(F.count("*").alias("mention_count"), F.max("document_date").alias("last_date"), F.bool_or("bad").alias("bad"))
        keys = per_case.where("not bad").drop("bad")
    else:
        keys = cases(found, exclusion)
    if page_size is None:
        return SearchPage(nested(mentions_of(found, page_of(keys, page, None), False).drop("last_date")), keys.count(), page, None, truncated)
    keys = keys.persist()  # narrow rows, read for the page and for the total
    try:
        chosen = page_of(keys, page, page_size).collect()  # a page, MAX_PAGE_SIZE rows at most
        total = keys.count()
    finally:
        keys.unpersist()
    own = held.where(F.col("process_number").isin([r.process_number for r in chosen if r.process_number is not None]))  # before any text is looked at
    own = matches(own, **conditions) if seen is None else met(matches(own, **conditions), seen)
    return SearchPage(nested(stored(own, "page")), total, page, page_size, truncated)


def _shards_in_time(paragraphs: DataFrame, conditions: dict, exclusion: str | None, seconds: float) -> tuple[DataFrame, list[str | None], bool]:
    """Keys, dates and cases of the matches of shards whose jobs end before the deadline, these shards, and whether any is missing.

    Contents are fetched later, for a page. A shard that ends late doesn't count, so that each shard is there whole or not at all.
    """
    spark, tag = paragraphs.sparkSession, f"search-{uuid.uuid4().hex}"
    shards = conditions["shards"]
    names = [r.db_id for r in (shards if shards is not None else paragraphs).select("db_id").distinct().collect()]  # a row per shard
    found, ended, lock = {}, time.monotonic() + seconds, threading.Lock()
    bad = holds_excluded(exclusion, F.col("content"))
    narrow = lambda rows: matches(rows, **conditions).select("db_id", "id", "process_number", "document_date", (bad if bad is not None else F.lit(False)).alias("bad"))

    def one(name: str | None) -> None:
        if time.monotonic() >= ended:
            return
        spark.addTag(tag)
        try:
            part = stored(narrow(paragraphs.where(F.col("db_id").eqNullSafe(F.lit(name)))), "found")
            with lock:
                if time.monotonic() < ended:
                    found[name] = part
        except Exception:
            if time.monotonic() < ended:
                raise
        finally:
            spark.removeTag(tag)

    from pyspark import InheritableThread

    waiting = sorted(names, key=lambda n: (n is None, n))
    while waiting:
        batch, waiting = waiting[:16], waiting[16:]
        threads = [InheritableThread(target=one, args=(name,)) for name in batch]
        for t in threads:
            t.start()
        for t in threads:
            t.join(max(0.0, ended - time.monotonic()))
        if time.monotonic() >= ended:
            spark.interruptTag(tag)
            break
    with lock:
        parts, done = list(found.values()), list(found)
    out = narrow(paragraphs.limit(0))
    for part in parts:
        out = out.unionAll(part)
    return out, done, len(parts) < len(names)
