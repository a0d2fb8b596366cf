"""Search results and case records as CSV, JSON and text."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title
from ..operators.search import labelled, per_shard, summary
from ..schema import EXPORT_COLUMNS


def export_rows(found: DataFrame) -> DataFrame:
    """One row per mention in export order: cases by recency, mentions newest first."""
    placed = labelled(found)
    last = placed.groupBy(F.col("process_number").alias("_case")).agg(F.max("document_date").alias("last_date"))  # of what is stored with places
    rows = placed.join(last, F.col("process_number").eqNullSafe(F.col("_case"))).orderBy(F.col("last_date").desc_nulls_last(), "process_number", "mention_index")
    values = ("process_number", "mention_label", "document_date", "db_id", "file_path", "content")
    return rows.select(*[F.col(v).alias(c) for v, c in zip(values, EXPORT_COLUMNS)])


def _line(*cells: object) -> str:
    out = io.StringIO()
    csv.writer(out).writerow(["" if c is None else c for c in cells])
    return out.getvalue()


def preamble(found: DataFrame, parameters: Mapping[str, object] | None = None) -> Iterator[tuple]:
    """The cells of each line before the rows of an export; parameters without a value are left out."""
    facts = summary(found).first()
    yield ("=== Search Results Summary ===",)
    if parameters:
        yield ("=== Search Parameters ===",)
        yield from ((k, v) for k, v in parameters.items() if v)
        yield ("",)
    yield "Total Processes", facts.total_processes
    yield "Total Mentions", facts.total_mentions
    if facts.earliest:
        yield "Date Range", f"{facts.earliest} to {facts.latest}"
    yield ("=== Database Distribution ===",)
    yield from ((f"Database {r.db_id}", r.mentions) for r in per_shard(found).orderBy("db_id").collect())  # a row per shard
    yield ("",)


def csv_lines(found: DataFrame, include_summary: bool = True, parameters: Mapping[str, object] | None = None) -> Iterator[str]:
    """The CSV export line by line; rows come a partition at a time."""
    if include_summary:
        yield from (_line(*cells) for cells in preamble(found, parameters))
    yield _line(*EXPORT_COLUMNS)
    yield from (_line(*row) for row in export_rows(found).toLocalIterator())


def write_csv(found: DataFrame, path: str, include_summary: bool = True, parameters: Mapping[str, object] | None = None) -> None:
    """One local file with the summary before the rows, for a page or a report."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines(csv_lines(found, include_summary, parameters))


def write_csv_parts(found: DataFrame, path: str) -> None:
    """All rows without a summary, written in parallel."""
    export_rows(found).write.mode("overwrite").option("header", True).csv(path)


def json_page(page) -> DataFrame:
    """One JSON text per row of a search page: a case, or a part (from 0) of one with very many mentions."""
    return page.results.select("part", F.to_json(F.struct("process_number", "mention_count", "mentions")).alias("json"))


def json_response(page) -> str:
    """The answer to a search request: totals and the page's cases."""
    results: list[dict] = []
    for row in json_page(page).toLocalIterator():  # at most a page
        case = json.loads(row.json)
        if results and results[-1].get("process_number") == case.get("process_number"):
            results[-1]["mentions"] += case["mentions"]
        else:
            results.append(case)
    return json.dumps({"total_processes": page.total_processes, "page": page.page, "page_size": page.page_size, "truncated": page.truncated, "results": results}, ensure_ascii=False)


def record_lines(results: DataFrame, mark: bool = False) -> Iterator[str]:
    """Case records as CSV with headings; ``mark`` begins with a byte order mark."""
    yield ("﻿" if mark else "") + _line(*map(title, results.columns))
    yield from (_line(*row) for row in results.toLocalIterator())


def write_records(results: DataFrame, path: str, mark: bool = True) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines(record_lines(results, mark))
