"""The service's requests as plain functions; a web framework needs no more than to call them.

Each answers with (status, headers, body): 200 with JSON or CSV, 403 or 500 for the key, 404 for unknown jobs, 422
for values out of range.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import corpus, search
from .operators.index import IndexSearch
from .operators.jobs import JobRegistry
from .plans.filters import parse_date
from .schema import DEADLINE_SECONDS, MAX_PAGE_SIZE, PAGE_SIZE
from .sinks.export import csv_lines, json_response, record_lines

Answer = tuple[int, dict[str, str], str]


def _problem(status: int, text: str) -> Answer:
    return status, {"Content-Type": "application/json"}, json.dumps({"detail": text})


class Service:
    """Requests over one corpus."""

    def __init__(self, paragraphs: DataFrame, jobs: JobRegistry | None = None, key: str | None = None, deadline: float | None = DEADLINE_SECONDS, index: IndexSearch | None = None):
        self.index = index
        self.paragraphs, self.shards, self.jobs, self.key, self.deadline = paragraphs, corpus.manifest(paragraphs).persist(), jobs, key, deadline

    def refused(self, headers: Mapping[str, str]) -> Answer | None:
        """An answer if the key isn't right."""
        if not self.key:
            return _problem(500, "the server has no API key")
        return None if headers.get("X-API-Key") == self.key else _problem(403, "wrong API key")

    def _page(self, asked: Mapping[str, str]) -> search.SearchPage | Answer:
        try:
            page, size = int(asked.get("page") or 1), int(asked.get("page_size") or PAGE_SIZE)
            start, end = (parse_date(asked.get(k)) for k in ("start_date", "end_date"))
        except ValueError as e:
            return _problem(422, str(e))
        if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
            return _problem(422, f"page from 1, page_size from 1 to {MAX_PAGE_SIZE}")
        values = dict(keywords=asked.get("keywords"), process_number=asked.get("process_number"), start=start.isoformat() if start else None, end=end.isoformat() if end else None, exclusion=asked.get("exclusion_terms"))
        return search.search(self.paragraphs, **values, page=page, page_size=size, shards=self.shards, deadline_seconds=self.deadline, on_error="empty", index=self.index)

    def search(self, headers: Mapping[str, str], asked: Mapping[str, str]) -> Answer:
        page = self.refused(headers) or self._page(asked)
        if isinstance(page, tuple):
            return page
        return 200, {"Content-Type": "application/json"} | ({"X-Truncated": "true"} if page.truncated else {}), json_response(page)

    def export(self, headers: Mapping[str, str], asked: Mapping[str, str]) -> Answer:
        """The page as CSV, without a summary."""
        page = self.refused(headers) or self._page(asked)
        if isinstance(page, tuple):
            return page
        rows = page.results.select("process_number", "part", F.posexplode("mentions").alias("at", "m")).select((F.col("part") * search.MENTIONS_A_ROW + F.col("at")).cast("long").alias("id"), "process_number", "m.content", "m.document_date", "m.file_path", "m.db_id")
        return 200, {"Content-Type": "text/csv", "Content-Disposition": "attachment; filename=search.csv"} | ({"X-Truncated": "true"} if page.truncated else {}), "".join(csv_lines(rows, include_summary=False))

    def stats(self, headers: Mapping[str, str]) -> Answer:
        """Number of shards, first and last date, and each shard's dates."""
        if bad := self.refused(headers):
            return bad
        facts = corpus.corpus_statistics(self.shards).first()
        ranges = {r.db_id: f"{r.start_date} to {r.end_date}" if r.start_date else "Unknown" for r in self.shards.orderBy("db_id").collect()}  # a row per shard
        return 200, {"Content-Type": "application/json"}, json.dumps({"total_databases": facts.total_databases, "earliest": str(facts.earliest), "latest": str(facts.latest), "databases": ranges})

    def start_extraction(self, headers: Mapping[str, str], numbers: list[str], max_concurrent: int = 4) -> Answer:
        if bad := self.refused(headers):
            return bad
        try:
            return 200, {"Content-Type": "application/json"}, json.dumps({"job_id": self.jobs.start(numbers, max_concurrent)})
        except ValueError as e:
            return _problem(422, str(e))

    def extraction_status(self, headers: Mapping[str, str], job_id: str) -> Answer:
        if bad := self.refused(headers):
            return bad
        try:
            return 200, {"Content-Type": "application/json"}, json.dumps(self.jobs.status(job_id))
        except KeyError:
            return _problem(404, "no such job")

    def extraction_export(self, headers: Mapping[str, str], job_id: str) -> Answer:
        """What is done so far, as CSV."""
        if bad := self.refused(headers):
            return bad
        try:
            return 200, {"Content-Type": "text/csv"}, "".join(record_lines(self.jobs.results(job_id)))
        except LookupError:
            return _problem(404, "no results")
