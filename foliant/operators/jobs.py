"""Extraction jobs: batches in the background, progress, resume, statistics."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CASE_RECORDS
from ..sinks.export_source import write_export
from .extract import error_histogram, in_input_order, message_error, outcome, records, remaining
from .ordered import ordinals

Fetch = Callable[[DataFrame], DataFrame]


def batches(numbers: DataFrame, size: int = 50) -> DataFrame:
    """(ordinal, number) with the number of the batch that each belongs to."""
    return numbers.withColumn("batch", F.floor(F.col("ordinal") / size).cast("long"))


def percent(done: int, total: int) -> int:
    return round(done / total * 100) if total else 0


def percent_done(done: Column, total: Column) -> Column:
    """The same for columns, halves rounded up."""
    return F.when(total > 0, F.round(done / total * 100)).otherwise(0).cast("int")


def last_results(results: DataFrame, n: int = 50) -> DataFrame:
    """The n rows with the highest ordinals."""
    return results.orderBy(F.desc("ordinal")).limit(n)


@dataclass
class Job:
    """State of one extraction."""

    id: str
    total: int
    path: str
    status: str = "pending"
    done: int = 0
    error: str | None = None
    seconds: list[float] = field(default_factory=list)
    snapshots: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def snapshot(self) -> dict:
        return {"job_id": self.id, "status": self.status, "done": self.done, "total": self.total, "percent": percent(self.done, self.total), "error": self.error}


class JobRegistry:
    """Jobs of one driver; results of each batch are appended to the job's Parquet table.

    With ``snapshot_every``, all records so far are exported after every so many batches, in the order of the numbers; a snapshot that
    fails is told in the job's ``notes`` and ends nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, fetch: Fetch, batch_size: int = 50, snapshot_every: int | None = None):
        self.spark, self.folder, self.fetch, self.batch_size, self.snapshot_every = spark, folder.rstrip("/"), fetch, batch_size, snapshot_every
        self.jobs: dict[str, Job] = {}
        self.lock = threading.Lock()

    def start(self, numbers: list[str], max_concurrent: int = 4, wait: bool = False) -> str:
        """Begin to fetch and read the pages of ``numbers``; repeated ones are fetched once."""
        if not numbers:
            raise ValueError("at least one case number")
        if not 1 <= max_concurrent <= 8:
            raise ValueError("max_concurrent from 1 to 8")
        job = Job(uuid.uuid4().hex, len(numbers), f"{self.folder}/{uuid.uuid4().hex}")
        with self.lock:
            self.jobs[job.id] = job
        thread = threading.Thread(target=self._run, args=(job, numbers, max_concurrent), daemon=True)
        thread.start()
        if wait:
            thread.join()
        return job.id

    def _run(self, job: Job, numbers: list[str], max_concurrent: int) -> None:
        job.status = "running"
        times = Counter(numbers)
        distinct = list(times)
        try:
            for at in range(0, len(distinct), self.batch_size):
                began, part = time.monotonic(), distinct[at : at + self.batch_size]
                frame = self.spark.createDataFrame([(n,) for n in part], "number string").repartition(max_concurrent)
                pages = self.fetch(frame)  # a plug-in that can't even be called ends the job
                try:
                    records(pages).write.mode("append").parquet(job.path)
                except Exception:
                    self._one_by_one(job, part)
                with self.lock:
                    job.done += sum(times[n] for n in part)
                    job.seconds.append(time.monotonic() - began)
                if self.snapshot_every and len(job.seconds) % self.snapshot_every == 0:
                    self._snapshot(job, distinct[: at + len(part)])
            job.status = "done"
        except Exception as e:
            job.status, job.error = "error", str(e)[:500]

    def _snapshot(self, job: Job, numbers: list[str]) -> None:
        """Export what there is, as a folder that appears when it is whole."""
        path = f"{job.path}-snapshots/{len(numbers):09d}"
        try:
            asked = self.spark.createDataFrame(list(enumerate(numbers)), "ordinal long, number string")
            write_export(in_input_order(asked, self.spark.read.parquet(job.path)).drop("ordinal"), path, overwrite=True)
            job.snapshots.append(path)
        except Exception as e:
            job.notes.append(str(e)[:500])

    def _one_by_one(self, job: Job, part: list[str]) -> None:
        """A batch that failed: each number by itself, and a record of what went wrong for those that fail again."""
        for number in part:
            alone = self.spark.createDataFrame([(number,)], "number string")
            try:
                found = records(self.fetch(alone)).toArrow()
            except Exception as e:
                told = str(e)
                kind = message_error(F.lit(told))
                empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in CASE_RECORDS.fields[1:-2]]
                found = alone.select("number", *empty, F.lit(f"Worker error: {told[:500]}").alias("error"), kind.alias("error_type")).toArrow()
            self.spark.createDataFrame(found.to_pandas().astype(object).where(lambda x: x.notna(), None).values.tolist(), CASE_RECORDS).coalesce(1).write.mode("append").parquet(job.path)

    def status(self, job_id: str) -> dict:
        with self.lock:
            return self.jobs[job_id].snapshot()

    def results(self, job_id: str, numbers: list[str] | None = None) -> DataFrame:
        """Records so far; for given numbers in their order."""
        job = self.jobs[job_id]
        if not job.done:
            raise LookupError("no results yet")
        found = self.spark.read.parquet(job.path)
        return found if numbers is None else in_input_order(self.spark.createDataFrame(list(enumerate(numbers)), "ordinal long, number string"), found)


def save_progress(results: DataFrame, total: int, path: str) -> None:
    """A small JSON file: numbers done, and the last 50 results (results has ordinal)."""
    done = [r.number for r in results.select("ordinal", "number").orderBy("ordinal").toLocalIterator()]
    last = [json.loads(x) for x in last_results(results).toJSON().toLocalIterator()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"), "processed_count": len(done), "total_count": total, "processed_numbers": done, "last_batch_results": last}, f, ensure_ascii=False)


def load_progress(path: str) -> tuple[list[str], int]:
    """(numbers done, total) of a progress file; nothing if it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        return list(saved["processed_numbers"]), int(saved["total_count"])
    except (OSError, ValueError, KeyError, TypeError):
        return [], 0


def resume(numbers: DataFrame, progress: str) -> DataFrame:
    """(ordinal, number) without those that a progress file has."""
    done, _ = load_progress(progress)
    return remaining(numbers, numbers.sparkSession.createDataFrame([(n,) for n in done], "number string"))


def statistics(results: DataFrame, seconds: list[float]) -> dict:
    """Outcome, errors by type, and speed of a job."""
    facts = outcome(results).first().asDict()
    total = facts["total"]
    average = sum(seconds) / max(1, total)
    return facts | {"error_types": {r.error_type: r.n for r in error_histogram(results).collect()}, "seconds": round(sum(seconds), 1), "seconds_per_case": round(average, 2), "cases_per_minute": round(60 / average, 1) if average else 0.0}


def report(facts: dict) -> str:
    """The statistics as text."""
    lines = [f"Total processed: {facts['total']}", f"Successful: {facts['successful']} ({facts['success_percent']}%)", f"Errors: {facts['errors']} ({facts['error_percent']}%)"]
    lines += [f"  {kind.replace('_', ' ').title()}: {n}" for kind, n in sorted(facts["error_types"].items())]
    return "\n".join([*lines, f"Seconds per case: {facts['seconds_per_case']}", f"Cases per minute: {facts['cases_per_minute']}"])


def numbered(rows: DataFrame, value: Column, key: Column, descending: bool = False, parts: int | None = None) -> DataFrame:
    """All rows with ``ordinal``: from 0 by a value (nulls last), ties by a key of any type; a value of most rows is spread by the key."""
    keyed = rows.withColumns({"_value": value, "_key": key})
    by = F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_last()
    return ordinals(keyed, [by, F.col("_key").asc_nulls_last()], "ordinal", parts).drop("_value", "_key")
