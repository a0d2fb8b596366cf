"""Command line: search, count, export and extract over a corpus folder.

    python -m foliant.cli search CORPUS --keywords "penhora NOT sisbajud" --start 2024-01-01 --csv out.csv
    python -m foliant.cli stats CORPUS
    python -m foliant.cli numbers FILE.csv
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import corpus, search
from .plans.keywords import QuerySyntaxError
from .sinks.export import json_response, write_csv
from .sources.casefile import read_case_numbers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="foliant")
    commands = out.add_subparsers(dest="command", required=True)
    s = commands.add_parser("search", help="cases with matching mentions, newest first")
    s.add_argument("corpus")
    for name in ("keywords", "process-number", "start", "end", "exclusion", "csv"):
        s.add_argument(f"--{name}")
    s.add_argument("--page", type=int, default=1)
    s.add_argument("--page-size", type=int, help="all cases without it")
    s.add_argument("--deadline", type=float)
    commands.add_parser("stats", help="rows, cases and dates of each shard").add_argument("corpus")
    commands.add_parser("numbers", help="case numbers in CSV files").add_argument("path")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    if given.command == "numbers":
        for row in read_case_numbers(spark, given.path).orderBy("number").toLocalIterator():
            print(row.number)
        return 0
    paragraphs = corpus.load(spark, given.corpus)
    shards = corpus.manifest(paragraphs)
    if given.command == "stats":
        corpus.shard_statistics(paragraphs).orderBy("db_id").show(1000, truncate=False)
        corpus.corpus_statistics(shards).show()
        return 0
    conditions = dict(keywords=given.keywords, process_number=given.process_number, start=given.start, end=given.end)
    try:
        if given.csv:
            found = search.without_excluded(search.matches(paragraphs, shards=shards, **conditions), given.exclusion)
            write_csv(found, given.csv, parameters={k.replace("_", " ").title(): v for k, v in (conditions | {"exclusion": given.exclusion}).items()})
        else:
            print(json_response(search.search(paragraphs, **conditions, exclusion=given.exclusion, page=given.page, page_size=given.page_size, shards=shards, deadline_seconds=given.deadline)))
    except (QuerySyntaxError, ValueError) as e:
        print(f"error: {e}")
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
