"""Search over a small corpus with known answers."""

import csv
import datetime
import io
import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import corpus, search
from foliant.plans.filters import exclusion_terms, parse_date
from foliant.sinks.export import csv_lines, json_response, write_csv
from foliant.sources.casefile import listed_numbers, numbers_in_csv, read_case_numbers

A, B, C = "1234567-89.2023.8.26.0001", "7654321-00.2022.8.26.0100", "0000001-11.2021.8.26.0002"
ROWS = [
    (0, A, f"Processo {A} Penhora SISBAJUD realizada", "20231228_a.pdf", "2023-12-28", "legal_documents_2023"),
    (1, A, f"Processo {A} bloqueio BACENJUD e penhora online", "20240304_a.pdf", "2024-03-04", "legal_documents_2024_1"),
    (2, B, f"Processo {B} Segredo de Justiça decretado", "20240304_b.pdf", "2024-03-04", "legal_documents_2024_1"),
    (3, B, f"Processo {B} justica gratuita concedida", "20240801_b.pdf", "2024-08-01", "legal_documents_2024_2"),
    (4, C, f"Processo {C} penhorado o bem; execução fiscal", "20240701_c.pdf", "2024-07-01", "legal_documents_2024_2"),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, n, t, p, datetime.date.fromisoformat(d), s) for i, n, t, p, d, s in ROWS], "id long, process_number string, content string, file_path string, document_date date, db_id string")
    return df.persist()


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("words, want", [("penhora", [0, 1]), ("PENHORA", [0, 1]), ("justica", [2, 3]), ("penh*", [0, 1, 4]), ('"segredo de justica"', [2]), ("penhora sisbajud", [0]), ("sisbajud or bacenjud", [0, 1]), ("penhora NOT sisbajud", [1]), ("penhora NOT sisbajud OR justica", [1, 2, 3]), ("penhora OR justica AND segredo", [0, 1, 2]), ("(sisbajud OR bacenjud) AND penhora", [0, 1]), (f'"{A}"', [0, 1])])
def test_keywords(rows, words, want):
    assert ids(search.matches(rows, words)) == want


def test_conditions(rows):
    assert ids(search.matches(rows, process_number="4321")) == [2, 3]
    assert ids(search.matches(rows, process_number="1234567_89.2023%")) == [0, 1]
    assert ids(search.matches(rows, start="2024-01-01", end="2024-06-30", shards=corpus.manifest(rows))) == [1, 2]
    assert ids(search.matches(rows, start=" ", end=None)) == [0, 1, 2, 3, 4]
    assert [r.db_id for r in corpus.relevant_shards(corpus.manifest(rows), "2024-01-01", "2024-06-30").collect()] == ["legal_documents_2024_1"]
    with pytest.raises(ValueError):
        parse_date("2024")


@pytest.mark.parametrize("words, exclusion, want", [(None, "bacenjud", {B, C}), ("sisbajud", "bacenjud", {A}), (None, "penh", {B}), (None, "justiça", {A, C}), (None, '""', set()), (None, "  ", {A, B, C})])
def test_exclusion(rows, words, exclusion, want):
    found = search.matches(rows, words)
    assert {r.process_number for r in search.cases(found, exclusion).collect()} == want
    left = search.without_excluded(found, exclusion)
    assert {r.process_number for r in left.collect()} == want
    assert ids(search.without_excluded(left, exclusion)) == ids(left)


@pytest.mark.parametrize("text, want", [('foo "bar baz" Qux', ["foo", "bar baz", "qux"]), ('foo"bar baz" q', ['foo"bar', 'baz"', "q"]), ('"" x', ["", "x"]), ('"a b', ['"a', "b"])])
def test_exclusion_terms(text, want):
    assert exclusion_terms(text) == want


def test_pages(rows):
    full = search.search(rows, page_size=None)
    assert [r.process_number for r in full.results.collect()] == [B, C, A]
    parts = [search.search(rows, page=p, page_size=2) for p in (1, 2, 9)]
    assert [[r.process_number for r in p.results.collect()] for p in parts] == [[B, C], [A], []]
    assert {p.total_processes for p in parts} == {3}
    assert [m.document_date.isoformat() for m in full.results.first().mentions] == ["2024-08-01", "2024-03-04"]
    assert ids(search.newest_per_case(search.matches(rows), 1)) == [1, 3, 4]
    assert search.total_pages(0) == 1 and search.total_pages(201) == 3
    for bad in ({"page": 0}, {"page_size": 0}, {"page_size": 501}):
        with pytest.raises(ValueError):
            search.page_of(search.cases(search.matches(rows)), **bad)


def test_null_dates_come_last(spark, rows):
    more = rows.union(spark.createDataFrame([(9, "9999999-00.2022.8.26.0100", "x", "p", None, "s")], rows.schema))
    page = search.search(more, page_size=None)
    assert [r.process_number for r in page.results.collect()][-1].startswith("9999999")


def test_deadline(rows):
    in_time = search.search(rows, "penhora", deadline_seconds=60)
    assert not in_time.truncated and in_time.total_processes == 1
    late = search.search(rows, "penhora", deadline_seconds=0)
    assert late.truncated and late.total_processes == 0


def test_errors(rows):
    assert search.search(rows, "(penhora", on_error="empty").total_processes == 0
    with pytest.raises(ValueError):
        search.search(rows, "(penhora")


def test_summary_and_export(spark, rows, tmp_path):
    facts = search.summary(rows).first()
    assert (facts.total_processes, facts.total_mentions, str(facts.earliest), str(facts.latest)) == (3, 5, "2023-12-28", "2024-08-01")
    lines = list(csv.reader(io.StringIO("".join(csv_lines(search.matches(rows, "penhora"), parameters={"Keywords": "penhora", "Empty": ""})))))
    assert lines[:9] == [["=== Search Results Summary ==="], ["=== Search Parameters ==="], ["Keywords", "penhora"], [""], ["Total Processes", "1"], ["Total Mentions", "2"], ["Date Range", "2023-12-28 to 2024-03-04"], ["=== Database Distribution ==="], ["Database legal_documents_2023", "1"]]
    assert [x[1] for x in lines[-2:]] == ["1/2", "2/2"]
    write_csv(rows, str(tmp_path / "out.csv"))
    assert {r.number for r in read_case_numbers(spark, str(tmp_path / "out.csv")).collect()} == {A, B, C}
    answer = json.loads(json_response(search.search(rows, page_size=2)))
    assert answer["total_processes"] == 3 and len(answer["results"]) == 2 and answer["results"][0]["mentions"][0]["document_date"] == "2024-08-01"


def test_case_numbers_from_files(spark):
    assert numbers_in_csv(f"a;b\n{A},x\n{B} {A}\n".encode()) == [A, B]
    assert numbers_in_csv(("﻿Keywords,x\nid,Process Number (main)\n1,%s\n2,none\n" % A).encode()) == [A]
    typed = spark.createDataFrame([(f" {A} \n\nx\n{B}",)], "t string")
    assert [r.number for r in listed_numbers(typed, F.col("t")).collect()] == [A, "x", B]
    assert [r.number for r in listed_numbers(typed, F.col("t"), strict=True).collect()] == [A, B]


def test_corpus_on_disk(spark, rows, tmp_path):
    corpus.write(rows, str(tmp_path / "c"))
    back = corpus.load(spark, str(tmp_path / "c"))
    assert ids(search.matches(back, "penhora", start="2024-01-01", shards=corpus.manifest(back))) == [1]
    plan = search.matches(back, start="2024-01-01", end="2024-06-30", shards=corpus.manifest(back))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "legal_documents_2024_1" in plan
    stats = {r.db_id: (r.total_entries, r.unique_processes) for r in corpus.shard_statistics(back).collect()}
    assert stats["legal_documents_2024_1"] == (2, 2)


def test_text_is_normalized_once_for_several_phrases(rows):
    plan = search.matches(rows, "(penhora OR x) AND (y NOT z)")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_page_buttons(spark):
    shown = spark.createDataFrame([(1, 1), (1, 9), (2, 9), (5, 9), (9, 9)], "page long, pages long")
    assert [r[0] for r in shown.select(search.page_buttons(F.col("page"), F.col("pages"))).collect()] == [[1], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [3, 4, 5, 6, 7], [7, 8, 9]]
    assert [r[0] for r in spark.createDataFrame([(0,), (201,)], "n long").select(search.pages_of(F.col("n"), F.lit(100))).collect()] == [1, 3]
