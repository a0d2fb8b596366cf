"""Requests and the command line."""

import datetime
import json

import pytest

from foliant import cli
from foliant.api import Service
from foliant.operators import corpus
from foliant.operators.jobs import JobRegistry

N = "1234567-89.2023.8.26.0001"


@pytest.fixture(scope="module")
def rows(spark):
    day = datetime.date(2024, 1, 2)
    return spark.createDataFrame([(1, N, "penhora online", "f", day, "s1"), (2, N, "outra coisa", "f", day + datetime.timedelta(9), "s2")], "id long, process_number string, content string, file_path string, document_date date, db_id string").persist()


def test_requests(spark, rows, tmp_path):
    service = Service(rows, JobRegistry(spark, str(tmp_path), lambda df: df.selectExpr("number", "'' as html")), key="k", deadline=None)
    key = {"X-API-Key": "k"}
    assert service.search({}, {})[0] == 403 and Service(rows).search(key, {})[0] == 500
    status, headers, body = service.search(key, {"keywords": "penhora", "page_size": "10"})
    assert status == 200 and "X-Truncated" not in headers and json.loads(body)["results"][0]["mention_count"] == 1
    assert [service.search(key, bad)[0] for bad in ({"page": "0"}, {"page_size": "501"}, {"start_date": "2024"}, {"page": "x"})] == [422] * 4
    assert json.loads(service.search(key, {"keywords": "(("})[2])["total_processes"] == 0
    assert service.export(key, {})[2].splitlines()[1].startswith(f"{N},1/2,2024-01-11")
    late = Service(rows, key="k", deadline=0).search(key, {})
    assert late[1]["X-Truncated"] == "true" and json.loads(late[2])["truncated"]
    assert json.loads(service.stats(key)[2])["databases"]["s1"] == "2024-01-02 to 2024-01-02"
    assert service.start_extraction(key, [])[0] == 422 and service.extraction_status(key, "?")[0] == 404 and service.extraction_export(key, "?")[0] == 404
    job = service.jobs.start([N], wait=True)
    assert json.loads(service.extraction_status(key, job)[2])["status"] == "done" and N in service.extraction_export(key, job)[2]


def test_command_line(spark, rows, tmp_path, capsys):
    corpus.write(rows, str(tmp_path / "c"))
    assert cli.main(["search", str(tmp_path / "c"), "--keywords", "penhora"], spark) == 0
    assert json.loads(capsys.readouterr().out)["total_processes"] == 1
    assert cli.main(["search", str(tmp_path / "c"), "--keywords", "((", "--csv", "x"], spark) == 2
    out = str(tmp_path / "o.csv")
    assert cli.main(["search", str(tmp_path / "c"), "--csv", out], spark) == 0 and "Date Range,2024-01-02 to 2024-01-11" in open(out).read()
    capsys.readouterr()
    assert cli.main(["numbers", out], spark) == 0 and capsys.readouterr().out.split() == [N]
    assert cli.main(["stats", str(tmp_path / "c")], spark) == 0 and "s2" in capsys.readouterr().out


@pytest.mark.parametrize("name", ["json_pages", "search_before_deadline"])
def test_cases_of_many_mentions_have_one_row(spark, tmp_path, name):
    from foliant.queries import queries

    ids = [case + 251 * k for case in range(12) for k in range(500)]  # more mentions of a case than a row of a nested result has
    docs = spark.createDataFrame([(i, "the text", "de", "s") for i in ids], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries()[name](spark, str(tmp_path)).collect()
    assert len(found) == len({r.process_number for r in found}) == (5 if name == "json_pages" else 10)
