"""Case records and extraction jobs."""

from pyspark.sql import functions as F

from foliant.functions.html import read_page
from foliant.operators import extract, jobs
from foliant.sinks.export import record_lines

PAGE = """<html><span id="classeProcesso"> Execução Fiscal </span><span id="assuntoProcesso">ISS</span>
<div id="dataHoraDistribuicaoProcesso">15/01/2024 às 10:00 - Livre</div>
<div id="valorAcaoProcesso">R$    1.234,56</div><td class="dataMovimentacao"> 01/02/2024 </td>
<span id="labelSituacaoProcesso" class="unj-tag">Extinto</span>
<td class="nomeParteEAdvogado">Autor Exemplo
  Advogado: X</td><td class="nomeParteEAdvogado">Réu Exemplo
  Advogado: Y</td></html>"""
N = "1234567-89.2023.8.26.0001"


def test_records(spark):
    one_party = PAGE.split('<td class="nomeParteEAdvogado">Réu')[0]
    rows = {r.number: r for r in extract.records(spark.createDataFrame([
        (N, PAGE), ("1234567-89.2023.8.26.0002", PAGE.replace("Extinto", "Segredo de Justiça")), ("1234567-89.2023.8.26.0003", one_party), ("1234567-89.2023.8.26.0004", "<p>Processo não encontrado</p>"),
        ("1234567-89.2023.8.26.0005", "<p>vazio</p>"), ("1234567-89.2023.8.26.1", PAGE), ("1234567-89.2023.8.26.0006", None),
    ], "number string, html string")).collect()}
    r = rows[N]
    assert (r.initial_date, r.class_type, r.subject, r.value, r.last_movement, r.status, r.plaintiff, r.defendant, r.error) == ("15/01/2024", "Execução Fiscal", "ISS", "R$ 1.234,56", "01/02/2024", "Extinto", "Autor Exemplo", "Réu Exemplo", None)
    kinds = {k[-1]: v.error_type for k, v in rows.items()}
    assert kinds == {"1": "format_error", "2": "confidential", "3": None, "4": "not_found", "5": "no_data", "6": "no_data"} | {"1": kinds["1"]}
    sealed = rows["1234567-89.2023.8.26.0002"]
    assert sealed.error == "Segredo de justiça" and sealed.class_type is None
    assert rows["1234567-89.2023.8.26.0003"].plaintiff is None and rows["1234567-89.2023.8.26.1"].error_type == "format_error"


def test_reader_survives_open_tags():
    assert read_page('<span id="classeProcesso">A<b>B')["class_type"] == "AB"
    assert read_page("")["class_type"] is None


def test_order_and_outcome(spark):
    numbers = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "ordinal long, number string")
    found = spark.createDataFrame([("a", "x", None, None), ("b", None, "Erro do sistema", "system_error")], "number string, status string, error string, error_type string")
    back = extract.in_input_order(numbers, found).collect()
    assert [(r.number, r.error) for r in back] == [("b", "Erro do sistema"), ("a", None), ("b", "Erro do sistema"), ("c", "No result returned")]
    facts = extract.outcome(found).first()
    assert (facts.total, facts.successful, facts.errors, facts.error_percent) == (2, 1, 1, 50.0)
    assert [(r.error_type, r.n) for r in extract.error_histogram(found).collect()] == [("system_error", 1)]
    assert extract.outcome(found.limit(0)).first().success_percent == 0.0


def test_other_processes_and_sorting(spark):
    columns = "number string, defendant string, value string, other_processes int, error string"
    rows = spark.createDataFrame([("1", "X", "R$ 10,00", None, None), ("2", "X", None, None, None), ("3", "Y", "R$ 9,50", None, "bad")], columns)
    counted = {r.number: r.other_processes for r in extract.with_other_processes(rows).collect()}
    assert counted == {"1": 2, "2": 2, "3": None}
    for down, want in ((False, ["3", "1", "2"]), (True, ["1", "3", "2"])):
        assert [r.number for r in extract.sorted_records(rows, "value", down).collect()] == want


def test_jobs(spark, tmp_path):
    fetched = []

    def fetch(numbers):
        fetched.append(numbers.count())
        return numbers.withColumn("html", F.when(F.col("number") == N, F.lit(PAGE)))

    registry = jobs.JobRegistry(spark, str(tmp_path), fetch, batch_size=2)
    asked = [N, "1234567-89.2023.8.26.0002", N, "x"]
    job = registry.start(asked, wait=True)
    status = registry.status(job)
    assert (status["status"], status["done"], status["percent"]) == ("done", 4, 100) and fetched == [2, 1]
    rows = registry.results(job, asked).collect()
    assert [r.number for r in rows] == asked and rows[0].class_type == rows[2].class_type == "Execução Fiscal" and rows[3].error_type == "format_error"
    results = registry.results(job, asked)
    path = str(tmp_path / "progress.json")
    jobs.save_progress(results, 5, path)
    assert jobs.load_progress(path) == (asked, 5) and jobs.load_progress(path + "x") == ([], 0)
    more = spark.createDataFrame([(0, N), (1, "new")], "ordinal long, number string")
    assert [r.number for r in jobs.resume(more, path).collect()] == ["new"]
    facts = jobs.statistics(results, [2.0])
    assert facts["total"] == 4 and facts["seconds_per_case"] == 0.5 and "Format Error" in jobs.report(facts)
    assert next(record_lines(registry.results(job), mark=True)).startswith("﻿Number,Initial Date")
    failing = jobs.JobRegistry(spark, str(tmp_path), lambda df: 1 / 0)
    assert failing.status(failing.start(["x"], wait=True))["status"] == "error"


def test_message_errors(spark):
    df = spark.createDataFrame([("Timed out",), ("element click intercepted",), ("DNS failure",), ("processo sigiloso",), ("?",)], "m string")
    assert [r[0] for r in df.select(extract.message_error(F.col("m"))).collect()] == ["timeout", "ui_interception", "browser_error", "confidential", "unknown"]


def test_places_of_all_rows(spark):
    rows = spark.createDataFrame([(k, None if k % 4 == 0 else float(k * 7 % 5)) for k in range(200)], "number long, value double").repartition(5)
    want = sorted(range(200), key=lambda k: (k % 4 == 0, -(k * 7 % 5) if k % 4 else 0, k))
    for parts in (2, 64):
        got = jobs.numbered(rows, F.col("value"), F.col("number"), descending=True, parts=parts).orderBy("ordinal").collect()
        assert [(r.ordinal, r.number) for r in got] == list(enumerate(want))
    assert jobs.numbered(rows.limit(0), F.col("value"), F.col("number")).count() == 0


def test_one_failing_fetch_leaves_the_others(spark, tmp_path):
    def fetch(numbers):
        failing = F.when(F.col("number") == "0000002-01.2020.8.26.0001", F.raise_error(F.lit("Connection reset")).cast("string"))
        return numbers.select("number", F.coalesce(failing, F.lit(PAGE)).alias("html"))

    registry = jobs.JobRegistry(spark, str(tmp_path), fetch, batch_size=2)
    asked = [f"000000{k}-01.2020.8.26.0001" for k in (1, 2, 3)]
    job = registry.start(asked, 1, wait=True)
    assert registry.status(job)["status"] == "done" and registry.status(job)["done"] == 3
    rows = registry.results(job, asked).collect()
    assert [r.class_type for r in rows] == ["Execução Fiscal", None, "Execução Fiscal"]
    assert rows[1].error.startswith("Worker error: ") and rows[1].error_type == "browser_error"


def test_snapshots_of_a_long_extraction(spark, tmp_path):
    from foliant.sinks.export_source import read_export

    registry = jobs.JobRegistry(spark, str(tmp_path), lambda numbers: numbers.withColumn("html", F.lit(PAGE)), batch_size=1, snapshot_every=2)
    asked = [f"000000{k}-01.2020.8.26.0001" for k in (3, 1, 2, 3, 5)]
    job = registry.jobs[registry.start(asked, 1, wait=True)]
    assert job.status == "done" and job.done == 5 and not job.notes and len(job.snapshots) == 2
    assert [sorted(r.number for r in read_export(spark, path).collect()) for path in job.snapshots] == [sorted(asked[:2]), sorted(set(asked))]


def test_places_of_records(spark):
    rows = spark.createDataFrame([("1", "R$ 10,50", "b"), ("2", None, ""), ("3", "R$ 9", "A"), ("4", "R$ 10,50", None)], "number string, value string, class_type string")
    placed = lambda *a: [r.number for r in extract.placed_records(rows, *a).orderBy("place").collect()]
    assert placed("value") == ["3", "1", "4", "2"] and placed("value", True) == ["1", "4", "3", "2"] and placed("class_type") == ["3", "1", "2", "4"]
    assert [r.number for r in extract.sorted_records(rows, "value", True).collect()] == placed("value", True)
