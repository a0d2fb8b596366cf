"""Queries for case records, lists of numbers, exports, requests and upkeep, and the same in DuckDB's SQL."""

from __future__ import annotations

import csv
import io
import json
import os
import sqlite3
import uuid
import zlib
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Service
from .functions import text as fn
from .functions.blobs import compress_content, decompress_content
from .operators import calendar, corpus, extract, ingest, jobs, maintain, search
from .queries import _GAZETTE, P, paragraphs, query, stored_paragraphs, table
from .schema import CASE_RECORDS
from .sinks.export import json_page, preamble
from .sources.casefile import csv_case_numbers, listed_numbers
from .sources.shards import read_shards
from .storage import scratch


def _padded(c: Column) -> Column:
    return F.concat(F.lpad(c.cast("string"), 7, "0"), F.lit("-01.2020.8.26.0001"))


_NUMBER = "concat(lpad(cast({} as varchar),7,'0'),'-01.2020.8.26.0001')"

_PAGES = """<html><td class="dataMovimentacao"> 01/02/2022
</td><div id=dataHoraDistribuicaoProcesso>05/03/2021 às 10:20</div><span id="classeProcesso">Ação Penal</span><span class=x id="assuntoProcesso"> Furto &amp; {lang} </span>
<div id="valorAcaoProcesso">R$    {doc_id},50</div><span id="labelSituacaoProcesso">Em <b>andamento</b></span><table><tr><td class="nomeParteEAdvogado">Autor {source}
Advogado</td></tr><tr><td class="label nomeParteEAdvogado">Réu {lang}</td></tr></table>"""


def _case_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every document: whole, sealed, not found, empty, with few fields, or for a bad number."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 6
    full = F.lit(_PAGES)
    for name in ("lang", "source", "doc_id"):
        full = F.replace(full, F.lit("{" + name + "}"), F.col(name).cast("string"))
    html = F.when(k.isin(0, 5), full).when(k == 1, '<span id="labelSituacaoProcesso">SEGREDO de Justiça</span>').when(k == 2, "<p>Processo não encontrado</p>").when(k == 3, "<p>leer</p>")
    html = html.otherwise('<span id="classeProcesso">Ação Penal</span><td class="nomeParteEAdvogado">allein</td><div id="valorAcaoProcesso"> </div>')
    return d.select(F.when(k == 5, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(_padded(F.col("doc_id"))).alias("number"), html.alias("html"))


@query(f"""with d as (select *, doc_id % 6 as k from documents)
select case when k = 5 then concat('x', cast(doc_id as varchar)) else {_NUMBER.format('doc_id')} end as number, case when k = 0 then '05/03/2021' end as initial_date, case when k in (0, 4) then 'Ação Penal' end as class_type,
case when k = 0 then concat('Furto & ', lang) end as subject, case when k = 0 then concat('R$ ', cast(doc_id as varchar), ',50') end as value, case when k = 0 then '01/02/2022' end as last_movement, case when k = 0 then 'Em andamento' end as status,
case when k = 0 then concat('Autor ', source) end as plaintiff, case when k = 0 then concat('Réu ', lang) end as defendant, case when k = 0 then cast(count(*) over (partition by k, lang) as integer) else -1 end as other_processes,
case k when 1 then 'Segredo de justiça' when 2 then 'Processo não encontrado' when 3 then 'Nenhum dado encontrado na página' when 5 then 'Invalid process number; expected NNNNNNN-DD.AAAA.J.TR.OOOO' end as error,
case k when 1 then 'confidential' when 2 then 'not_found' when 3 then 'no_data' when 5 then 'format_error' end as error_type from d""")  # fmt: skip
def case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_other_processes(extract.records(_case_pages(spark, sf_dir))).fillna(-1, "other_processes")


_WORDS = " when ".join(f"({' or '.join(f"contains(l, '{w}')" for w in words)}) then '{{}}'".replace("{}", kind) for kind, _, words in [(k, m, tuple(w.lower() for w in ws)) for k, m, ws in extract.PAGE_ERRORS])


@query(f"with c as (select conv_id, turn, lower(concat(case turn % 5 when 0 then 'Acesso Negado ' when 1 then 'Registro NÃO EXISTE ' when 2 then 'Erro interno; ' else '' end, text)) as l from conversations) select conv_id, turn, case when {_WORDS} end as error_type from c")
def page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("turn") % 5
    page = F.concat(F.when(kind == 0, "Acesso Negado ").when(kind == 1, "Registro NÃO EXISTE ").when(kind == 2, "Erro interno; ").otherwise(""), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", extract.page_error(page)["error_type"].alias("error_type"))


@query(f"""with d as (select doc_id, cast(floor(doc_id / 50) as bigint) % 3 = 0 as plain from documents)
select {_NUMBER.format('doc_id')} as number from d union select {_NUMBER.format('doc_id + 1')} from d
union select '0000001-77.2020.8.26.0001' from d where plain union select '9999999-99.2020.8.26.0001' from d where plain""")  # fmt: skip
def case_numbers_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of 50 rows with lines before the header; every third has no such heading and is searched whole."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 50).alias("file"))
    row = F.concat(F.lit("x,"), _padded(F.col("doc_id")), F.lit(" e "), _padded(F.col("doc_id") + 1), F.lit(',"nicht 9999999-99.2020.8.26.0001, zitiert"'))
    heads = F.when(F.col("file") % 3 == 0, "a,b,c").otherwise("Nr,Old Process Number,Content")
    files = d.groupBy("file").agg(F.array_join(F.collect_list(row), "\r\n").alias("rows"))
    return csv_case_numbers(files.select(F.concat(F.lit("﻿=== Summary ===\n\"0000001-77.2020.8.26.0001\"\n"), heads, F.lit("\r\n"), F.col("rows")).cast("binary").alias("content")))


@query(f"select {_NUMBER.format('conv_id')} as number from conversations")
def typed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return listed_numbers(c, F.concat(F.lit("\n  "), _padded(F.col("conv_id")), F.lit("\t\r\n\n"), F.col("turn").cast("string"), F.lit("\n")), strict=True)


@query("select doc_id as id, md5(text) as digest, md5(text) as plain_digest from documents")
def content_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents packed and unpacked, and contents that were never packed."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.md5(decompress_content(compress_content(F.col("text")))).alias("digest"), F.md5(decompress_content(F.col("text").cast("binary"))).alias("plain_digest"))


@query(P + " select distinct db_id, cast(year(document_date) as integer) as year from p")
def shard_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("db_id", fn.shard_year(F.col("db_id")).alias("year")).distinct()


@query(P + """, m as (select * from p where contains(n,' worthless ')), s as (select db_id, count(*) as c, row_number() over (order by db_id) as r from m group by 1), f as (select count(distinct process_number) as a, count(*) as b, min(document_date) as c, max(document_date) as d from m)
select cast(place as bigint) as place, line from (select 1 as place, '=== Search Results Summary ===' as line union all select 2, '=== Search Parameters ===' union all select 3, 'keywords,worthless' union all select 4, 'page,1' union all select 5, ''
union all select 6, concat('Total Processes,', cast(a as varchar)) from f union all select 7, concat('Total Mentions,', cast(b as varchar)) from f union all select 8, concat('Date Range,', cast(c as varchar), ' to ', cast(d as varchar)) from f
union all select 9, '=== Database Distribution ===' union all select 9 + r, concat('Database ', db_id, ',', cast(c as varchar)) from s union all select 10 + count(*), '' from s)""")  # fmt: skip
def export_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.matches(paragraphs(spark, sf_dir), "worthless")
    lines = preamble(found, {"keywords": "worthless", "process_number": "", "start_date": None, "page": 1})
    return spark.createDataFrame([(k, ",".join(map(str, cells))) for k, cells in enumerate(lines, 1)], "place long, line string")


_PAGE = P + """, m as (select *, row_number() over (partition by process_number order by document_date desc, db_id, id) as r from p where contains(n,' the ')),
k as (select process_number, count(*) as c, max(document_date) as last_date from m group by 1 order by 3 desc, 1 limit 5 offset 5)"""


@query(_PAGE + " select process_number, cast(c as integer) as mention_count, db_id, md5(content) as digest from k join m using (process_number) where r = 1")
def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = json_page(search.search(paragraphs(spark, sf_dir), "the", page=2, page_size=5)).where("part = 0")  # begins with the newest mention
    part = lambda path: F.get_json_object("json", path)
    return found.select(part("$.process_number").alias("process_number"), part("$.mention_count").cast("int").alias("mention_count"), part("$.mentions[0].db_id").alias("db_id"), F.md5(part("$.mentions[0].content")).alias("digest"))


@query(_PAGE + " select 200 as status, (select count(distinct process_number) from m) as total_processes, process_number, c as mention_count from k")
def request_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = Service(paragraphs(spark, sf_dir), key="k", deadline=None)
    status, _, body = service.search({"X-API-Key": "k"}, {"keywords": " the ", "page": "2", "page_size": "5"})
    answer = json.loads(body)
    return spark.createDataFrame([(status, answer["total_processes"], r["process_number"], r["mention_count"]) for r in answer["results"]], "status int, total_processes long, process_number string, mention_count long")


@query(_PAGE + " select process_number, concat(cast(r as varchar), '/', cast(c as varchar)) as label, cast(document_date as varchar) as document_date, db_id, file_path, md5(content) as digest from k join m using (process_number)")
def request_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = Service(paragraphs(spark, sf_dir), key="k", deadline=None)
    _, _, body = service.export({"X-API-Key": "k"}, {"keywords": "the", "page": "2", "page_size": "5"})
    rows = list(csv.reader(io.StringIO(body, newline="")))[1:]
    return spark.createDataFrame(rows, "process_number string, label string, document_date string, db_id string, file_path string, content string").select("process_number", "label", "document_date", "db_id", "file_path", F.md5("content").alias("digest"))


@query(P + " select db_id, concat(cast(min(document_date) as varchar), ' to ', cast(max(document_date) as varchar)) as date_range from p group by 1")
def request_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, body = Service(paragraphs(spark, sf_dir), key="k").stats({"X-API-Key": "k"})
    return spark.createDataFrame(list(json.loads(body)["databases"].items()), "db_id string, date_range string")


@query("select * from (values ('no key', 500), ('wrong key', 403), ('page 0', 422), ('size 501', 422), ('bad date', 422), ('unknown job', 404), ('no numbers', 422), ('9 at once', 422)) v(request, status)")
def request_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, right = paragraphs(spark, sf_dir), {"X-API-Key": "k"}
    service = Service(p, jobs.JobRegistry(spark, scratch(spark, "jobs"), lambda numbers: numbers), "k")
    answers = [
        ("no key", Service(p).search(right, {})), ("wrong key", service.search({"X-API-Key": "x"}, {})), ("page 0", service.search(right, {"page": "-1"})), ("size 501", service.search(right, {"page_size": "501"})),
        ("bad date", service.search(right, {"start_date": "01/02/2020"})), ("unknown job", service.extraction_status(right, "x")), ("no numbers", service.start_extraction(right, [])), ("9 at once", service.start_extraction(right, ["x"], 9)),
    ]
    return spark.createDataFrame([(name, status) for name, (status, _, _) in answers], "request string, status int")


@query(P + ", m as (select * from p where contains(n,' the ') and document_date >= date '2022-01-01') select process_number, count(*) as mention_count, max(document_date) as last_date, false as truncated from m group by 1 order by 3 desc, 1 limit 10")
def search_before_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard by shard under a deadline that is far away."""
    p = paragraphs(spark, sf_dir)
    page = search.search(p, "the", start="2022-01-01", page_size=10, shards=corpus.manifest(p), deadline_seconds=3600)
    return page.results.where("part = 0").select("process_number", F.col("mention_count").cast("long").alias("mention_count"), F.array_max("mentions.document_date").alias("last_date"), F.lit(page.truncated).alias("truncated"))


@query(P + " select id, db_id from p where contains(n,' the ') and document_date >= date '2020-02-01'")
def search_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matches(paragraphs(spark, sf_dir), "  the ", process_number="  ", start=" 2020-02-01 ", end=" ").select("id", "db_id")


@query(P + " select id, db_id, document_date from p where contains(n,' the ') and not contains(n,' scum ') and document_date between date '2020-02-01' and date '2021-06-30'")
def search_written_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over a stored corpus: dates choose partitions, normalized text is read and not made."""
    p = stored_paragraphs(spark, sf_dir)
    return search.matches(p, "the NOT scum", start="2020-02-01", end="2021-06-30", shards=corpus.manifest(p)).select("id", "db_id", "document_date")


@query("select event_id as ordinal, event_type from events order by event_id desc limit 50")
def last_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.last_results(table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), "event_type"))


@query("select user_id, cast(round(count(*) filter (where event_type <> 'error') / count(*) * 100) as integer) as percent from events group by 1")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("done"), F.count("*").alias("total"))
    return counts.select("user_id", jobs.percent_done(F.col("done"), F.col("total")).alias("percent"))


@query("""with c as (select count(*) as n, count(*) filter (where event_type <> 'error') as s, count(*) filter (where event_type = 'error') as e from events), t as (select event_type, count(*) as n, row_number() over (order by event_type) as r from events group by 1)
select cast(place as bigint) as place, line from (select 1 as place, concat('Total processed: ', cast(n as varchar)) as line from c union all select 2, concat('Successful: ', cast(s as varchar), ' (', cast(round(s / n * 100, 1) as varchar), '%)') from c
union all select 3, concat('Errors: ', cast(e as varchar), ' (', cast(round(e / n * 100, 1) as varchar), '%)') from c union all select 3 + r, concat('  ', upper(left(event_type, 1)), substring(event_type, 2), ': ', cast(n as varchar)) from t
union all select 4 + count(*), 'Seconds per case: 0.0' from t union all select 5 + count(*), 'Cases per minute: 0.0' from t)""")  # fmt: skip
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"), F.col("event_type").alias("error_type"))
    lines = jobs.report(jobs.statistics(results, [])).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "place long, line string")


@query("""select * from (values (0, '0000001-01.2020.8.26.0001', 'Em andamento', null, null), (1, 'x', null, 'Invalid process number; expected NNNNNNN-DD.AAAA.J.TR.OOOO', 'format_error'), (2, '0000002-01.2020.8.26.0001', null, 'Worker error', 'timeout'),
(3, '0000003-01.2020.8.26.0001', 'Em andamento', null, null), (4, '0000001-01.2020.8.26.0001', 'Em andamento', null, null)) v(ordinal, number, status, error, error_type)""")  # fmt: skip
def extraction_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose fetch fails for one number of a batch: the others are there, in the order they were asked for."""

    def fetch(numbers: DataFrame) -> DataFrame:
        failing = F.when(F.col("number").startswith("0000002"), F.raise_error(F.lit("page load timed out")).cast("string"))
        return numbers.select("number", F.coalesce(failing, F.lit('<span id="classeProcesso">c</span><span id="labelSituacaoProcesso">Em andamento</span>')).alias("html"))

    asked = [*(f"000000{k}-01.2020.8.26.0001" for k in (1,)), "x", *(f"000000{k}-01.2020.8.26.0001" for k in (2, 3, 1))]
    registry = jobs.JobRegistry(spark, scratch(spark, "jobs"), fetch, batch_size=3)
    found = registry.results(registry.start(asked, 1, wait=True), asked)
    return found.select(F.col("ordinal").cast("int").alias("ordinal"), "number", "status", F.regexp_replace("error", "(?s)^(Worker error):.*", "$1").alias("error"), "error_type")


@query("""with d as (select cast(unnest(generate_series(date '2024-01-01', date '2024-03-31', interval 1 day)) as date) as date),
b as (select * from (values ('Judicial_Capital_1'),('Judicial_Capital_2'),('Judicial_Interior_1'),('Judicial_Interior_2'),('Judicial_Interior_3')) v(booklet_name))
select date, concat(strftime(date,'%Y/%m/%Y%m%d'),'_',booklet_name,'.pdf') as path from d, b where isodow(date) < 6 and day(date) % 2 = 1""")  # fmt: skip
def download_plan_without_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = calendar.download_plan(spark, "2024-01-01", "2024-03-31", today="2024-12-31").where("day(date) % 2 = 0")
    return calendar.download_plan(spark, "2024-01-01", "2024-03-31", existing=there, today="2024-12-31").select("date", "path")


@query(P + " select db_id, count(*) as n_rows, count(distinct id) as distinct_ids, count(*) filter (where process_number is null or document_date is null or content is null) as incomplete from p group by 1")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.integrity(paragraphs(spark, sf_dir))


@query(P + """, k as (select db_id, content from (select *, row_number() over (partition by db_id, md5(content) order by id) as r from p) where r = 1),
a as (select db_id, count(*) as n, sum(length(content)) as c from p group by 1), b as (select db_id, count(*) as n, sum(length(content)) as c from k group by 1)
select db_id, a.n as rows_before, cast(a.c as bigint) as chars_before, b.n as rows_after, cast(b.c as bigint) as chars_after, round((1 - b.c / a.c) * 100, 2) as reduction_percent from a join b using (db_id)""")  # fmt: skip
def rewrite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    return maintain.rewrite_summary(p, maintain.keep_first(p))


@query(_GAZETTE + " select 'legal_documents_2020' as db_id, 2 * count(*) as n, cast(0 as bigint) as low, 2 * count(*) - 1 as high, 2 * count(*) as ids from raw")
def ingested_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazettes to paragraphs, whose ids are hashes, and these renumbered."""
    d = table(spark, sf_dir, "documents")
    number = lambda c, rest: F.concat(F.lit(" Processo "), F.lpad(c.cast("string"), 7, "0"), F.lit(rest))
    text = F.concat(F.col("text"), number(F.col("doc_id"), "-01.2020.8.26.0001 a"), number(F.col("doc_id") + 1, "-02.2021.8.26.0002 b"))
    files = d.select(F.concat(F.lit("2020/20200131_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), text.alias("text"))
    rows = maintain.renumbered(maintain.keep_first(ingest.paragraphs(files)))
    return rows.groupBy("db_id").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.countDistinct("id").alias("ids"))


@query(P + """, c as (select greatest(1, cast(ceil(count(distinct process_number) / 20) as bigint)) as pages from p) select page, pages, array_to_string(generate_series(greatest(1, page - 2), least(pages, greatest(1, page - 2) + 4)), ' ') as buttons
from c, (values (1), (2), (3), (5), (9)) v(page) where page <= pages""")  # fmt: skip
def page_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = paragraphs(spark, sf_dir).agg(F.countDistinct("process_number").alias("total"))
    shown = total.select(F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 9)))).alias("page"), search.pages_of(F.col("total"), F.lit(20)).alias("pages")).where("page <= pages")
    return shown.select("page", "pages", F.array_join(search.page_buttons(F.col("page"), F.col("pages")).cast("array<string>"), " ").alias("buttons"))


@query("select * from (values ('number', 'Number'), ('initial_date', 'Initial Date'), ('class_type', 'Class Type'), ('subject', 'Subject'), ('value', 'Value'), ('last_movement', 'Last Movement'), ('status', 'Status'), ('plaintiff', 'Plaintiff'), ('defendant', 'Defendant'), ('other_processes', 'Other Processes'), ('error', 'Error'), ('error_type', 'Error Type')) v(name, heading)")
def record_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f.name, fn.title(f.name)) for f in CASE_RECORDS.fields], "name string, heading string")


@query(P + " select id, md5(content) as digest from p where id % 3 <> 0")
def decodable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contents: packed, plain, and every third one broken."""
    p, kind = paragraphs(spark, sf_dir), F.col("id") % 3
    stored_as = F.when(kind == 0, F.unhex(F.lit("FFFE00C3"))).when(kind == 1, compress_content("content")).otherwise(F.col("content").cast("binary"))
    return maintain.decodable(p.withColumn("content", stored_as)).select("id", F.md5("content").alias("digest"))


@query(P + " select distinct file_path, true as processed from p")
def ledger_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ledger_rows(paragraphs(spark, sf_dir).select("file_path").distinct()).select("file_path", F.col("processed_date").isNotNull().alias("processed"))


@query(P + " select count(*) as n_rows, true as has_dates from p")
def analyzed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table of the corpus and what its statistics say of it."""
    name = "foliant_" + uuid.uuid4().hex
    try:
        paragraphs(spark, sf_dir).select("id", "process_number", "document_date").write.saveAsTable(name)
        maintain.analyze(spark, name)
        facts = [(maintain.known_rows(spark, name), "document_date" in spark.table(name).columns)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.createDataFrame(facts, "n_rows long, has_dates boolean")


@query("select * from (values ('legal_documents_2023', 2, 'Texto dois', date '2023-03-01'), ('legal_documents_2024', 1, 'Texto um', date '2024-02-01'), ('legal_documents_2024', 2, 'Texto dois', date '2024-03-01')) v(db_id, id, content, document_date)")
def sqlite_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two older shards of three rows, packed and plain contents, read from a date on; a file without the table is passed over."""
    folder = urlparse(scratch(spark, "shards")).path
    os.makedirs(folder)
    for year in (2023, 2024):
        with sqlite3.connect(f"{folder}/legal_documents_{year}.db") as db:
            db.execute("create table paragraphs (id integer primary key, process_number text, content blob, file_path text, document_date date)")
            texts = ["Texto zero", zlib.compress("Texto um".encode()), "Texto dois"]
            db.executemany("insert into paragraphs values (?, 'n', ?, 'p', ?)", [(k, t, f"{year}-0{k + 1}-01") for k, t in enumerate(texts)])
    sqlite3.connect(f"{folder}/other.db").close()
    rows = read_shards(spark, folder).where(F.col("document_date") >= F.lit("2023-02-15").cast("date")).where("id > 0")
    return rows.select("db_id", F.col("id").cast("int").alias("id"), "content", "document_date")
