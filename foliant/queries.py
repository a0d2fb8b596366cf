"""Queries over the test tables, and the same in DuckDB's SQL.

``documents`` stand for paragraphs: a case number, a date and a shard are derived from the id. Pages, conversations and events
stand for case pages, mentions and job progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fn
from .functions.html import pattern_field
from .operators import calendar, corpus, extract, ingest, jobs, maintain, search
from .operators.index import write_dictionary
from .operators.substrings import write_grams
from .schema import PARAGRAPHS
from .sinks.export import export_rows
from .sources.casefile import numbers_in
from .storage import scratch, small, state_of
from .streaming.ingest import event_counts

_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
_STORED: dict[tuple, str] = {}

P = r"""with raw as (
  select doc_id as id, concat(lpad(cast(doc_id%251 as varchar),7,'0'),'-',lpad(cast(doc_id%251%97 as varchar),2,'0'),'.',
    cast(2019+doc_id%251%6 as varchar),'.8.26.',lpad(cast(1+doc_id%251%40 as varchar),4,'0')) as process_number, text as content,
    cast(date '2019-01-01' + cast(doc_id*37%2190 as integer) as date) as document_date, source, lang from documents),
p as (select *, concat('legal_documents_', cast(year(document_date) as varchar)) as db_id, concat(strftime(document_date,'%Y%m%d'),'_',source,'.pdf') as file_path,
  ' '||trim(regexp_replace(strip_accents(lower(content)),'[^\p{L}\p{N}]+',' ','g'))||' ' as n from raw)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus paragraphs."""
    d, case = table(spark, sf_dir, "documents"), F.col("doc_id") % 251
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    number = F.concat(padded(case, 7), F.lit("-"), padded(case % 97, 2), F.lit("."), (2019 + case % 6).cast("string"), F.lit(".8.26."), padded(1 + case % 40, 4))
    rows = d.select(F.col("doc_id").alias("id"), number.alias("process_number"), F.col("text").alias("content"), F.date_add(F.lit("2019-01-01").cast("date"), (F.col("doc_id") * 37 % 2190).cast("int")).alias("document_date"), "source", "lang")
    return rows.withColumn("db_id", fn.shard_of(F.col("document_date"))).withColumn("file_path", F.concat(F.date_format("document_date", "yyyyMMdd"), F.lit("_"), F.col("source"), F.lit(".pdf")))


def stored_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs as a written corpus; written anew when the documents' files change."""
    key = (spark.sparkContext.applicationId, state_of(spark, f"{sf_dir.rstrip('/')}/documents.parquet"))
    if key not in _STORED:
        path = scratch(spark, "corpus")
        corpus.write(paragraphs(spark, sf_dir).select(*PARAGRAPHS.names), f"{path}/paragraphs")
        _STORED[key] = path
    return corpus.load(spark, f"{_STORED[key]}/paragraphs")


def stored_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The written corpus and its index of postings."""
    p = stored_paragraphs(spark, sf_dir)
    return p, _side(spark, sf_dir, "postings", lambda _, out: maintain.write_postings(p, out))


def _side(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str, str], None]) -> DataFrame:
    """A table beside the stored corpus, written when first asked for."""
    stored_paragraphs(spark, sf_dir)
    key = (spark.sparkContext.applicationId, state_of(spark, f"{sf_dir.rstrip('/')}/documents.parquet"))
    path = _STORED[key]
    if (key, name) not in _STORED:
        write(path, f"{path}/{name}")
        _STORED[key, name] = path
    return spark.read.parquet(f"{path}/{name}")


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index's dictionary."""
    _, index = stored_corpus(spark, sf_dir)
    return _side(spark, sf_dir, "dictionary", lambda _, out: write_dictionary(index, out))


def side_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored index's dictionary, and the trigrams of its tokens."""
    tokens = dictionary(spark, sf_dir)
    return tokens, _side(spark, sf_dir, "grams", lambda _, out: write_grams(tokens, "token", out))


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _REGISTRY.items() if sql}


def _search(keywords: str, where: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.matches(paragraphs(spark, sf_dir), keywords).select("id", "process_number", "document_date", "file_path", "db_id")

    return run, f"{P} select id, process_number, document_date, file_path, db_id from p where {where}"


_KEYWORDS = {
    "search_term": ("worthless", "contains(n,' worthless ')"),
    "search_and_or_not": ("(disgusting or pathetic) and the not scum", "(contains(n,' disgusting ') or contains(n,' pathetic ')) and (contains(n,' the ') and not contains(n,' scum '))"),
    "search_phrase": ('"of the" + "and"', "contains(n,' of the and ')"),
    "search_prefix": ("worth* OR sche*", "contains(n,' worth') or contains(n,' sche')"),
    "search_near": ("NEAR(the worthless, 3)", "regexp_matches(n,' the ([^ ]+ ){0,3}worthless ') or regexp_matches(n,' worthless ([^ ]+ ){0,3}the ')"),
    "search_accent_fold": ("für", "contains(n,' fur ')"),
    "search_implicit_and": ("the of worthless", "contains(n,' the ') and contains(n,' of ') and contains(n,' worthless ')"),
    "search_not_left_associative": ("the NOT scum NOT trash OR clown", "(contains(n,' the ') and not contains(n,' scum ') and not contains(n,' trash ')) or contains(n,' clown ')"),
}
for _name, (_words, _where) in _KEYWORDS.items():
    _REGISTRY[_name] = _search(_words, _where)


@query(P + " select id, process_number from p where process_number ilike '%8.26.0007%'")
def search_process_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matches(paragraphs(spark, sf_dir), process_number="8.26.0007").select("id", "process_number")


@query(P + " select id, document_date, db_id from p where document_date between date '2020-02-01' and date '2021-06-30'")
def search_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    return search.matches(p, start="2020-02-01", end="2021-06-30", shards=corpus.manifest(p)).select("id", "document_date", "db_id")


@query(P + " select count(*) as n, min(id) as low, max(id) as high from p")
def search_without_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matches(paragraphs(spark, sf_dir)).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@query(P + " select process_number, count(*) as mention_count, max(document_date) as last_date from p where contains(n,' the ') group by 1 order by 3 desc, 1 limit 20 offset 20")
def search_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page_of(search.cases(search.matches(paragraphs(spark, sf_dir), "the")), 2, 20)


@query(P + """, m as (select * from p where contains(n,' the ') and document_date >= date '2020-01-01'),
k as (select process_number, max(document_date) as last_date from m where process_number not in (select process_number from m where contains(lower(content),'worthless') or contains(lower(content),'of the')) group by 1 order by 2 desc, 1 limit 25)
select m.id, process_number, document_date, last_date from m join k using (process_number)""")  # fmt: skip
def search_full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.matches(paragraphs(spark, sf_dir), "the", start="2020-01-01")
    page = search.page_of(search.cases(found, 'worthless "of the"'), 1, 25)
    return search.mentions_of(found, page).select("id", "process_number", "document_date", "last_date")


@query(P + """ select process_number, count(*) as mention_count, max(document_date) as last_date,
string_agg(concat(cast(document_date as varchar),'/',db_id,'/',cast(length(content) as varchar)), ';' order by document_date desc, db_id, id) as mentions from p where contains(n,' worthless ') group by 1""")  # fmt: skip
def group_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.nested(search.matches(paragraphs(spark, sf_dir), "worthless"))
    shown = F.transform("mentions", lambda m: F.concat_ws("/", m["document_date"].cast("string"), m["db_id"], F.length(m["content"]).cast("string")))
    parts = found.select("process_number", "mention_count", "part", F.array_max("mentions.document_date").alias("last_date"), F.array_join(shown, ";").alias("shown"))
    whole = parts.groupBy("process_number").agg(F.first("mention_count").cast("long").alias("mention_count"), F.max("last_date").alias("last_date"), F.sort_array(F.collect_list(F.struct("part", "shown"))).alias("all"))  # without contents
    return whole.select("process_number", "mention_count", "last_date", F.array_join("all.shown", ";").alias("mentions"))


@query(P + " select id, process_number from p where process_number not in (select process_number from p where contains(lower(content),'stupid'))")
def exclude_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.without_excluded(search.matches(paragraphs(spark, sf_dir)), "Stupid").select("id", "process_number")


@query(P + " select process_number, count(*) as mention_count, max(document_date) as last_date from p group by 1 having not bool_or(contains(lower(content),'in the') or contains(lower(content),'clown'))")
def exclude_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cases(search.matches(paragraphs(spark, sf_dir)), '"in the" clown')


@query(P + " select id, concat(cast(row_number() over (partition by process_number order by document_date desc, db_id, id) as varchar),'/',cast(count(*) over (partition by process_number) as varchar)) as mention_label from p")
def mention_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.labelled(search.matches(paragraphs(spark, sf_dir)).drop("content")).select("id", "mention_label")


@query(P + " select id, process_number, document_date from (select *, row_number() over (partition by process_number order by document_date desc, db_id, id) as r from p) where r <= 2")
def top_n_mentions_per_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.newest_per_case(search.matches(paragraphs(spark, sf_dir)), 2).select("id", "process_number", "document_date")


@query(P + " select process_number, max(document_date) as last_date, count(*) as mention_count from p group by 1")
def process_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_recency(search.cases(search.matches(paragraphs(spark, sf_dir))))


@query(P + " select count(distinct process_number) as total_processes, count(*) as total_mentions, min(document_date) as earliest, max(document_date) as latest from p where contains(n,' the ')")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.summary(search.matches(paragraphs(spark, sf_dir), "the"))


@query(P + " select db_id, count(*) as mentions from p where contains(n,' the ') group by 1")
def db_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.per_shard(search.matches(paragraphs(spark, sf_dir), "the"))


@query(P + """ select process_number as "Process Number", concat(cast(row_number() over w as varchar),'/',cast(count(*) over (partition by process_number) as varchar)) as "Mention Count",
document_date as "Document Date", db_id as "Database", file_path as "File Path", content as "Content" from p where contains(n,' worthless ') window w as (partition by process_number order by document_date desc, db_id, id)""")  # fmt: skip
def export_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rows(search.matches(paragraphs(spark, sf_dir), "worthless"))


@query(P + " select db_id, min(document_date) as start_date, max(document_date) as end_date from p group by 1")
def shard_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest(paragraphs(spark, sf_dir))


@query(P + " select db_id from p group by 1 having max(document_date) >= date '2021-03-01' and min(document_date) <= date '2022-12-31'")
def shard_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.relevant_shards(corpus.manifest(paragraphs(spark, sf_dir)), "2021-03-01", "2022-12-31")


@query(P + ", m as (select db_id, min(document_date) as a, max(document_date) as b from p group by 1) select q.id as order_id, m.db_id from m join (select o_orderkey as id, cast(date '2019-01-01' + cast(o_orderkey % 2190 as integer) as date) as d from orders) q on m.b >= q.d and m.a <= q.d")
def shard_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that one-day ranges touch; the manifest has a row per shard."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.date_add(F.lit("2019-01-01").cast("date"), (F.col("o_orderkey") % 2190).cast("int")).alias("d"))
    shards = small(corpus.manifest(paragraphs(spark, sf_dir)), 64)
    return asked.join(shards, (F.col("end_date") >= F.col("d")) & (F.col("start_date") <= F.col("d"))).select("order_id", "db_id")


@query(P + """ select db_id, count(*) as total_entries, count(distinct process_number) as unique_processes, min(document_date) as start_date, max(document_date) as end_date,
concat(cast(min(document_date) as varchar),' to ',cast(max(document_date) as varchar)) as date_range from p group by 1""")  # fmt: skip
def shard_stats_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shard_statistics(paragraphs(spark, sf_dir))


@query(P + ", m as (select db_id, min(document_date) as a, max(document_date) as b from p group by 1) select count(*) as total_databases, min(a) as earliest, max(b) as latest from m")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_statistics(corpus.manifest(paragraphs(spark, sf_dir)))


@query(P + ", y as (select year(document_date), count(distinct file_path) as files, count(*) as paragraphs, count(distinct process_number) as processes from p group by 1) select cast(sum(files) as bigint) as files, cast(sum(paragraphs) as bigint) as paragraphs, cast(sum(processes) as bigint) as processes from y")
def validation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.validation_totals(corpus.validation(paragraphs(spark, sf_dir)))


@query(P + ", c as (select count(distinct process_number) as total from p) select s as page_size, greatest(1, cast(ceil(total / s) as bigint)) as pages from c, (values (1),(20),(100),(500)) v(s)")
def total_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = paragraphs(spark, sf_dir).agg(F.countDistinct("process_number").alias("total"))
    sizes = F.explode(F.array(*map(F.lit, (1, 20, 100, 500))))
    return total.select(sizes.alias("page_size"), "total").select("page_size", search.pages_of(F.col("total"), F.col("page_size")).alias("pages"))


@query(P + " select id, db_id from (select *, row_number() over (partition by db_id, md5(content) order by id) as r from p) where r = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.keep_first(paragraphs(spark, sf_dir)).select("id", "db_id")


@query(P + ", k as (select * from (select *, row_number() over (partition by db_id, md5(content) order by id) as r from p) where r = 1) select row_number() over (partition by db_id order by id) - 1 as id, db_id, md5(content) as digest from k")
def dedup_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.renumbered(maintain.keep_first(paragraphs(spark, sf_dir))).select("id", "db_id", F.md5("content").alias("digest"))


@query(P + " select id, document_date, identifier from p join (values (date '2019-01-01', date '2020-06-30', 'early'), (date '2020-06-30', date '2021-12-31', 'middle'), (date '2023-01-01', date '2023-01-31', 'month')) r(a, b, identifier) on document_date between a and b")
def split_by_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("2019-01-01", "2020-06-30", "early"), ("2020-06-30", "2021-12-31", "middle"), ("2023-01-01", "2023-01-31", "month")], "a string, b string, identifier string").select(F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"), "identifier")
    return maintain.split_by_ranges(paragraphs(spark, sf_dir), ranges).select("id", "document_date", "identifier")


@query(P + ", t as (select distinct id, unnest(string_split(trim(n),' ')) as token from p) select token, count(*) as documents from t where token <> '' group by 1")
def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.token_frequency(paragraphs(spark, sf_dir))


@query(P + " select id from p where (contains(n,' worthless ') and contains(n,' the ')) or contains(n,' of the and ')")
def postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the stored corpus and its written index, which is sorted by token."""
    p, index = stored_corpus(spark, sf_dir)
    return maintain.postings_matches(p, index, 'worthless the OR "of the and"').select("id")


_GAZETTE = r"""with raw as (select doc_id, concat('kopf ',text,' Processo ',lpad(cast(doc_id as varchar),7,'0'),'-01.2020.8.26.0001  ',lang,' Processo sem  ',' Processo ',lpad(cast(doc_id+1 as varchar),7,'0'),'-02.2021.8.26.0002 -  Fim',chr(10)) as t from documents)"""


@query(_GAZETTE + r""", m as (select doc_id, unnest(string_split(regexp_replace(t, '(Processo \d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4})', chr(1)||'\1', 'g'), chr(1))[2:]) as piece from raw)
select concat('2020/20200131_', cast(doc_id as varchar), '.txt') as file_path, substring(piece, 10, 25) as process_number, trim(regexp_replace(piece, '\s+', ' ', 'g')) as content from m""")  # fmt: skip
def segment_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, padded = table(spark, sf_dir, "documents"), lambda c: F.lpad(c.cast("string"), 7, "0")
    text = F.concat(F.lit("kopf "), F.col("text"), F.lit(" Processo "), padded(F.col("doc_id")), F.lit("-01.2020.8.26.0001  "), F.col("lang"), F.lit(" Processo sem  "), F.lit(" Processo "), padded(F.col("doc_id") + 1), F.lit("-02.2021.8.26.0002 -  Fim\n"))
    files = d.select(F.concat(F.lit("2020/20200131_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), text.alias("text"))
    return ingest.segment(files).select("file_path", "process_number", "content")


@query(P + " select file_path, document_date as file_date, count(*) as n from p group by 1, 2")
def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("file_path", fn.file_date(F.col("file_path")).alias("file_date")).groupBy("file_path", "file_date").agg(F.count("*").alias("n"))


@query(P + " select year, count(*) as files from (select distinct file_path, cast(year(document_date) as integer) as year from p) group by 1")
def files_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.files_by_year(paragraphs(spark, sf_dir).select("file_path").distinct())


@query(P + " select distinct file_path from p where file_path not in (select file_path from p where id % 3 = 0)")
def unprocessed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    return ingest.unprocessed(p.select("file_path").distinct(), p.where("id % 3 = 0").select("file_path"))


@query("select event_id as ordinal, cast(user_id as varchar) as number from events where user_id not in (select user_id from events where event_type = 'error' and event_id % 40 = 0)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").cast("string").alias("number"), "event_type")
    return extract.remaining(e.select("ordinal", "number"), e.where("event_type = 'error' and ordinal % 40 = 0"))


@query("select e.event_id as ordinal, cast(e.user_id as varchar) as number, p.url as status, case when p.page_id is null then 'No result returned' end as error from events e left join pages p on p.page_id = e.user_id")
def order_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").cast("string").alias("number"))
    results = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("number"), F.col("url").alias("status"), F.lit(None).cast("string").alias("error"))
    return extract.in_input_order(numbers, results).select("ordinal", "number", "status", "error")


@query(r"""select page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>\s*([^<]*?)\s*</title>', 1), '') as title, nullif(regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1), '') as lang,
nullif(regexp_extract(html, '(?is)<div\b[^>]*\bclass=["'']?ad\b[^>]*>\s*([^<]*?)\s*</div>', 1), '') as ad from pages""")  # fmt: skip
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", pattern_field(html, "title").alias("title"), F.nullif(F.regexp_extract(html, r'(?i)<html[^>]*\blang="([^"]*)"', 1), F.lit("")).alias("lang"), pattern_field(html, "div", "class", "ad").alias("ad"))


_AMOUNT = "case when o_orderkey % 7 = 0 then ' ' when o_orderkey % 5 = 0 then concat('R$  ', replace(printf('%.2f', o_totalprice), '.', ',')) else replace(printf('%.2f', o_totalprice), '.', ',') end"


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price: Column = F.replace(F.format_string("%.2f", F.col("o_totalprice")), F.lit("."), F.lit(","))
    amount = F.when(F.col("o_orderkey") % 7 == 0, " ").when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("R$  "), price)).otherwise(price)
    return table(spark, sf_dir, "orders").select("o_orderkey", amount.alias("amount"))


@query(f"with a as (select o_orderkey, regexp_replace({_AMOUNT}, '\\s+', '', 'g') as v from orders) select o_orderkey, case when v = '' then null when starts_with(v, 'R$') then 'R$ ' || substring(v, 3) else v end as amount from a")
def format_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).select("o_orderkey", fn.currency(F.col("amount")).alias("amount"))


@query(f"with a as (select o_orderkey, try_cast(replace(regexp_replace({_AMOUNT}, '[^0-9,]', '', 'g'), ',', '.') as double) as v from orders) select o_orderkey, v as value, row_number() over (order by v desc nulls last, o_orderkey) as place from a")
def currency_sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = _amounts(spark, sf_dir).select("o_orderkey", fn.currency_value(F.col("amount")).alias("value"))
    return jobs.numbered(amounts, F.col("value"), F.col("o_orderkey"), descending=True).select("o_orderkey", "value", (F.col("ordinal") + 1).alias("place"))


@query("select event_type as error_type, count(*) as n from events where event_type is not null group by 1")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.error_histogram(table(spark, sf_dir, "events").select(F.col("event_type").alias("error_type")))


@query("""with c as (select count(*) as total, count(*) filter (where event_type <> 'error') as successful, count(*) filter (where event_type = 'error') as errors from events)
select total, successful, errors, round(successful / total * 100, 1) as success_percent, round(errors / total * 100, 1) as error_percent from c""")  # fmt: skip
def success_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.outcome(table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.lit("failed")).alias("error")))


@query("""with d as (select cast(unnest(generate_series(date '2024-01-01', date '2024-03-31', interval 1 day)) as date) as date),
b as (select * from (values ('12','Judicial_Capital_1'),('20','Judicial_Capital_2'),('18','Judicial_Interior_1'),('13','Judicial_Interior_2'),('15','Judicial_Interior_3')) v(booklet_value, booklet_name))
select date, booklet_value, booklet_name, strftime(date,'%d/%m/%Y') as form_date, concat(strftime(date,'%Y/%m/%Y%m%d'),'_',booklet_name,'.pdf') as path from d, b where isodow(date) < 6 and date <= date '2024-03-15'""")  # fmt: skip
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.download_plan(spark, "2024-01-01", "2024-03-31", today="2024-03-15")


@query(P + r" select distinct unnest(regexp_extract_all(concat(process_number, '; ', file_path, ' x', process_number), '\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}')) as number from p")
def case_numbers_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers_in(paragraphs(spark, sf_dir), F.concat("process_number", F.lit("; "), "file_path", F.lit(" x"), "process_number"))


@query(P + " select id, case when length(content) > 400 then concat(substring(content,1,400),'…') else content end as preview, case when length(content) > 30 then concat(substring(content,1,27),'...') else content end as cell from p")
def content_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).select("id", fn.preview(F.col("content")).alias("preview"), fn.cell(F.col("content")).alias("cell"))


@query(P + " select id, source as defendant, cast(count(*) over (partition by source) as integer) as other_processes from p")
def defendant_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).select("id", F.col("source").alias("defendant"), F.lit(None).cast("int").alias("other_processes"), F.lit(None).cast("string").alias("error"))
    return extract.with_other_processes(rows).select("id", "defendant", "other_processes")


@query(r"select conv_id, turn, regexp_matches(concat(lpad(cast(conv_id as varchar),7,'0'),'-00.2024.8.26.000',cast(turn as varchar)), '^\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}$') as valid, left(concat(lpad(cast(conv_id as varchar),7,'0'),'-00.2024.8.26.000',cast(turn as varchar)),15) as first_part, right(concat(lpad(cast(conv_id as varchar),7,'0'),'-00.2024.8.26.000',cast(turn as varchar)),4) as last_part from conversations")
def case_number_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat(F.lpad(F.col("conv_id").cast("string"), 7, "0"), F.lit("-00.2024.8.26.000"), F.col("turn").cast("string"))
    first, last = fn.number_parts(F.col("number"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", number.alias("number")).select("conv_id", "turn", fn.is_case_number(F.col("number")).alias("valid"), first.alias("first_part"), last.alias("last_part"))


@query("""select conv_id, turn, case when contains(lower(text),'timeout') then 'timeout' when contains(lower(text),'network') then 'browser_error' when contains(lower(text),'segredo') then 'confidential' else 'unknown' end as error_type,
coalesce(try_cast(nullif(regexp_extract(concat(cast(turn as varchar),' Processos'), '^\\s*(\\d+)(?:\\s|$)', 1),'') as integer),0) as found from conversations""".replace("\\\\", "\\"))  # fmt: skip
def error_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", extract.message_error(F.col("text")).alias("error_type"), fn.leading_count(F.concat(F.col("turn").cast("string"), F.lit(" Processos"))).alias("found"))


@query("select o_orderkey as number, o_orderstatus as status, cast(floor(o_orderkey / 50) as bigint) as batch from orders")
def extraction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("status"))
    return jobs.batches(numbers).select("number", "status", "batch")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def events_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return event_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(P + " select id, process_number from p where contains(n,' scum ') union all select id, process_number from p where contains(n,' moron ')")
def union_of_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    return search.matches(p, "scum").unionByName(search.matches(p, "moron")).select("id", "process_number")


def keyword_syntax_error_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matches(paragraphs(spark, sf_dir), "(the", on_error="empty").select("id")


_REGISTRY["keyword_syntax_error_is_empty"] = (keyword_syntax_error_is_empty, "select doc_id as id from documents where false")


from . import index_queries, service_queries  # noqa: E402,F401  (register their queries)
