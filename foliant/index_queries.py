"""Queries that a stored corpus answers from its index, its dictionaries and its places, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus, distincts, extract, intervals, maintain, search
from .operators.index import IndexSearch
from .operators.maintain import document_frequency
from .operators.pages import PageIndex, newest_cases, page_after
from .operators.segments import SegmentedIndex
from .operators.substrings import with_number, without_excluded, write_grams
from .queries import P, dictionary, paragraphs, query, side_tables, stored_corpus, stored_paragraphs, table
from .schema import PARAGRAPHS
from .sinks.export import export_rows
from .sinks.export_source import read_export, write_export
from .storage import scratch
from .streaming.ingest import ingest_files, ingested


def _searched(keywords: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, index = stored_corpus(spark, sf_dir)
        return IndexSearch(index, dictionary(spark, sf_dir)).matches(p.select("id", "db_id", "process_number", "document_date"), keywords)

    return run


def _answer(where: str) -> str:
    return f"{P} select id, db_id, process_number, document_date from p where {where}"


_NEAR = "regexp_matches(n,' {0} ([^ ]+ ){{0,{2}}}{1} ') or regexp_matches(n,' {1} ([^ ]+ ){{0,{2}}}{0} ')"


@query(_answer("contains(n,' of the and ')"))
def index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase by intersecting places, rarest token first; contents aren't read."""
    return _searched('"of the" + "and"')(spark, sf_dir)


@query(_answer("contains(n,' in the th') or contains(n,' in the er')"))
def index_phrase_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched('"in the th"* OR "in the er"*')(spark, sf_dir)


@query(_answer(_NEAR.format("the", "worthless", 3)))
def index_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched("NEAR(the worthless, 3)")(spark, sf_dir)


@query(_answer("contains(n,' worth') or contains(n,' sche')"))
def index_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes as ranges of the sorted tokens."""
    return _searched("worth* OR sche*")(spark, sf_dir)


@query(_answer("((contains(n,' disgusting ') or contains(n,' pathetic ')) and contains(n,' the ') and not contains(n,' scum ')) or contains(n,' of the and ')"))
def index_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched('(disgusting OR pathetic) AND the NOT scum OR "of the and"')(spark, sf_dir)


@query(P + """, m as (select * from p where contains(n,' of the ') and document_date >= date '2020-01-01'),
k as (select process_number, count(*) as mention_count, max(document_date) as last_date from m group by 1 having not bool_or(contains(lower(content),'worthless')) order by 3 desc, 1 limit 25)
select process_number, mention_count, last_date, (select count(*) from (select process_number from m group by 1 having not bool_or(contains(lower(content),'worthless')))) as total from k""")  # fmt: skip
def index_full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search request with the index: keywords, dates, exclusion and a page."""
    p, index = stored_corpus(spark, sf_dir)
    page = search.search(p, '"of the"', start="2020-01-01", exclusion="worthless", page_size=25, shards=corpus.manifest(p), index=IndexSearch(index, dictionary(spark, sf_dir)))
    cases = page.results.where("part = 0")
    return cases.select("process_number", F.col("mention_count").cast("long").alias("mention_count"), F.array_max("mentions.document_date").alias("last_date"), F.lit(page.total_processes).cast("long").alias("total"))


_CHANGED = """with raw as (select doc_id as id, lang, source, text from documents), b as (select id, case when id % 17 = 0 then concat('changed ', coalesce(lang, ''), ' ', coalesce(source, '')) else text end as content from raw where id % 13 <> 0),
n as (select id, ' '||trim(regexp_replace(strip_accents(lower(content)),'[^\\p{L}\\p{N}]+',' ','g'))||' ' as n from b), t as (select distinct id, unnest(string_split(trim(n),' ')) as token from n)"""


@query(_CHANGED + " select token, count(*) as documents from t where token <> '' group by 1")
def segmented_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches, then deleted and changed rows, with merges in between: numbers of rows by token of what is there."""
    p = paragraphs(spark, sf_dir).select(*PARAGRAPHS.names, "lang", "source")
    index = SegmentedIndex(spark, scratch(spark, "segments"), fan_in=3)
    for k in range(5):
        index.apply(p.where(F.col("id") % 5 == k), batch=f"batch {k}")
        index.merge()
    index.apply(removed=p.where(F.col("id") % 13 == 0))
    changed = p.where((F.col("id") % 17 == 0) & (F.col("id") % 13 != 0)).withColumn("content", F.concat_ws(" ", F.lit("changed"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))))
    index.apply(changed, changed)
    index.apply(p.where(F.col("id") % 5 == 1), batch="batch 1")  # a batch that comes again
    index.merge()
    return document_frequency(index.postings())


@query(P + " select id, process_number from p where process_number ilike '%0_7-__.2%.8.26.00%'")
def substring_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case numbers by a pattern: trigrams choose among distinct numbers, and the pattern is tested on what they choose."""
    p = stored_paragraphs(spark, sf_dir)
    path = scratch(spark, "number-grams")
    write_grams(p, "process_number", path)
    return with_number(p.select("id", "process_number"), spark.read.parquet(path), "0_7-__.2%.8.26.00")


@query(P + " select id, process_number from p where contains(n,' the ') and process_number not in (select process_number from p where contains(n,' the ') and (contains(lower(content),'orthles') or contains(lower(content),'cum. ')))")
def substring_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded parts of words: contents are read of rows that have a token with such a part."""
    p, index = stored_corpus(spark, sf_dir)
    dictionary, grams = side_tables(spark, sf_dir)
    found = IndexSearch(index, dictionary).matches(p.select("db_id", "id", "process_number"), "the")
    return without_excluded(found, p, index, grams, 'Orthles "cum. "').select("id", "process_number")


_NEWEST = """, m as (select * from p where contains(n,' the ')),
k as (select process_number, count(*) as mention_count, max(document_date) as last_date from m group by 1 having not bool_or(contains(lower(content),'worthless') or contains(lower(content),'stupid')))"""


@query(P + _NEWEST + " select process_number, mention_count, last_date from k order by last_date desc, process_number limit 20")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page from the newest shards alone, as far as that goes."""
    p = stored_paragraphs(spark, sf_dir)
    return newest_cases(p, corpus.manifest(p), 20, "the", exclusion="worthless stupid").cases


def _order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: as many as there are."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("process_number"), F.lit(1).cast("long").alias("mention_count"), F.col("o_orderdate").cast("date").alias("last_date"))


_CASES = "with k as (select lpad(cast(o_orderkey as varchar), 9, '0') as process_number, cast(1 as bigint) as mention_count, cast(o_orderdate as date) as last_date from orders)"


@query(_CASES + " select * from k order by last_date desc, process_number limit 3 offset 14700")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 4,901 of three cases each, by places."""
    return PageIndex(_order_cases(spark, sf_dir)).page(4901, 3)


@query(_CASES + ", r as (select *, row_number() over (order by last_date desc, process_number) as r from k) select cast(r // 500 + 1 as bigint) as page, last_date, process_number from r where r % 500 = 0")
def page_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case before each page of 500."""
    return PageIndex(_order_cases(spark, sf_dir)).cursors(500)


@query(_CASES + ", r as (select *, row_number() over (order by last_date desc, process_number) as r from k) select process_number, mention_count, last_date from r where r between 501 and 1000")
def page_by_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that follows a cursor: the last case of the page before."""
    keys = _order_cases(spark, sf_dir)
    last = search.by_recency(keys).limit(500).orderBy(F.col("last_date").asc(), F.col("process_number").desc()).first()
    return page_after(keys, last.last_date, last.process_number, 500)


@query(P + """, r as (select n_nationkey as range_id, cast(date '2019-01-01' + cast(n_nationkey * 67 as integer) as date) as a, cast(date '2019-01-01' + cast(n_nationkey * 67 + n_nationkey * n_nationkey * 3 as integer) as date) as b from nation)
select cast(range_id as bigint) as range_id, count(distinct process_number) as n_cases from r join p on document_date between a and b group by 1""")  # fmt: skip
def distinct_cases_of_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of ranges of dates, one for each nation, as unions of stored bitmaps."""
    path, day = scratch(spark, "bitmaps"), F.lit("2019-01-01").cast("date")
    distincts.write_bitmaps(paragraphs(spark, sf_dir), path)
    n = F.col("n_nationkey")
    ranges = table(spark, sf_dir, "nation").select(n.cast("long").alias("range_id"), F.date_add(day, (n * 67).cast("int")).alias("start_date"), F.date_add(day, (n * 67 + n * n * 3).cast("int")).alias("end_date"))
    return distincts.distinct_cases(spark.read.parquet(path), ranges)


@query("""with a as (select o_orderkey as id, cast(o_orderdate as date) as s, cast(cast(o_orderdate as date) + cast(o_orderkey % 4 as integer) as date) as e from orders), b as (select o_orderkey as other, cast(o_orderdate as date) as s, cast(cast(o_orderdate as date) + cast(o_custkey % 3 * 2 as integer) as date) as e from orders)
select id, count(*) as n, min(other) as first_other, max(other) as last_other from a join b on a.s <= b.e and b.s <= a.e group by 1""")  # fmt: skip
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of dates of all orders against other ranges of all orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    left = o.select(F.col("o_orderkey").alias("id"), intervals.days(F.col("d")).alias("start"), (intervals.days(F.col("d")) + F.col("o_orderkey") % 4).alias("end"))
    right = o.select(F.col("o_orderkey").alias("other"), intervals.days(F.col("d")).alias("other_start"), (intervals.days(F.col("d")) + F.col("o_custkey") % 3 * 2).alias("other_end"))
    found = left.join(intervals.overlap_totals(left, right, "other"), ["start", "end"])
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.min("low").alias("first_other"), F.max("high").alias("last_other"))


_TERMS = "(select reverse(w) as w from (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,7}')) as w from documents) order by md5(w), w limit 5000)"


@query(P + f", t as {_TERMS}, bad as (select distinct process_number from p where exists (select 1 from t where contains(lower(content), w))) select id, process_number from p where process_number not in (select process_number from bad)")
def exclude_many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request with 5,000 excluded terms, made from words of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,7})"), F.lit(1))).alias("w")).distinct()
    terms = [r.w for r in words.orderBy(F.md5("w"), "w").limit(5000).select(F.reverse("w").alias("w")).collect()]  # the request
    return search.without_excluded(search.matches(paragraphs(spark, sf_dir)), " ".join(terms)).select("id", "process_number")


def _gazettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gazette files, two of a day and source that say the same about two cases."""
    d = table(spark, sf_dir, "documents")
    case = lambda k: F.concat(F.lit("Processo "), F.lpad(k.cast("string"), 7, "0"), F.lit("-01.2020.8.26.0001 "))
    text = F.concat(F.lit("kopf "), case(F.col("doc_id") % 50), F.coalesce("lang", F.lit("-")), F.lit("  "), case(F.col("doc_id") % 7), F.coalesce("source", F.lit("-")), F.lit("\n"))
    return d.select("doc_id", F.concat(F.lit("d/"), (2019 + F.col("doc_id") % 3).cast("string"), F.lit("0131_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), text.alias("text"))


@query("""with f as (select 2019 + doc_id % 3 as y, doc_id % 50 as a, coalesce(lang, '-') as l, doc_id % 7 as b, coalesce(source, '-') as s from documents),
g as (select y, concat('Processo ', lpad(cast(a as varchar), 7, '0'), '-01.2020.8.26.0001 ', l) as content from f union select y, concat('Processo ', lpad(cast(b as varchar), 7, '0'), '-01.2020.8.26.0001 ', s) from f)
select concat('legal_documents_', cast(y as varchar)) as db_id, content, count(*) as n, (select count(*) from documents) as files from g group by 1, 2""")  # fmt: skip
def ingest_stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files through the ingest stream in three batches, the second after a restart: equal paragraphs are kept once."""
    path, files = scratch(spark, "stream"), _gazettes(spark, sf_dir)
    for part in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 4 == 1, F.col("doc_id") % 4 == 3):
        files.where(part).select("file_path", "text").coalesce(1).write.mode("append").parquet(f"{path}/files")
        source = spark.readStream.schema("file_path string, text string").option("maxFilesPerTrigger", 1).parquet(f"{path}/files")
        ingest_files(source, f"{path}/corpus", f"{path}/ledger", f"{path}/checkpoint", f"{path}/digests").awaitTermination()
    done = spark.read.parquet(f"{path}/ledger").agg(F.countDistinct("file_path").alias("files")).first().files
    return ingested(spark, f"{path}/corpus").groupBy("db_id", "content").agg(F.count("*").alias("n")).withColumn("files", F.lit(done))


@query(P + " select db_id, count(*) as n, count(distinct id) as ids, min(id) as low, max(id) as high, count(distinct md5(content)) as digests from (select row_number() over (partition by db_id order by id) - 1 as id, db_id, content from (select *, row_number() over (partition by db_id, md5(content) order by id) as r from p) where r = 1) group by 1")
def optimized_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written corpus deduplicated, renumbered and written again, and read back."""
    p = stored_paragraphs(spark, sf_dir)
    source, target = scratch(spark, "before"), scratch(spark, "after")
    corpus.write(p.drop("content_norm"), source, "overwrite")
    maintain.optimize(spark, source, target)
    back = corpus.load(spark, target)
    return back.groupBy("db_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").cast("long").alias("low"), F.max("id").cast("long").alias("high"), F.countDistinct(F.md5("content")).alias("digests"))


@query(P + """ select process_number as "Process Number", concat(cast(row_number() over w as varchar),'/',cast(count(*) over (partition by process_number) as varchar)) as "Mention Count",
cast(document_date as varchar) as "Document Date", db_id as "Database", file_path as "File Path", md5(content) as digest from p where contains(n,' worthless ') window w as (partition by process_number order by document_date desc, db_id, id)""")  # fmt: skip
def bulk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export written in parts through the data source, and read back."""
    path = scratch(spark, "export")
    write_export(export_rows(search.matches(paragraphs(spark, sf_dir), "worthless")), path, "=== Search Results Summary ===\r\n")
    return read_export(spark, path).withColumn("digest", F.md5("Content")).drop("Content")


_RECORDS = "with r as (select lpad(cast(o_orderkey as varchar), 9, '0') as number, case when o_orderkey % 7 = 0 then ' ' else concat('R$ ', replace(printf('%.2f', o_totalprice), '.', ',')) end as value, case when o_orderkey % 5 = 0 then '' when o_orderkey % 2 = 0 then upper(o_orderpriority) else o_orderpriority end as class_type from orders)"


@query(_RECORDS + """, k as (select number, try_cast(replace(regexp_replace(value, '[^0-9,]', '', 'g'), ',', '.') as double) as v, nullif(lower(class_type), '') as t from r)
select 'value up' as sorted, number, row_number() over (order by v asc nulls last, number) as place from k union all select 'value down', number, row_number() over (order by v desc nulls last, number) from k
union all select 'class up', number, row_number() over (order by t asc nulls last, number) from k""")  # fmt: skip
def records_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all records by amount, both ways, and by a text."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    value = F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("R$ "), F.replace(F.format_string("%.2f", F.col("o_totalprice")), F.lit("."), F.lit(","))))
    kind = F.when(k % 5 == 0, "").when(k % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    rows = o.select(F.lpad(k.cast("string"), 9, "0").alias("number"), value.alias("value"), kind.alias("class_type"))
    parts = [extract.placed_records(rows, c, down).select(F.lit(name).alias("sorted"), "number", "place") for name, c, down in (("value up", "value", False), ("value down", "value", True), ("class up", "class_type", False))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(P + " select db_id, count(distinct md5(content)) as n_rows, 0.0 as failed from p group by 1")
def optimized_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard of a written corpus optimized by itself, and read back."""
    source, target = scratch(spark, "before"), scratch(spark, "after")
    corpus.write(paragraphs(spark, sf_dir).select(*PARAGRAPHS.names), source, "overwrite")
    told = spark.createDataFrame([(r["db_id"], float(r["error"] is not None)) for r in maintain.optimize_shards(spark, source, target)], "db_id string, failed double")  # a row per shard
    return corpus.load(spark, target).groupBy("db_id").agg(F.count("*").alias("n_rows")).join(F.broadcast(told), "db_id")
