"""Ingest, maintenance, older shards, calendar."""

import datetime
import sqlite3
import zlib

from pyspark.sql import functions as F

from foliant.functions import text as fn
from foliant.functions.blobs import compress_content, decompress_content
from foliant.operators import calendar, corpus, ingest, maintain, search
from foliant.sources.gazettes import binary_files, text_files
from foliant.sources.shards import read_shards
from foliant.streaming.ingest import ingest as stream_ingest
from foliant.streaming.ingest import ingested

GAZETTE = "cabeçalho do diário\nProcesso 1234567-89.2023.8.26.0001 -  Penhora\n  realizada   Processo 7654321-00.2022.8.26.0100 despacho. Processo sem número segue\n"


def test_segment(spark):
    files = spark.createDataFrame([("x/20240115_a.txt", GAZETTE), ("20240116_b.txt", "nothing here"), ("notes.txt", GAZETTE)], "file_path string, text string")
    rows = ingest.paragraphs(files).orderBy("process_number").collect()
    assert [(r.process_number, r.content) for r in rows] == [("1234567-89.2023.8.26.0001", "Processo 1234567-89.2023.8.26.0001 - Penhora realizada"), ("7654321-00.2022.8.26.0100", "Processo 7654321-00.2022.8.26.0100 despacho. Processo sem número segue")]
    assert {(r.db_id, str(r.document_date)) for r in rows} == {("legal_documents_2024", "2024-01-15")}


def test_stream_ingests_each_file_once(spark, tmp_path):
    source, args = tmp_path / "in", [str(tmp_path / n) for n in ("in", "corpus", "ledger", "checkpoint")]
    source.mkdir()
    (source / "20240115_a.txt").write_text(GAZETTE, "utf-8")
    for want in (2, 2):
        stream_ingest(spark, *args).awaitTermination()
        assert ingested(spark, args[1]).count() == want
    (source / "20230116_b.txt").write_text(GAZETTE, "utf-8")
    stream_ingest(spark, *args).awaitTermination()
    assert ingested(spark, args[1]).count() == 4
    ledger = spark.read.parquet(args[2] + "/batch=*")
    assert ledger.count() == 2
    assert ingest.unprocessed(text_files(spark, args[0]), ledger).count() == 0


def test_plugged_in_extractor(spark, tmp_path):
    (tmp_path / "20240115_a.pdf").write_bytes(b"PDF" + GAZETTE.encode())
    (tmp_path / "20240116_b.pdf").write_bytes(b"broken")

    def read(raw):
        assert raw.startswith(b"PDF")
        return raw[3:].decode()

    assert ingest.paragraphs(binary_files(spark, str(tmp_path), read)).count() == 2


def test_file_names(spark):
    df = spark.createDataFrame([("d/20240115_Judicial_Capital_1.pdf",), ("20241315_x.pdf",), ("notes.pdf",)], "p string")
    assert [r[0] for r in df.select(fn.file_date(F.col("p"))).collect()] == [datetime.date(2024, 1, 15), None, None]
    years = spark.createDataFrame([("legal_documents_2019",), ("x",)], "s string").select(fn.shard_year(F.col("s"))).collect()
    assert years[0][0] == 2019 and years[1][0] >= 2024


def test_currency(spark):
    df = spark.createDataFrame([("R$  1.234,56",), ("R$ 1.234,56",), ("1 000,00",), (" ",), (None,)], "v string")
    rows = df.select(fn.currency(F.col("v")).alias("c"), fn.currency_value(F.col("v")).alias("x")).collect()
    assert [r.c for r in rows] == ["R$ 1.234,56", "R$ 1.234,56", "1000,00", None, None]
    assert [r.x for r in rows] == [1234.56, 1234.56, 1000.0, None, None]


def test_blobs(spark):
    df = spark.createDataFrame([(bytearray(zlib.compress("ação".encode(), 9)),), (bytearray(b"plain"),), (None,)], "b binary")
    assert [r[0] for r in df.select(decompress_content("b")).collect()] == ["ação", "plain", None]
    texts = spark.createDataFrame([("ação",), (None,)], "t string")
    assert [r[0] for r in texts.select(decompress_content(compress_content("t"))).collect()] == ["ação", None]


def test_older_shards(spark, tmp_path):
    for year in (2023, 2024):
        with sqlite3.connect(tmp_path / f"legal_documents_{year}.db") as db:
            db.execute("create table paragraphs (id integer primary key, process_number text, content blob, file_path text, document_date date)")
            db.executemany("insert into paragraphs values (?, ?, ?, ?, ?)", [(i, f"n{i}", zlib.compress(f"texto {i}".encode()) if i % 2 else f"texto {i}", "p", f"{year}-0{i + 1}-01") for i in range(3)])
    sqlite3.connect(tmp_path / "other.db").close()
    rows = read_shards(spark, str(tmp_path))
    assert rows.count() == 6 and {r.content for r in rows.collect()} == {"texto 0", "texto 1", "texto 2"}
    some = rows.where((F.col("document_date") >= F.lit("2024-02-01").cast("date")) & (F.col("process_number") == "n2"))
    assert [(r.db_id, r.id) for r in some.collect()] == [("legal_documents_2024", 2)]


def test_dedup_split_and_postings(spark, tmp_path):
    day = datetime.date(2024, 6, 30)
    df = spark.createDataFrame([(10, "n", "A x", "f", day, "s"), (11, "n", "B", "f", day + datetime.timedelta(1), "s"), (12, "n", "A x", "f", day, "s"), (12, "n", "A x", "f", datetime.date(2023, 12, 31), "t")], "id long, process_number string, content string, file_path string, document_date date, db_id string")
    kept = maintain.renumbered(maintain.keep_first(df))
    assert sorted((r.db_id, r.id, r.content) for r in kept.collect()) == [("s", 0, "A x"), ("s", 1, "B"), ("t", 0, "A x")]
    assert maintain.keep_first(maintain.keep_first(df)).count() == 3
    ranges = spark.createDataFrame([("2024-01-01", "2024-06-30", "2024_1"), ("2024-07-01", "2024-12-31", "2024_2")], "a string, b string, identifier string").select(F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"), "identifier")
    assert sorted((r.id, r.identifier) for r in maintain.split_by_ranges(df, ranges).collect()) == [(10, "2024_1"), (11, "2024_2"), (12, "2024_1")]
    corpus.write(df, str(tmp_path / "c"))
    facts = maintain.optimize(spark, str(tmp_path / "c"), str(tmp_path / "o"))
    assert (facts["rows_before"], facts["rows_after"]) == (4, 3)
    back = corpus.load(spark, str(tmp_path / "o"))
    maintain.write_postings(back, str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    assert {r.token: r.documents for r in maintain.document_frequency(index).collect()} == {"a": 2, "x": 2, "b": 1}
    for words in ("a", "a x", '"a x" OR b', "a NOT x", "b*", "NEAR(a x, 2)", '""'):
        assert sorted((r.db_id, r.id) for r in maintain.postings_matches(back, index, words).collect()) == sorted((r.db_id, r.id) for r in search.matches(back, words).collect()), words


def test_download_plan(spark):
    plan = calendar.download_plan(spark, "2024-01-12", "2024-01-15", today="2024-02-01")
    assert plan.count() == 10 and "2024/01/20240112_Judicial_Capital_1.pdf" in {r.path for r in plan.collect()}
    there = spark.createDataFrame([("2024/01/20240112_Judicial_Capital_1.pdf",)], "path string")
    assert calendar.download_plan(spark, "2024-01-12", "2024-01-15", there, today="2024-01-14").count() == 4


def test_ingested_rows_are_optimized(spark, tmp_path):
    """Ids of ingested rows are hashes over the whole range of longs."""
    files = spark.createDataFrame([(f"d/202{k}0115_a.txt", GAZETTE + f" Processo 000000{k}-00.2022.8.26.0100 x. Processo 0000009-00.2022.8.26.0100 y") for k in range(4)] + [("d/20200116_b.txt", GAZETTE)], "file_path string, text string")
    rows = ingest.paragraphs(files)
    assert rows.where("id < 0").isEmpty() and maintain.keys_are_unique(rows)
    corpus.write(rows, str(tmp_path / "c"))
    facts = maintain.optimize(spark, str(tmp_path / "c"), str(tmp_path / "o"))
    assert (facts["rows_before"], facts["rows_after"]) == (18, 16)
    back = corpus.load(spark, str(tmp_path / "o"))
    assert sorted((r.db_id, r.id) for r in back.collect()) == [(f"legal_documents_202{k}", i) for k in range(4) for i in range(4)]
    wide = spark.createDataFrame([(i, "s") for i in (-(2**63), -5, 0, 7, 2**62, 2**63 - 1)], "id long, db_id string")
    for rows_a_block in (1, 2, 100):
        numbered = maintain.renumbered(wide.withColumn("old", F.col("id")), rows_a_block).orderBy("old").collect()
        assert [r.id for r in numbered] == [0, 1, 2, 3, 4, 5]


def test_shards_are_optimized_one_by_one(spark, tmp_path):
    day = datetime.date(2024, 6, 30)
    rows = spark.createDataFrame([(k, "n", "same" if k < 3 else f"text {k}", "f", day, f"s{k % 2}") for k in range(6)], "id long, process_number string, content string, file_path string, document_date date, db_id string")
    corpus.write(rows, str(tmp_path / "c"))
    (tmp_path / "c" / "db_id=s1" / "part-x.parquet").write_bytes(b"no parquet")
    found = {x["db_id"]: x for x in maintain.optimize_shards(spark, str(tmp_path / "c"), str(tmp_path / "o"))}
    assert (found["s0"]["rows_before"], found["s0"]["rows_after"], found["s0"]["error"]) == (3, 2, None) and found["s1"]["error"]
    assert {r.db_id for r in corpus.load(spark, str(tmp_path / "o")).collect()} == {"s0"}


def test_extractor_errors_are_kept(spark, tmp_path):
    (tmp_path / "20240116_b.pdf").write_bytes(b"broken")

    def read(raw):
        raise ValueError("no text layer")

    assert [(r.text, r.error) for r in binary_files(spark, str(tmp_path), read).collect()] == [("", "ValueError: no text layer")]


def test_python_workers_get_texts_by_bytes(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    rows = F.pandas_udf(lambda texts: pd.Series([len(texts)] * len(texts)), "long")
    text = F.repeat(F.lit("x"), F.lit(1 << 20))
    found = spark.range(40, numPartitions=1).select(F.length(decompress_content(compress_content(text))).alias("n"), rows(text).alias("rows"))
    assert {(r.n, r.rows <= 5) for r in found.collect()} == {(1 << 20, True)}
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    decompress_content(compress_content(text))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("1m", "1048576b")  # less is kept
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
