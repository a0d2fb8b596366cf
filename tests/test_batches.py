"""Bitmaps, intervals, many terms, ingest without repeats, and bulk exports, against plain code."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import distincts, intervals
from foliant.plans import filters
from foliant.sinks.export_source import read_export, write_export
from foliant.streaming.ingest import ingest_files, ingested

DAY = datetime.date(2023, 1, 1)


def test_distinct_cases_of_any_dates(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(90)}" if rng.random() > 0.1 else None, DAY + datetime.timedelta(rng.randrange(400)) if rng.random() > 0.1 else None, f"s{k % 2}") for k in range(600)]
    p = spark.createDataFrame(rows, "process_number string, document_date date, db_id string")
    distincts.write_bitmaps(p, str(tmp_path / "b"))
    asked = [(k, DAY + datetime.timedelta(a), DAY + datetime.timedelta(b)) for k, (a, b) in enumerate([(0, 30), (0, 399), (5, 5), (31, 58), (30, 59), (10, 120), (100, 99), (-50, 900), (334, 364), (700, 800)])]
    got = {r.range_id: r.n_cases for r in distincts.distinct_cases(spark.read.parquet(str(tmp_path / "b")), spark.createDataFrame(asked, "range_id long, start_date date, end_date date")).collect()}
    want = {k: len({n for n, d, _ in rows if n and d and a <= d <= b}) for k, a, b in asked}
    assert got == {k: n for k, n in want.items() if n}
    whole = distincts.periods(spark.createDataFrame(asked[1:2], "range_id long, start_date date, end_date date"))
    assert whole.count() < 30  # 13 months and some days, not 400 days


def test_overlaps_like_all_pairs(spark):
    rng = random.Random(9)
    make = lambda n, low, high: [(k, s, s + rng.choice([0, 0, 1, 5, 300]) if s is not None else 4) for k in range(n) for s in [rng.choice([None, *range(low, high)])]] + [(900, 7, 3), (901, None, None), (902, 0, 5000)]
    left, right = make(150, 0, 200), make(120, 50, 400)
    pairs = intervals.overlapping(spark.createDataFrame(left, "a long, start long, end long"), spark.createDataFrame(right, "b long, other_start long, other_end long"))
    got = sorted((r.a, r.b) for r in pairs.collect())
    assert got == sorted((a, b) for a, s, e in left for b, t, f in right if None not in (s, e, t, f) and s <= e and t <= f and s <= f and t <= e)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    few = spark.range(1).select(F.size(intervals.pieces(F.lit(3), F.lit(10**9))).alias("n")).first().n
    assert few <= 2 * 31
    inside = intervals.stabbed(spark.createDataFrame([(k,) for k in range(30)], "p long"), F.col("p"), spark.createDataFrame([(1, 3, 9), (2, 9, 9)], "r long, s long, e long"), F.col("s"), F.col("e"))
    assert sorted((r.p, r.r) for r in inside.collect()) == [(p, 1) for p in range(3, 9)] + [(9, 1), (9, 2)]


def test_totals_of_overlaps_without_pairs(spark):
    rng = random.Random(3)
    make = lambda n: [(k, s, s + rng.choice([0, 0, 1, 4, 90]) if s is not None else 4) for k in range(n) for s in [rng.choice([None, *range(60)])]] + [(900, 7, 3), (901, None, None), (902, 0, 5000)]
    left, right = make(150), make(400)
    found = intervals.overlap_totals(spark.createDataFrame(left, "a long, start long, end long"), spark.createDataFrame(right, "b long, other_start long, other_end long"), "b")
    want = {}
    for s, e in {(s, e) for _, s, e in left if s is not None and s <= e}:
        met = [b for b, t, f in right if t is not None and t <= f and s <= f and t <= e]
        want |= {(s, e): (len(met), min(met), max(met))} if met else {}
    assert {(r.start, r.end): (r.n, r.low, r.high) for r in found.collect()} == want
    day = lambda copies: spark.range(copies).select("id", F.lit(5).alias("start"), F.lit(5).alias("end"))
    many = intervals.overlap_totals(day(300_000), day(300_000).toDF("other", "other_start", "other_end"), "other")  # 9e10 pairs
    assert [tuple(r) for r in many.collect()] == [(5, 5, 300_000, 0, 299_999)]


@pytest.mark.parametrize("terms", ["a b c ab", '"" x', "xyz ÜBER abc", "q " * 40])
def test_many_terms_like_few(spark, monkeypatch, terms):
    rng = random.Random(4)
    texts = [None, "", "Über", *("".join(rng.choices("abcxyz Ü", k=rng.randint(0, 8))) for _ in range(80))]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    each = frame.select(filters.holds_excluded(terms, F.col("t")).alias("x")).collect()
    monkeypatch.setattr(filters, "MANY_TERMS", 0)
    assert [r.x for r in frame.select(filters.holds_excluded(terms, F.col("t")).alias("x")).collect()] == [r.x for r in each]


def test_repeated_paragraphs_aren_t_appended(spark, tmp_path):
    case = "Processo 0000001-01.2020.8.26.0001 "
    texts = [[case + "a", case + "b"], [case + "a", case + "a ", case + "c " + case + "b"], [case + "d", case + "c"]]
    folder = lambda x: str(tmp_path / x)
    for k, batch in enumerate(texts):
        spark.createDataFrame([(f"d/20200101_{k}{i}.txt", t) for i, t in enumerate(batch)] + [(f"d/2021010{k + 1}_z.txt", case + "a")], "file_path string, text string").coalesce(1).write.mode("append").parquet(folder("files"))
        source = spark.readStream.schema("file_path string, text string").parquet(folder("files"))
        ingest_files(source, folder("corpus"), folder("ledger"), folder("checkpoint"), folder("digests")).awaitTermination()
    got = sorted((r.db_id[-4:], r.content[-1]) for r in ingested(spark, folder("corpus")).collect())
    assert got == [("2020", "a"), ("2020", "b"), ("2020", "c"), ("2020", "d"), ("2021", "a")]
    last = max(os.listdir(folder("checkpoint/commits")), key=lambda n: (n.isdigit(), n))
    for name in (last, f".{last}.crc"):  # as if the last batch had failed before its commit
        if os.path.exists(folder(f"checkpoint/commits/{name}")):
            os.remove(folder(f"checkpoint/commits/{name}"))
    source = spark.readStream.schema("file_path string, text string").parquet(folder("files"))
    ingest_files(source, folder("corpus"), folder("ledger"), folder("checkpoint"), folder("digests")).awaitTermination()
    assert sorted((r.db_id[-4:], r.content[-1]) for r in ingested(spark, folder("corpus")).collect()) == got
    assert spark.read.parquet(folder("ledger")).count() == 10


def test_exports_appear_as_a_whole(spark, tmp_path):
    rows = [(k, f'quoted "{k}", line\nbreak é' if k % 3 else None, 1.5) for k in range(50)]
    frame = spark.createDataFrame(rows, "id long, text string, v double").repartition(4)
    path = str(tmp_path / "e")
    write_export(frame, path, "=== Summary ===\r\n")
    assert sorted((int(r.id), r.text) for r in read_export(spark, path).collect()) == [(k, t) for k, t, _ in rows]
    assert open(f"{path}/head.csv", encoding="utf-8", newline="").read() == "﻿=== Summary ===\r\nid,text,v\r\n"
    with pytest.raises(Exception, match="there is an export"):
        write_export(frame, path)
    write_export(frame.limit(3), path, overwrite=True)
    assert read_export(spark, path).count() == 3
    failing = frame.withColumn("text", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        write_export(failing, str(tmp_path / "f"))
    assert not os.path.exists(tmp_path / "f" / "export.json") and not [x for x in os.listdir(tmp_path / "f") if x.startswith(("part", "_parts"))]
    write_export(frame.limit(0), str(tmp_path / "g"))
    assert read_export(spark, str(tmp_path / "g")).count() == 0


def test_line_breaks_inside_exported_texts(spark, tmp_path):
    texts = ["a\nb", "a\rb", "a\r\nb", "\r\n", '"\n', "ends\n", "ends\r", "plain", " x ", "\ufeffy", "k" * 200_000, None, "\u2028\x00\x1a\\"]
    for k, text in enumerate(texts):  # each of them first in a part
        rows = [(str(i), t) for i, t in enumerate([text, *texts])]
        write_export(spark.createDataFrame(rows, "id string, text string").coalesce(1), str(tmp_path / str(k)))
        assert sorted((int(r.id), r.text) for r in read_export(spark, str(tmp_path / str(k))).collect()) == [(int(i), t) for i, t in rows]
