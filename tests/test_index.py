"""Index, segments, substrings and pages against scans and plain code."""

import collections
import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliant.operators import corpus, jobs, maintain, ordered, pages, search, segments, substrings
from foliant.operators.index import IndexSearch, write_dictionary

SCHEMA = "id long, process_number string, content string, file_path string, document_date date, db_id string"
WORDS = ("der", "die", "Süd", "sudan", "x1", "die")


def number(k):
    return f"{k:07d}-{k % 97:02d}.{2019 + k % 5}.8.26.{1 + k % 30:04d}"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    day = datetime.date(2020, 1, 1)
    out = []
    for i in range(240):
        date = None if i % 40 == 7 else day + datetime.timedelta(rng.randrange(1500))
        case = 5 if i % 3 == 0 else rng.randrange(60)  # one case has a third of all rows
        text = rng.choice(["", None]) if i % 50 == 3 else " ".join(rng.choices(WORDS, k=rng.randint(1, 30))) + rng.choice([".", " Worthless!", " hopeless"])
        out.append((i, number(case), text, "f", date, None if i % 37 == 5 else f"s{date.year if date else 0}"))
    return spark.createDataFrame(out, SCHEMA).repartition(4).persist()


@pytest.fixture(scope="module")
def stored_index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    corpus.write(rows, f"{path}/p")
    p = corpus.load(spark, f"{path}/p")
    maintain.write_postings(p, f"{path}/i")
    index = spark.read.parquet(f"{path}/i")
    write_dictionary(index, f"{path}/d")
    dictionary = spark.read.parquet(f"{path}/d")
    substrings.write_grams(dictionary, "token", f"{path}/g")
    substrings.write_grams(p, "process_number", f"{path}/n")
    return p, index, dictionary, spark.read.parquet(f"{path}/g"), spark.read.parquet(f"{path}/n")


ASKED = ["der", "sud", '"der die"', '"die die die"', '"der su"*', "su*", '"die x"* OR worthless', "NEAR(der x1, 1)", "NEAR(der x1 sud, 4)", 'NEAR("die die" sudan, 2)', "NEAR(die die, 0)", "NEAR(su* der, 2)", "der NOT die", "(der OR x1) AND sud NOT worthless", '"" ', "nowhere", '"der nowhere"', 'sud + "die"']


@pytest.mark.parametrize("words", ASKED)
def test_the_index_answers_like_a_scan(stored_index, words):
    p, index, dictionary, *_ = stored_index
    found = IndexSearch(index, dictionary).matches(p.select("id", "db_id"), words)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in search.matches(p, words).collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("content" in x for x in re.findall(r"ReadSchema: .*", plan))


def test_a_request_with_the_index(stored_index):
    p, index, dictionary, *_ = stored_index
    asked = dict(keywords='"der die" NOT x1', start="2020-06-01", exclusion="hopeless", page_size=10, shards=corpus.manifest(p))
    plain, looked_up = search.search(p, **asked), search.search(p, **asked, index=IndexSearch(index, dictionary))
    assert plain.total_processes == looked_up.total_processes > 0 and [r.asDict(True) for r in plain.results.collect()] == [r.asDict(True) for r in looked_up.results.collect()]
    assert search.search(p, "(der", on_error="empty", index=IndexSearch(index, dictionary)).total_processes == 0


def test_prefixes_are_ranges_of_tokens(stored_index):
    _, index, dictionary, *_ = stored_index
    plan = index.where(F.startswith("token", F.lit("su")))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,su)" in plan
    often = IndexSearch(index, dictionary).frequencies([search_phrase for search_phrase in _phrases("su* OR der")])
    assert often[("su", True)] > 0 and often[("der", False)] > 0


def _phrases(words):
    from foliant.operators.index import phrases
    from foliant.plans.keywords import parse, sanitize

    return list(phrases(parse(sanitize(words))))


def listed(index):
    return sorted((r.db_id or "", r.token, r.id, tuple(r.positions)) for r in index.collect())


def test_segments_follow_the_corpus(spark, rows, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "s"), fan_in=2)
    assert index.postings().count() == 0 and index.merge() == 0
    live = {}
    rng = random.Random(3)
    every = {r.id: r for r in rows.collect()}
    for step in range(6):
        new = [every[i] for i in every if i % 6 == step]
        old = rng.sample(sorted(live), min(len(live), 15))
        changed = [(live[i].id, live[i].process_number, f"changed {step} sud", "f", live[i].document_date, live[i].db_id) for i in old[:7]]
        gone = spark.createDataFrame([(live[i].db_id, i) for i in old], "db_id string, id long") if old else None
        added = spark.createDataFrame([tuple(r) for r in new] + changed, SCHEMA)
        assert index.apply(added, gone, batch=f"b{step}")
        for i in old:
            del live[i]
        for r in added.collect():
            live[r.id] = r
        assert not index.apply(added, gone, batch=f"b{step}")  # comes again
        if step % 2:
            index.merge()
        index = segments.SegmentedIndex(spark, str(tmp_path / "s"), fan_in=2)  # as after a restart
    rebuilt = maintain.postings(spark.createDataFrame([tuple(r) for r in live.values()], SCHEMA))
    assert listed(index.postings()) == listed(rebuilt)
    index.merge()
    state = index.state()
    assert listed(index.postings()) == listed(rebuilt) and len(state["segments"]) <= 3
    assert index.clean() > 0 and listed(index.postings()) == listed(rebuilt)


def test_two_writers_of_segments(spark, rows, tmp_path):
    first, second = (segments.SegmentedIndex(spark, str(tmp_path / "s")) for _ in range(2))
    state = second.state()
    first.apply(rows.limit(5))
    with pytest.raises(segments.SegmentConflict):
        second._commit(state)
    assert first.postings().count() == maintain.postings(rows.limit(5)).count()


@pytest.mark.parametrize("pattern", ["8.26.0007", "%", "00000_5-", "5-05.2%8.26", "12", "", "  ", "\\", "x", "0000005-05.2019.8.26.0006"])
def test_number_patterns(stored_index, pattern):
    p, *_, numbers = stored_index
    assert sorted(r.id for r in substrings.with_number(p, numbers, pattern).select("id").collect()) == sorted(r.id for r in search.matches(p, process_number=pattern).collect())


@pytest.mark.parametrize("terms", ["worthless", "ORTHLES", '"hless!"', '"süd die"', "x1 opele", '""', "!", "nowhere", "ss", None])
def test_exclusion_by_parts_of_words(stored_index, terms):
    p, index, _, grams, _ = stored_index
    found = search.matches(p, "der")
    want = sorted(r.id for r in search.without_excluded(found, terms).collect())
    assert sorted(r.id for r in substrings.without_excluded(found.drop("content"), p, index, grams, terms).select("id").collect()) == want


def test_few_contents_are_read_for_rare_parts(stored_index):
    p, index, _, grams, _ = stored_index
    total, suspects = p.count(), substrings.holding(p, index, grams, "orthless!").count()
    assert 0 < suspects < total / 2


@pytest.mark.parametrize("words, exclusion, size", [(None, None, 3), ("sud", None, 5), ("sud", "worthless", 5), (None, "hopeless worthless", 4), (None, "der", 500), ("nowhere", None, 3)])
def test_newest_cases(rows, words, exclusion, size):
    shards = corpus.manifest(rows)
    got = pages.newest_cases(rows, shards, size, words, exclusion=exclusion)
    want = search.page_of(search.cases(search.matches(rows, words), exclusion), 1, size)
    assert [tuple(r) for r in got.cases.select("process_number", "mention_count", "last_date").collect()] == [tuple(r) for r in want.collect()]
    assert got.shards == shards.count() and got.shards_read <= got.shards and (exclusion or words == "nowhere" or got.shards_read < got.shards)


def test_pages_by_place_and_cursor(spark):
    rng = random.Random(6)
    day = datetime.date(2024, 1, 1)
    keys = [(number(k), 1, None if k % 10 == 0 else day if k % 3 == 0 else day + datetime.timedelta(rng.randrange(40))) for k in range(300)]
    frame = spark.createDataFrame(keys, "process_number string, mention_count long, last_date date").repartition(5)
    want = [tuple(r) for r in search.by_recency(frame).collect()]
    index = pages.PageIndex(frame)
    assert index.total == 300 and index.pages(7) == 43
    for page in (1, 2, 20, 43, 44):
        assert sorted(tuple(r) for r in index.page(page, 7).collect()) == sorted(want[(page - 1) * 7 : page * 7])
    cursors = {r.page: r for r in index.cursors(7).collect()}
    assert sorted(cursors) == list(range(2, 44))
    for page in (2, 30, 43):
        got = pages.page_after(frame, cursors[page].last_date, cursors[page].process_number, 7)
        assert [tuple(r) for r in got.collect()] == want[(page - 1) * 7 : page * 7]
    assert pages.PageIndex(frame.limit(0)).total == 0 and pages.PageIndex(frame.limit(0)).page(1).count() == 0


def test_places_with_a_hot_group_and_large_ids(spark):
    base = 2**60
    rows = [(None if k % 9 == 0 else "hot" if k % 2 else f"g{k % 5}", base + k * (1 if k % 3 else -1), 1.0) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, id long, v double").repartition(6)
    got = {(r.g, r.id): (r.place, r.place_of) for r in ordered.places(frame, ["g"], [F.col("id").asc()], ranges=16).collect()}
    by = collections.defaultdict(list)
    for g, i, _ in rows:
        by[g].append(i)
    assert got == {(g, i): (k, len(own)) for g, own in by.items() for k, i in enumerate(sorted(own))}
    numbered = jobs.numbered(frame, F.col("v"), F.col("id"), parts=16).orderBy("ordinal").collect()  # one value, ids over 2**53
    assert [(r.ordinal, r.id) for r in numbered] == list(enumerate(sorted(i for _, i, _ in rows)))
    spread = frame.repartitionByRange(16, "v", "id").groupBy(F.spark_partition_id().alias("k")).count().agg(F.max("count")).first()[0]
    assert spread < 100
    few = spark.createDataFrame([(f"{k}", "s") for k in range(200)] + [(str(2**62), "s")], "id string, db_id string").select(F.col("id").cast("long"), "db_id")
    assert sorted(r.id for r in maintain.renumbered(few).collect()) == list(range(201))


def test_a_case_with_very_many_mentions(rows):
    found = search.matches(rows)
    parts = search.nested(found, most=7).collect()
    hot = [r for r in parts if r.process_number == number(5)]
    whole = [r for r in search.nested(found, most=10_000).collect() if r.process_number == number(5)]
    assert [r.part for r in hot] == list(range(len(hot))) and len(hot) > 10 and all(len(r.mentions) <= 7 for r in parts)
    assert [m for r in hot for m in r.mentions] == whole[0].mentions and whole[0].mention_count == sum(len(r.mentions) for r in hot)
    labels = [r.mention_index for r in search.labelled(found).where(F.col("process_number") == number(5)).orderBy(*search.newest()).collect()]
    assert labels == list(range(1, whole[0].mention_count + 1))


def test_some_shards_are_late(spark, rows):
    stuck = rows.where("db_id = 's2021'").first().id
    slow = F.udf(lambda i, text: time.sleep(40) if i == stuck else text, "string")
    late = rows.withColumn("content", F.when(F.col("id") == stuck, slow("id", "content")).otherwise(F.col("content")))
    shards = corpus.manifest(rows)
    began = time.monotonic()
    page = search.search(late, "sud", page_size=500, shards=shards, deadline_seconds=15)
    there = search.cases(search.matches(rows.where("db_id != 's2021' or db_id is null"), "sud"))
    assert page.truncated and 0 < page.total_processes <= there.count() and time.monotonic() - began < 100
    assert "s2021" not in {m.db_id for r in page.results.collect() for m in r.mentions}


def test_postings_come_in_sorted_runs_of_bounded_size(spark):
    import pyarrow as pa

    from foliant.functions.arrow import joined

    texts = [None, "", *(" b é a ä zz " * (k % 7) for k in range(400))]
    batches = pa.record_batch({"s": ["x"] * len(texts), "text": pa.array(texts, pa.string())}).slice
    runs = list(joined((batches(k, 50) for k in range(0, len(texts), 50)), 1, 1000))
    assert [t for r in runs for t in r.column(1).to_pylist()] == texts and max(sum(len(t or "") for t in r.column(1).to_pylist()) for r in runs) < 3000
    rows = spark.createDataFrame([("s", 500 - k, t or "") for k, t in enumerate(texts)], "db_id string, id long, content string").coalesce(1)
    index = maintain.postings(rows)
    found = [(r.token.encode(), r.id) for r in index.collect()]
    assert found == sorted(found) and len(found) == len(set(found)) == 4 * sum(k % 7 > 0 for k in range(400))
    assert "Sort" not in index._jdf.queryExecution().executedPlan().toString()


def test_postings_of_many_texts_take_little_memory(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    texts = pa.array([" " + " ".join(rng.choices(words, k=2000)) + " " for _ in range(200)])
    batch = pa.record_batch([pa.array(["s"] * 200), texts, pa.array(range(200), pa.int64())], names=["db_id", "text", "id"])
    made = []
    frame = spark.createDataFrame([], SCHEMA)
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: made.append(f))
    maintain.postings(frame)
    usual, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in made[0](batch for _ in range(8)))
        peak = (tracemalloc.get_traced_memory()[1] + pool.max_memory()) / 2**20
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)
    assert n == 8 * sum(len(set(t.split())) for t in texts.to_pylist()) and texts.nbytes > 2 << 20
    assert peak < 90, peak


def test_runs_are_the_same_whatever_the_slices():
    import pyarrow as pa

    from foliant.functions.arrow import by_token, posting_runs

    rng = random.Random(5)
    texts = [None, "", " ", *(" " + " ".join(rng.choices(["b", "\u00e9", "a", "zz", "\U0001f600", "\uffff"], k=rng.randrange(40))) + " " for _ in range(500))]
    ids = [None if k % 50 == 0 else rng.randrange(-100, 100) for k in range(len(texts))]
    batch = pa.record_batch([pa.array([None if k % 7 == 0 else f"s{k % 3}" for k in range(len(texts))]), pa.array(texts, pa.string()), pa.array(ids, pa.int64())], names=["db_id", "text", "id"])
    want = []
    for k, t in enumerate(texts):
        at = collections.defaultdict(list)
        for place, token in enumerate((t or "").split()):
            at[token].append(place)
        want += [(batch.column(0)[k].as_py(), token, ids[k], places) for token, places in at.items()]
    want.sort(key=lambda x: (x[1].encode(), x[2] is not None, x[2] or 0))
    for slice_bytes in (1, 700, 1 << 20):
        [(keys, row, token, places)] = posting_runs((batch.slice(k, 60) for k in range(0, len(texts), 60)), 1 << 30, slice_bytes)
        order = by_token(token, row, keys.column(1))
        assert [(keys.column(0)[row[k]].as_py(), token[k].as_py(), keys.column(1)[row[k]].as_py(), places[k].as_py()) for k in order] == want
    empty = pa.record_batch([pa.array(["s"] * 1000), pa.nulls(1000, pa.string()), pa.array(range(1000), pa.int64())], names=["db_id", "text", "id"])
    assert [run[0].num_rows for run in posting_runs((empty for _ in range(6)), 30_000, 1000)] == [2000] * 3
    assert list(posting_runs(iter([]))) == []


def test_places_in_few_groups_deal_no_rows_by_group(spark):
    from foliant.operators.ordered import places

    rows = spark.range(1000).selectExpr("id", "cast(id % 2 as string) as g", "repeat('x', 100) as content")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = places(rows, ["g"], [F.col("id").asc()])
        assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()
        assert {(r.id, r.place, r.place_of) for r in placed.collect()} == {(k, k // 2, 500) for k in range(1000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
