"""Operator 2: removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every byte covered by a ``length``-byte string that also starts elsewhere, in any document, goes. Equal texts are
repeated wholly and are sorted once. Of the others, suffixes are taken at content-chosen anchors (see
``suffix_runs``), of which every window of ``length`` bytes has exactly one, and equal windows have it at the same place:

1. Hashes of the anchors' grams are counted; an anchor whose gram occurs once has no repeated window.
2. The remaining suffixes are sorted in each task into front-coded runs, equal ones joined, and exchanged by ranges of
   their first bytes (splitters come from a bounded sample of documents; they only balance the ranges).
3. Each range merges its runs with a loser tree that compares no prefix twice. The shared prefixes that come out show
   which suffixes are equal as far as their windows reach (all of these are repeated) and which share an anchor; among
   the latter, windows are compared one by one, by hashes first and then byte by byte.
4. Stretches of repeated windows are gathered per text, and texts that have any are cut.

A gram with more than ``hot`` anchors would make its range too large for a task. Its suffixes are counted by digest
instead, with sums before the shuffle, and the windows of those that occur once by digests of the windows; so no
group of any size meets in one task.

Texts go through a shuffle only if they have candidates; id tables are broadcast only if their row count, which is
known by then, keeps them under 16 MB.

Defined cases: a null text is empty; texts under ``length`` bytes keep everything; rows with equal ids are documents of
their own, and equal ones are repeats of each other; columns besides the id and the text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .common import small as _small
from .near_duplicates import _node
from .suffix_runs import GRAM, anchors, collapse, decode_run, encode_run, entry, groups, merge, part_of, pieces, repeated

LENGTH, HOT, RUN_BYTES, RANGE_SUFFIXES, SAMPLE_TEXTS = 200, 50_000, 48 << 20, 40_000, 500


def _text_anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, offset of the part, places, first windows, last windows, gram hashes), in order of the texts."""
    parts = [(k, a, t) for k, text in enumerate(texts) for a, t in pieces(text, length)]
    for own in groups(parts):
        owner, place, low, high, gram = anchors([t for _, _, t in own], length)
        cut = np.searchsorted(owner, np.arange(len(own) + 1))
        for (k, offset, _), a, b in zip(own, cut[:-1].tolist(), cut[1:].tolist()):
            yield k, offset, place[a:b] + offset, low[a:b] + offset, high[a:b] + offset, gram[a:b]


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[bytes, int, bytes, int, int]]:
    """(entry, bytes before the anchor, node, first window, gram) of batches (node, text, places of the anchors wanted)."""
    for batch in slices(batches, 1, 4 << 20):
        texts, wanted = [t.encode() for t in batch.column(1).to_pylist()], batch.column(2).to_pylist()
        nodes = batch.column(0).to_pylist()
        for k, _, place, low, high, gram in _text_anchors(texts, length):
            take = np.flatnonzero(np.isin(place, wanted[k]))
            for p, a, b, g in zip(place[take].tolist(), low[take].tolist(), high[take].tolist(), gram[take].view(np.int64).tolist()):
                yield entry(texts[k], p, a, b, length), p - a, nodes[k], a, g


def _merged_stretches(candidates: DataFrame, n_suffixes: int, length: int) -> DataFrame:
    """(node, start, stop) of repeated stretches from (node, text, wanted)."""
    spark = candidates.sparkSession
    n_ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_suffixes // RANGE_SUFFIXES)
    share = max(1, candidates.count() // SAMPLE_TEXTS)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = [s[0][:GRAM] for s in _suffixes(batches, length)]
        yield pa.record_batch([pa.array(grams[:: 1 + len(grams) // 20_000], pa.binary())], names=["gram"])

    sample = candidates.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0)
    grams = sorted(bytes(r.gram) for r in sample.mapInArrow(firsts, "gram binary").orderBy(F.xxhash64("gram")).limit(100_000).collect())
    splitters = spark.sparkContext.broadcast([grams[len(grams) * k // n_ranges] for k in range(1, n_ranges)] if grams else [])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, run, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            ranges = [(part, encode_run(list(own))) for part, own in groupby(collapse(rows), key=lambda e: part_of(e[0], splitters.value))]
            parts, blobs = zip(*ranges)
            return pa.record_batch([pa.array(parts, pa.int32()), pa.array([task << 20 | run] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["range", "run", "entries"])

        for string, before, node, start, _ in _suffixes(batches, length):
            rows.append((string, before, node, start))
            size += len(string) + 100
            if size > RUN_BYTES:
                yield out()
                rows, size, run = [], 0, run + 1
        if rows:
            yield out()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        found: list[tuple[bytes, int, int]] = []

        def out() -> pa.RecordBatch:
            node, start, stop = zip(*found)
            return pa.record_batch([pa.array(node, pa.binary()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["node", "start", "stop"])

        for _, own in groupby(runs, key=lambda r: r[0]):
            groups, waiting = [], 0
            for share, e in merge([decode_run(blob) for _, blob in own]):
                if share < GRAM:
                    if waiting > 5_000:
                        found += repeated(groups, length)
                        groups, waiting = [], 0
                    groups.append([])
                groups[-1].append(e)
                waiting += 1
                if len(found) > 50_000:
                    yield out()
                    found = []
            found += repeated(groups, length)
        if found:
            yield out()

    exchanged = candidates.mapInArrow(sort, "range int, run long, entries binary").repartition(n_ranges // 4, "range").sortWithinPartitions("range", "run")
    return exchanged.select("range", "entries").mapInArrow(resolve, "node binary, start long, stop long")


def _hot_stretches(candidates: DataFrame, length: int) -> DataFrame:
    """The same for anchors of hot grams, by counted digests instead of ranges."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # cut small: each row may have many suffixes
            for k in range(0, batch.num_rows, 64):
                rows = [(xxhash.xxh3_128_digest(s), s, before, node, start) for s, before, node, start, _ in _suffixes(iter([batch.slice(k, 64)]), length)]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.record_batch([pa.array(cols[j], t) for j, t in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()))], names=["digest", "string", "before", "node", "start"])

    rows = stored(candidates.mapInArrow(digest, "digest binary, string binary, before int, node binary, start long"), "hot-suffixes")
    counted = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("node", "start")).alias("at")), "hot-digests")
    several = counted.where("n > 1").select("digest")
    whole = rows.join(several, "digest").select("node", "start", (F.col("start") + F.length("string") - 1).alias("stop"))
    one_each = rows.join(counted, "digest").where((F.col("node") == F.col("at.node")) & (F.col("start") == F.col("at.start"))).select("string", "before", "node", "start", (F.col("n") > 1).alias("twice"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s, b = row["string"], row["before"]
                text = s[len(s) - b :][::-1] + s[: len(s) - 1 - b]
                n = len(text) - length + 1
                yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(text[k : k + length]) for k in range(n)], pa.binary()), pa.array([row["node"]] * n, pa.binary()), pa.array([row["start"] + k for k in range(n)], pa.int64()), pa.array([row["twice"]] * n, pa.bool_())], names=["window", "node", "start", "twice"])

    single = one_each.mapInArrow(windows, "window binary, node binary, start long, twice boolean")
    again = single.groupBy("window").agg(F.count("*").alias("n"), F.max("twice").alias("any")).where("n > 1 or any").select("window")
    return whole.unionAll(single.join(again, "window").select("node", "start", (F.col("start") + length).alias("stop")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256; and ``kept``, the remaining bytes, if asked for."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.select("id", _node(F.col("text")).alias("node"), "text")
    kind = source.schema["id"].dataType.simpleString()

    def hash_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 2 << 20):
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            grams: list[list[np.ndarray]] = [[] for _ in texts]
            places: list[list[np.ndarray]] = [[] for _ in texts]
            for k, _, place, _, _, gram in _text_anchors(texts, length):
                grams[k].append(gram.view(np.int64))
                places[k].append(place.astype(np.int64))
            n = [sum(map(len, g)) for g in grams]
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            flat = lambda xs: pa.array(np.concatenate([x for own in xs for x in own] or [np.zeros(0, np.int64)]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.ListArray.from_arrays(offsets, flat(grams)), pa.ListArray.from_arrays(offsets, flat(places))], names=["id", "node", "n_bytes", "sha", "grams", "places"])

    hashed = stored(source.mapInArrow(hash_grams, f"id {kind}, node binary, n_bytes long, sha string, grams array<long>, places array<long>"), "anchors")
    copies = stored(hashed.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select(F.col("node").alias("copied"), "first"), "copies")
    later = _small(copies, 64)
    chosen = lambda df: df.join(later, (F.col("node") == F.col("copied")), "left").where(F.col("copied").isNull() | F.col("id").eqNullSafe(F.col("first")))
    each = chosen(hashed).select("node", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("node", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    often = stored(each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    wanted = stored(each.join(often, "gram").groupBy("node").agg(F.collect_set(F.when(F.col("n") <= hot, F.col("place"))).alias("wanted"), F.collect_set(F.when(F.col("n") > hot, F.col("place"))).alias("hot")), "wanted")

    named = _small(wanted.select("node"), 48)
    texts = chosen(source.join(named, "node", "left_semi")).select("node", "text")
    with_places = stored(texts.join(wanted, "node").dropDuplicates(["node"]), "candidates")
    n_suffixes = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    stretches = _merged_stretches(with_places.where(F.size("wanted") > 0).select("node", "text", "wanted"), n_suffixes, length)
    is_hot = with_places.where(F.size("hot") > 0).select("node", "text", "hot")
    if not is_hot.isEmpty():
        stretches = stretches.unionAll(_hot_stretches(is_hot, length))
    per_text = stretches.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("stretches"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 4 << 20):
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, kept, spans, end, removed = text.encode(), [], 0, 0, 0
                last = -1
                for x in found:
                    if x["start"] > last:  # apart from the run before
                        kept.append(raw[end : x["start"]])
                        spans, removed, end = spans + 1, removed + x["stop"] - x["start"], x["stop"]
                    elif x["stop"] > end:
                        removed, end = removed + x["stop"] - end, x["stop"]
                    last = end
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((removed, spans, hashlib.sha256(left).hexdigest(), left if with_kept else None))
            n, s, h, k = zip(*out) if out else ((),) * 4
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string()), pa.array(k, pa.binary())], names=["node", "removed", "spans", "kept_sha", "left"])

    changed = stored(with_places.select("node", "text").join(per_text, "node").mapInArrow(cut, "node binary, removed long, spans long, kept_sha string, left binary"), "cut")
    result = hashed.select("id", "node", "n_bytes", "sha").join(changed, "node", "left").join(later.select("copied"), F.col("node") == F.col("copied"), "left")
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= length)
    columns = [F.col("id").alias(id_col), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"), F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256")]
    if with_kept:
        whole = source.select(F.col("id").alias("i"), F.col("node").alias("n"), F.col("text").cast("binary").alias("whole")).dropDuplicates(["i", "n"])
        result = result.join(whole, F.col("id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("n")))
        columns.append(F.when(gone, F.lit(b"")).otherwise(F.coalesce("left", "whole")).alias("kept"))
    return result.select(*columns)
