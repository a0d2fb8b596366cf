"""Operator 7: token ids in Re-Pair compressed shards with random access.

Documents are range-partitioned by id (rows of one id by the beginnings of their texts) and sorted, so that part by part
their ids follow each other in ascending document order. Each task encodes its texts, appends the end id to every
document, gathers documents into shards of about ``shard_ids`` ids and writes each as one packed grammar:
rules, expansion lengths, document ends, symbols (see ``grammar``). The shards are rows of a Parquet table with
their part, number and document ids, in a folder that all executors share. A document longer than a shard has a
shard of its own.

Pairs are replaced in rounds until that pays no more: all frequent pairs of a round at once, where they overlap the most
frequent one, of one pair from left to right.

Defined cases: null and empty texts hold the end id alone; documents with equal ids stay separate and are
ordered by text; null ids come first; columns besides the id and the text are ignored whatever their names; an
empty table gives no shard and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, scratch, slices
from .grammar import Shard, pack
from .pretokens import encoder

SHARD_SCHEMA = "part int, shard int, n_ids long, doc_ids array<long>, content binary"


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, shard_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode every text and write the shards below ``path``."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange(parts or parts_for(source), F.col("id"), F.substring("text", 1, 16)).sortWithinPartitions("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # document ids, token counts, tokens
        size = 0
        e = encoder(tokenizer_path)
        vocabulary = max(e.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)

        def packed() -> pa.RecordBatch:
            docs, counts, ids = zip(*held)
            ends = np.cumsum(np.concatenate(counts))
            own = pa.concat_arrays(docs)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([int(ends[-1])], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([pack(np.concatenate(ids), ends, vocabulary)], pa.binary())], names=["part", "shard", "n_ids", "doc_ids", "content"])

        for batch in slices(batches, max_bytes=2 << 20):
            bare, counts = e.document_ids(batch.column(1))
            counts = counts + 1
            ends = np.cumsum(counts)
            ids, is_end = np.full(int(ends[-1]), end_id, np.uint32), np.zeros(int(ends[-1]), bool)
            is_end[ends - 1] = True
            ids[~is_end] = bare
            start = 0
            while start < len(counts):
                before = int(ends[start - 1]) if start else 0
                stop = int(np.searchsorted(ends, before + shard_ids - size, "right"))
                if stop == start and not held:
                    stop += 1
                if stop > start:
                    held.append((batch.column(0)[start:stop], counts[start:stop], ids[before : int(ends[stop - 1])]))
                    size += int(ends[stop - 1]) - before
                    start = stop
                if start < len(counts):
                    yield packed()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield packed()

    ordered.mapInArrow(encode, SHARD_SCHEMA).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """For each shard the number of ids in all shards before it: sums in each part, then over the parts."""
    sizes = shards.select("part", "shard", "n_ids")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    return sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(offsets, "part").select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("shard_start"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shards: doc_id, start, n_tokens, and the crc of the decoded ids."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["content"])
                raw, ends = memoryview(shard.all_ids().astype("<u4").tobytes()), shard.ends
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(ends)
                yield pa.record_batch([pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"])

    found = shards.select("part", "shard", "n_ids", "doc_ids", "content").mapInArrow(decode, "part int, shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared folder and read every document's ids back from them."""
    path = scratch(docs.sparkSession, "token-shards")
    write_shards(docs, tokenizer_path, path, end_id, id_col=id_col, text_col=text_col)
    return read_shards(docs.sparkSession, path)
