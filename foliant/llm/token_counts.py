"""Operator 3: token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

A first pass over all texts builds, in each task, a bounded summary of its most frequent words; the summaries
(never the words) meet in a tree. The top ``table_size`` words, encoded once, make a compact table that is
broadcast: its size is bounded by ``table_size`` words of at most 64 characters. The second pass adds up
lengths from that table; misses are encoded in the worker and kept in a bounded cache. The table only decides
what is looked up where: counts don't depend on it.

Defined cases: null and empty texts count 0 bytes and 0 tokens; texts of any length are counted whole; equal
rows give equal rows; columns besides the id and the text are ignored whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pretokens import LONGEST_KEPT, encoder

SCHEMA = "{id} {type}, n_bytes long, n_tokens long, over_limit boolean"


def _pack(counts: Counter, keep: int) -> bytes:
    top = counts.most_common(keep)
    return zlib.compress("\n".join(f"{n} {w}" for w, n in top).encode(), 1)


def _unpack(blob: bytes) -> Counter:
    lines = zlib.decompress(blob).decode().split("\n") if blob else []
    return Counter({w: int(n) for n, _, w in (x.partition(" ") for x in lines) if w})


def frequent_words(docs: DataFrame, text_col: str = "text", table_size: int = 65_536) -> list[str]:
    """The most frequent white-space words of all texts, up to rounding in the bounded summaries."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 0, 4 << 20):
            each = pc.ascii_split_whitespace(batch.column(0).fill_null("")).flatten().value_counts()
            often = each.filter(pc.and_(pc.greater(each.field("counts"), 1), pc.less_equal(pc.utf8_length(each.field("values")), LONGEST_KEPT)))
            counts.update(dict(zip(often.field("values").to_pylist(), often.field("counts").to_pylist())))
            if len(counts) > 6 * table_size:
                counts = Counter(dict(counts.most_common(2 * table_size)))
        counts.pop("", None)
        yield pa.record_batch([pa.array([_pack(counts, table_size)], pa.binary())], names=["words"])

    merge = lambda a, b: _pack(_unpack(a) + _unpack(b), table_size) if a and b else a or b
    blobs = docs.select(F.col(text_col).cast("string")).mapInArrow(summary, "words binary").rdd.map(lambda row: bytes(row[0]))
    return [w for w, _ in _unpack(blobs.treeAggregate(b"", merge, merge, depth=3)).most_common(table_size)]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, table_size: int = 65_536) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens."""
    words = frequent_words(docs, text_col, table_size) if encoder(tokenizer_path).by_words else []
    lengths = encoder(tokenizer_path).encode(pa.array(words, pa.string()))[1].astype("<u2")
    compact = docs.sparkSession.sparkContext.broadcast(("\n".join(words), lengths.tobytes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, sizes = compact.value
        frequent, sizes = pa.array(joined.split("\n") if joined else [], pa.string()), np.frombuffer(sizes, "<u2").astype(np.int64)
        for batch in slices(batches, max_bytes=8 << 20):
            n = encoder(tokenizer_path).document_lengths(batch.column(1), frequent, sizes)
            n_bytes = pc.cast(pc.binary_length(batch.column(1)).fill_null(0), pa.int64())
            yield pa.record_batch([batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return source.mapInArrow(count, SCHEMA.format(id=f"`{id_col}`", type=source.schema[0].dataType.simpleString()))
