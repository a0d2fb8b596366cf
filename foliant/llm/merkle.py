"""Operator 9: Merkle trees over paragraphs and sections, and fingerprints that can be compared.

Leaves are phrases: content-defined runs of bytes (a border follows where the hash of the last bytes says so, and at
each line's end), so an edit changes the leaves around it and no others. A paragraph is a line or, behind the first
``LINE_PHRASES`` leaves of a longer one, a part that ends where a leaf's hash says so; a section ends at an empty line or where a
paragraph's hash says so; groups of sections, of these groups and so on end in the same way. Every node is a hash of the
nodes under it, in order, and the root a 128-bit digest of the sections and the text. So equal roots mean equal texts, and where
two trees differ, ``differences`` descends from sections into paragraphs and returns every range that differs.

A fingerprint is the root, the number of distinct phrases, the ``NODES`` lowest hashes of them (all, if there are no more), and, for all
levels over the phrases that have ``NODES`` nodes or fewer, the 32-bit hashes of the level's nodes in order. ``likeness`` is 1 for equal
roots; else it is the share of phrases that two texts have in common (twice the common ones over the sum), from the phrases up to the
highest hash that both fingerprints know. Texts of few phrases are so compared exactly, and longer ones within about 0.03, however long they are. Where the
known phrases are all equal, the nodes that differ at the finest level that both have tell by how many phrases the texts differ at least.

Defined cases: a null text is empty; an empty text is one empty phrase; texts of any length are read whole, in pieces; equal ids
are ordered by text, null ids come last; a table's only document is its own next one; columns
besides the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .shingles import _FACTORS, mix, pieces, span_hashes

NODES, LEVELS, LINE_PHRASES = 512, 8, 64
PHRASES, PARAGRAPHS, SECTIONS = 0, 1, 2
MOST_SHARDS = 1 << 15
_BORDER_WINDOW, _BORDER_MASK = 6, np.uint32(15)


@dataclass
class Tree:
    """Root and, per level from the phrases up, the hashes of a text's nodes in order."""

    root: str
    levels: list[np.ndarray]


def _phrases(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all phrases in order: owner, hash, whether it ends a line, whether it is an empty line."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for data, ends, numbers in pieces(texts):
        h = np.zeros(len(data), np.uint32)
        if len(data) >= _BORDER_WINDOW:
            for k in range(_BORDER_WINDOW):
                h[_BORDER_WINDOW - 1 :] = h[_BORDER_WINDOW - 1 :] * np.uint32(0x01000193) + data[k : len(data) - _BORDER_WINDOW + 1 + k]
        border = ((h * np.uint32(0x9E3779B1)) >> np.uint32(20) & _BORDER_MASK) == 0
        starts = np.concatenate(([0], np.flatnonzero(data[:-1] == 10) + 1))
        for k in range(_BORDER_WINDOW - 1):  # windows that begin before the line don't count
            border[starts[starts + k < len(data)] + k] = False
        border |= data == 10
        last = np.flatnonzero(border) + 1
        first = np.concatenate(([0], last[:-1]))
        line = data[last - 1] == 10
        found = (numbers[np.searchsorted(ends, first, "right")], span_hashes(data, np.ones(len(data), bool), first, last), line, line & (last - first == 1))
        for xs, x in zip(out, found):
            xs.append(x)
    return tuple(np.concatenate(x) for x in out)  # type: ignore[return-value]


def _parents(owner: np.ndarray, nodes: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, first child) of the nodes over ``nodes``: one ends at each border and with each text."""
    border = border | np.append(owner[1:] != owner[:-1], True)
    last = np.flatnonzero(border) + 1
    first = np.concatenate(([0], last[:-1]))
    size = last - first
    place = (np.arange(len(nodes)) - np.repeat(first, size)) & (len(_FACTORS) - 1)
    return owner[first], mix(np.add.reduceat(mix(nodes) * _FACTORS[place], first) + size.astype(np.uint64)), first


def trees(texts: list[bytes]) -> list[Tree]:
    """The trees of many texts at once."""
    if not texts:
        return []
    owner, nodes, line, empty = _phrases(texts)
    levels = [(owner, nodes)]
    begins = np.concatenate(([True], line[:-1] | (owner[1:] != owner[:-1])))
    in_line = np.arange(len(nodes)) - np.maximum.accumulate(np.where(begins, np.arange(len(nodes)), 0))
    owner, nodes, first = _parents(owner, nodes, line | ((in_line >= LINE_PHRASES) & (nodes & np.uint64(31) == 0)))
    single = np.diff(np.append(first, len(empty))) == 1
    levels.append((owner, nodes))
    border = (empty[first] & single) | (nodes & np.uint64(7) == 0)
    while len(levels) < LEVELS:
        owner, nodes, _ = _parents(owner, nodes, border)
        levels.append((owner, nodes))
        border = nodes & np.uint64(7) == 0
    cut = [np.searchsorted(o, np.arange(len(texts) + 1)) for o, _ in levels]
    out = []
    for k, text in enumerate(texts):
        own = [x[c[k] : c[k + 1]] for (_, x), c in zip(levels, cut)]
        digest = xxhash.xxh3_128(own[SECTIONS].tobytes())
        digest.update(text)
        out.append(Tree(digest.hexdigest(), own))
    return out


def _gaps(x: list[int], y: list[int]) -> list[tuple[int, int, int, int]]:
    """Ranges (from, to in x; from, to in y) outside an alignment of two sequences of nodes.

    Nodes that both have once are matched where they stand in one order, and what is equal next to these, or at the ends, too.
    """
    once_x, once_y = ({v: k for k, v in enumerate(s) if c[v] == 1} for s, c in ((x, Counter(x)), (y, Counter(y))))
    both = [(k, once_y[v]) for v, k in once_x.items() if v in once_y]
    tails: list[int] = []
    link, top = [-1] * len(both), []
    for n, (_, j) in enumerate(both):  # longest run of matches that ascends in both
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            top.append(n)
        else:
            tails[at], top[at] = j, n
        link[n] = top[at - 1] if at else -1
    chain, n = [], top[-1] if top else -1
    while n >= 0:
        chain.append(both[n])
        n = link[n]
    out, i, j = [], 0, 0
    for a, b in [*reversed(chain), (len(x), len(y))]:
        while i < a and j < b and x[i] == y[j]:
            i, j = i + 1, j + 1
        m, n = a, b
        while m > i and n > j and x[m - 1] == y[n - 1]:
            m, n = m - 1, n - 1
        if m > i or n > j:
            out.append((i, m, j, n))
        i, j = min(a + 1, len(x)), min(b + 1, len(y))
    return out


def differences(a: bytes | Tree, b: bytes | Tree) -> list[tuple[int, int, int, int]]:
    """Paragraph ranges (from, to in a; from, to in b) that differ, found by descending into the sections that differ."""
    x, y = ((trees([t])[0] if isinstance(t, bytes) else t) for t in (a, b))
    if x.root == y.root:
        return []
    paragraphs, starts = [], []
    for tree in (x, y):
        own = tree.levels[PARAGRAPHS]
        paragraphs.append(own.tolist())
        starts.append(np.append(_section_starts(tree), len(own)).tolist())
    out = []
    for s, t, u, v in _gaps(x.levels[SECTIONS].tolist(), y.levels[SECTIONS].tolist()):
        i, j = starts[0][s], starts[1][u]
        out += [(i + m, i + n, j + p, j + q) for m, n, p, q in _gaps(paragraphs[0][i : starts[0][t]], paragraphs[1][j : starts[1][v]])]
    return out


def _section_starts(tree: Tree) -> np.ndarray:
    """The first paragraph of each section: a section's node is the hash of a run of paragraphs, which is found again here."""
    own = tree.levels[PARAGRAPHS]
    ended = (own & np.uint64(7) == 0) | (own == _EMPTY_LINE)
    return np.concatenate(([0], np.flatnonzero(ended[:-1]) + 1))


_EMPTY_LINE = _parents(np.zeros(1, np.int64), span_hashes(np.array([10], np.uint8), np.ones(1, bool), np.array([0]), np.array([1])), np.zeros(1, bool))[1][0]


@dataclass
class Fingerprint:
    """Root, number of distinct phrases and the lowest of their hashes, and, from level ``finest`` on, the hashes of each level's nodes in order."""

    root: str
    phrases: int
    lowest: np.ndarray
    finest: int
    levels: list[np.ndarray]


def fingerprint(tree: Tree) -> Fingerprint:
    short = [(x >> np.uint64(32)).astype(np.uint32) for x in tree.levels]
    phrases = np.unique(short[PHRASES])
    finest = next((k for k, x in enumerate(short) if k > PHRASES and len(x) <= NODES), LEVELS)
    return Fingerprint(tree.root, len(phrases), phrases[:NODES], finest, short[finest:])


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    return [fingerprint(t) for t in trees(texts)]


def as_string(mark: Fingerprint) -> str:
    """Root in hexadecimal, numbers, and the hashes in base 64."""
    coded = (base64.b64encode(x.astype("<u4").tobytes()).decode() for x in (mark.lowest, *mark.levels))
    return ":".join((mark.root, str(mark.phrases), str(mark.finest), *coded))


def from_string(text: str) -> Fingerprint:
    root, phrases, finest, *coded = text.split(":")
    lowest, *levels = (np.frombuffer(base64.b64decode(x), "<u4") for x in coded)
    return Fingerprint(root, int(phrases), lowest, int(finest), levels)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Likeness of two fingerprints, 0 to 1; below 1 for different texts."""
    if a.root == b.root:
        return 1.0
    known = min((int(x.lowest[-1]) for x in (a, b) if x.phrases > len(x.lowest)), default=1 << 32)
    both = np.concatenate([x.lowest[: np.searchsorted(x.lowest, known, "right")] for x in (a, b)])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    if 2 * common < len(both):
        return 2 * common / len(both)
    level = max(a.finest, b.finest)
    if level >= LEVELS:
        return 1 - 1e-9
    x, y = np.unique(a.levels[level - a.finest]), np.unique(b.levels[level - b.finest])
    apart = len(np.setxor1d(x, y, assume_unique=True))
    return min(1 - apart / max(1, a.phrases + b.phrases), 1 - 1e-9)


def merkle_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document: id, n_chars, fingerprint."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            marks = fingerprints([t.encode() for t in texts])
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(as_string, marks), pa.string())], names=[id_col, "n_chars", "fingerprint"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str, shard_rows: int = 16_384) -> DataFrame:
    """(shard, extra, id, text): shards of the documents by descending ids, each followed by the first row of the next one.

    Shards are the ranges that Spark finds for ids and, in one id, the texts' beginnings, so an id that many rows share is split too;
    there are ``MOST_SHARDS`` at most, whose bounds are the only rows that meet the driver. The last shard is followed
    by the first; a lone shard has no extra rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    key = F.struct(F.col("id").isNull().alias("a"), F.coalesce(F.bitwise_not("id"), F.lit(0)).alias("b"), F.coalesce(F.substring("text", 1, 16), F.lit("")).alias("c"))
    keyed = source.withColumn("key", key)
    n = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, math.ceil(source.count() / shard_rows)))
    ranges = keyed.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("least"))
    bounds = sorted((r.least.a, r.least.b, r.least.c) for r in ranges.collect())  # one per shard
    if len(bounds) < 2:
        return source.select(F.lit(0).alias("shard"), F.lit(False).alias("extra"), "id", "text")
    literal = lambda x: F.struct(F.lit(x[0]).alias("a"), F.lit(x[1]).cast("long").alias("b"), F.lit(x[2]).alias("c"))
    step = math.isqrt(len(bounds)) + 1
    fine = F.array(*[F.array(*map(literal, bounds[a : a + step])) for a in range(0, len(bounds), step)])
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("key")))
    coarse = F.greatest(F.lit(1), upto(F.array(*map(literal, bounds[::step]))))
    placed = keyed.withColumn("coarse", coarse).withColumn("shard", F.greatest(F.lit(0), (F.col("coarse") - 1) * step + upto(F.element_at(fine, F.col("coarse"))) - 1))
    is_first = F.col("key") == F.element_at(F.element_at(fine, F.col("coarse")), F.col("shard") - (F.col("coarse") - 1) * step + 1)
    own = F.struct("shard", F.lit(False).alias("extra"))
    copies = F.when(is_first, F.array(own, F.struct(F.pmod(F.col("shard") - 1, F.lit(len(bounds))).alias("shard"), F.lit(True).alias("extra")))).otherwise(F.array(own))
    return placed.select(F.explode(copies).alias("at"), "id", "text").select("at.shard", "at.extra", "id", "text")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of it with its last third replaced by the next document's beginning.

    ``changes`` lists the paragraphs in which the two differ, as ``from-to:from-to`` in the text and the edited one.
    """
    rows = with_next(docs, id_col, text_col)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "extra", F.col("id").desc_nulls_last(), F.coalesce("text", F.lit("")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        """(id, text, next text)"""
        shard = first = held = None
        for batch in batches:
            for s, extra, i, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                text = text or ""
                if s != shard:
                    if held:
                        yield *held, first
                    shard, first, held = s, text, None
                if held:
                    yield *held, text
                held = None if extra else (i, text)
        if held:
            yield *held, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = slices(batches, 3, 4 << 20)
        held: list[tuple[int | None, str, str]] = []

        def out() -> pa.RecordBatch:
            edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for _, t, after in held]
            raw = [x.encode() for x in edited]
            own = trees([t.encode() for _, t, _ in held])
            marks = [fingerprint(t) for t in own]
            nexts = [marks[k + 1] if k + 1 < len(held) and held[k + 1][1] is held[k][2] else None for k in range(len(held))]
            rest = fingerprints([held[k][2].encode() for k, x in enumerate(nexts) if x is None])
            nexts = [rest.pop(0) if x is None else x for x in nexts]
            others = trees(raw)
            changed = [fingerprint(t) for t in others]
            ranges = [";".join(f"{a}-{b}:{c}-{d}" for a, b, c, d in differences(x, y)) for x, y in zip(own, others)]
            return pa.record_batch([
                pa.array([i for i, _, _ in held], pa.int64()), pa.array([len(t) for _, t, _ in held], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array(map(as_string, marks), pa.string()), pa.array(map(as_string, changed), pa.string()),
                pa.array(map(likeness, marks, changed), pa.float64()), pa.array(map(likeness, marks, nexts), pa.float64()), pa.array(ranges, pa.string()),
            ], names=names)

        names, size = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "changes"], 0
        for pair in pairs(small):
            held.append(pair)
            size += len(pair[1])
            if size > 2 << 20:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changes string")
