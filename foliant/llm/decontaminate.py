"""Operator 10: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

The benchmark is taken in blocks of bounded size (``block_words``), each of which is broadcast. Per block, a first
pass over all documents counts how often each of the block's seeds occurs in the corpus. Seeds are ``n`` words of an item, in a row
or with one word left out between them, so a copy in which every third word is changed still has some, whatever the
corpus holds besides. A second pass finds seeds in every whole text and joins
the passage around them to the item: passages with two seeds near one diagonal, or with a rare one (a block's rare ones
meet a document ``fan`` times on average at most); any passage of ``SHORT`` words or more that reaches the threshold has two. Passage and item are scored by
local alignment of words (match 2, mismatch -1,
gap -1). A passage counts when its score reaches ``threshold`` of that of the item itself or, in long items, that of
``copied`` words in a row. Items with fewer than ``SHORT`` words count with one word changed, lost or added at most, those with
fewer than five only where all their words stand in a row. All of it is map-side:
texts are never shuffled, and a passage that a third of all documents hold costs no task more than its own rows.

Words are runs of letters and digits (and marks and underscores), lower-cased, known by 64-bit hashes. Defined cases: null and empty texts hold no words and
are clean; items without words are not searched; equal items each get their hits; an empty
benchmark flags nothing; texts of any length are read whole, in pieces; rows with equal ids are judged row by row; other
columns are ignored by ``contaminated`` and carried by ``clean_documents``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .shingles import pieces, span_hashes, spans

MATCH, MISMATCH, GAP = 2, -1, 1
#: Items with fewer words are asked for nearly whole.
SHORT = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[[95, *range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Signs beyond ASCII that are no part of words.
_SIGNS = r"[^\x00-\x7f\p{L}\p{N}\p{M}]"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the words of all texts, in order."""
    lower = pc.utf8_lower(texts.fill_null(""))
    odd = pc.match_substring_regex(lower, _SIGNS)
    if pc.any(odd).as_py():
        lower = pc.if_else(odd, pc.replace_substring_regex(lower, _SIGNS, " "), lower)
    owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for data, ends, numbers in pieces([t.encode() for t in lower.to_pylist()]):
        inside = _WORD[data]
        first, last = spans(inside)
        owners.append(numbers[np.searchsorted(ends, first, "right")])
        values.append(span_hashes(data, inside, first, last))
    return np.concatenate(owners), np.concatenate(values)


def patterns(n: int) -> list[tuple[int, ...]]:
    """Places of a seed's words: ``n`` in a row, and with one left out at each place between them."""
    return [tuple(range(n)), *(tuple(k + (k >= j) for k in range(n)) for j in range(1, n))]


def _grams(ids: np.ndarray, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds of which all words are known (ids over 0), in one text (ids from 0 on)."""
    reach = places[-1] + 1
    if len(ids) < reach:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(ids) - reach + 1
    good = np.ones(n, bool)
    for k in range(reach):
        good &= ids[k : k + n] >= (k in places)
    at = np.flatnonzero(good)
    key = np.zeros(len(at), np.uint64)
    for k in places:
        key = (key ^ ids[at + k].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return at, key


def _found(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The index of each value among ``keys`` (sorted), or -1."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    slot = lambda x: (x * _MIX) >> np.uint64(44)
    used = np.zeros(1 << 20, bool)
    used[slot(keys)] = True
    out, at = np.full(len(values), -1, np.int64), np.flatnonzero(used[slot(values)])
    k = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
    out[at] = np.where(keys[k] == values[at], k, -1)
    return out


def smith_waterman(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each item row against its passage row, and the passage word after the alignment's end.

    Rows are padded with different negative ids, which match nothing.
    """
    rows, m = passages.shape
    h = np.zeros((rows, m + 1), np.int32)
    slope = np.arange(m, dtype=np.int32) * GAP
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for i in range(items.shape[1]):
        now = np.where(passages == items[:, i : i + 1], MATCH, MISMATCH).astype(np.int32) + h[:, :-1]
        np.maximum(now, h[:, 1:] - GAP, out=now)
        np.maximum(now, 0, out=now)
        h[:, 1:] = np.maximum.accumulate(now + slope, axis=1) - slope
        at = h.argmax(axis=1)
        top = h[np.arange(rows), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


class Block:
    """Items of one block with their n-grams; ``seeds`` are set once corpus counts are known."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.ids = n, [i for i, _ in items]
        owner, value = words_of(pa.array([t for _, t in items], pa.string()))
        self.vocabulary, place = np.unique(value, return_inverse=True)
        cut = np.searchsorted(owner, np.arange(len(items) + 1))
        self.words = [(place[a:b] + 1).astype(np.int32) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.patterns = patterns(n)
        self.grams = [[_grams(w, p) if len(w) >= n else (np.zeros(0, np.int64), np.zeros(0, np.uint64)) for w in self.words] for p in self.patterns]
        self.keys = np.unique(np.concatenate([*(key for own in self.grams for _, key in own), np.zeros(0, np.uint64)]))
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # size, hash, items
        for item, w in enumerate(self.words):
            if 0 < len(w) < n:
                self.short[len(w)][int(_grams(w, tuple(range(len(w))))[1][0])].append(item)
        self.short = {size: dict(found) for size, found in self.short.items()}
        self.seed_keys = np.zeros(0, np.uint64)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, 0 for a word that no item has and -1 between texts; and where each text begins, with an end."""
        owner, value = words_of(texts)
        flat = np.full(len(owner) + len(texts), -1, np.int32)
        flat[np.arange(len(owner)) + owner] = _found(self.vocabulary, value) + 1
        return flat, np.searchsorted(owner, np.arange(len(texts) + 1)) + np.arange(len(texts) + 1)

    def set_seeds(self, counts: np.ndarray, n_docs: int, fan: float) -> None:
        """All seeds that the corpus has, and which of them are rare."""
        places = defaultdict(set)
        for own in self.grams:
            for item, (at, keys) in enumerate(own):
                for k in np.flatnonzero(counts[np.searchsorted(self.keys, keys)] > 0).tolist():
                    places[int(keys[k])].add((item, int(at[k])))
        self.seed_keys = np.array(sorted(places), np.uint64)
        self.rare = counts[np.searchsorted(self.keys, self.seed_keys)] <= fan * n_docs / max(1, len(self.keys))
        lists = [sorted(places[int(k)]) for k in self.seed_keys]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        flat = np.array([p for x in lists for p in x], np.int64).reshape(-1, 2)
        self.seed_item, self.seed_at = flat[:, 0], flat[:, 1]

    def needed(self, items: np.ndarray, threshold: float, copied: int) -> np.ndarray:
        """The score that a passage must reach for each item."""
        size = self.sizes[items]
        short = MATCH * size - np.where(size < 5, 0, MATCH - MISMATCH)
        return np.where(size < SHORT, short, np.minimum(threshold * MATCH * size, MATCH * copied))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Indexes of the seeds found in texts, with repeats."""
        flat, _ = self.documents(texts)
        k = np.concatenate([_found(self.keys, _grams(flat, p)[1]) for p in self.patterns])
        return k[k >= 0]

    def passages(self, flat: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, word after the last) of every passage around seeds that lie near one diagonal of the item."""
        both = [_grams(flat, p) for p in self.patterns]
        at, k = np.concatenate([a for a, _ in both]), np.concatenate([_found(self.seed_keys, key) for _, key in both])
        at, k = at[k >= 0], k[k >= 0]
        if not len(at):
            return []
        fan = self.first[k + 1] - self.first[k]
        which = np.repeat(self.first[k], fan) + np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
        item, at, rare = self.seed_item[which], np.repeat(at, fan), np.repeat(self.rare[k], fan)
        diagonal, text = at - self.seed_at[which], np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((diagonal, item, text))
        item, diagonal, text, rare = item[order], diagonal[order], text[order], rare[order]
        size = self.sizes[item]
        new = np.concatenate(([True], (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) > size[1:] // 2)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(item)) - 1
        worth = (last > first) | np.logical_or.reduceat(rare, first) | (self.sizes[item[first]] < SHORT)
        first, last = first[worth], last[worth]
        pad = size[first] // 4 + 4
        low = np.maximum(starts[text[first]], diagonal[first] - pad)
        high = np.minimum(starts[text[first] + 1] - 1, diagonal[last] + size[first] + pad)
        return list(zip(text[first].tolist(), item[first].tolist(), low.tolist(), high.tolist()))

    def score(self, found: list[tuple[int, np.ndarray]], backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Smith-Waterman over many (item, words), in groups of like size."""
        best, end = np.zeros(len(found), np.int32), np.zeros(len(found), np.int64)
        turn = -1 if backwards else 1
        order = sorted(range(len(found)), key=lambda k: len(found[k][1]))
        at = 0
        while at < len(order):
            width = max(1, len(found[order[min(at + 255, len(order) - 1)]][1]))
            part = order[at : at + max(1, min(256, (2 << 20) // width))]
            at += len(part)
            longest = max(len(self.words[found[k][0]]) for k in part)
            items, passages = np.full((len(part), longest), -1, np.int32), np.full((len(part), width), -2, np.int32)
            for row, k in enumerate(part):
                words = self.words[found[k][0]][::turn]
                items[row, : len(words)] = words
                passages[row, : len(found[k][1])] = found[k][1][::turn]
            best[part], end[part] = smith_waterman(items, passages)
        return best, end

    def hits(self, texts: pa.Array, threshold: float, copied: int) -> list[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, word after the last) of every passage that reaches the threshold."""
        flat, starts = self.documents(texts)
        out = []
        for size, wanted in self.short.items():
            at, key = _grams(flat, tuple(range(size)))
            for a, items in ((a, wanted.get(h)) for a, h in zip(at.tolist(), key.tolist()) if h in wanted):
                text = int(np.searchsorted(starts, a, "right")) - 1
                out += [(text, item, 1.0, a - int(starts[text]), a - int(starts[text]) + size) for item in items if np.array_equal(self.words[item], flat[a : a + size])]
        found = self.passages(flat, starts)
        words = [(item, flat[low:high]) for _, item, low, high in found]
        best, end = self.score(words)
        full = MATCH * self.sizes[[item for _, item, _, _ in found]] if found else np.zeros(0, np.int64)
        good = np.flatnonzero(best >= self.needed(np.array([item for _, item, _, _ in found], np.int64), threshold, copied))
        _, back = self.score([(words[k][0], words[k][1][: end[k]]) for k in good], backwards=True)
        for k, b in zip(good.tolist(), back.tolist()):
            text, item, low, _ = found[k]
            stop = low - int(starts[text]) + int(end[k])
            out.append((text, item, float(best[k] / full[k]), stop - b, stop))
        return sorted(out)


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, n: int, fan: float, block_words: int) -> Iterator:
    """Broadcasts of the benchmark's blocks, seeds chosen by the corpus' counts."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / 4 / block_words))
    for b in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).orderBy("item", "text").collect()  # bounded by block_words
        block = Block([(r.item, r.text) for r in own], n)
        if not len(block.vocabulary):
            continue
        if len(block.keys):
            raw = spark.sparkContext.broadcast(block)

            def count(batches: Iterator[pa.RecordBatch], raw=raw) -> Iterator[pa.RecordBatch]:
                block, n_docs = raw.value, 0
                n_found = np.zeros(len(block.keys) + 1, np.int64)  # the last one counts documents
                for batch in slices(batches, 0):
                    n_found += np.bincount(block.count(batch.column(0)), minlength=len(n_found))
                    n_found[-1] += batch.num_rows
                k = np.flatnonzero(n_found)
                yield pa.record_batch([pa.array(k, pa.int64()), pa.array(n_found[k], pa.int64())], names=["gram", "n"])

            counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # a row per n-gram of the block
            counts = np.zeros(len(block.keys) + 1, np.int64)
            counts[counted["gram"].to_numpy()] = counted["n"].to_numpy()
            block.set_seeds(counts[:-1], int(counts[-1]), fan)
        yield spark.sparkContext.broadcast(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 3, fan: float = 0.5, threshold: float = 0.5, copied: int = 50, block_words: int = 1_000_000) -> DataFrame:
    """Every passage of a document that copies a benchmark item: id, item_id, score in (0, 1], word span."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, item_id long, score double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for raw in _blocks(docs, benchmark, text_col, item_col, n, fan, block_words):

        def find(batches: Iterator[pa.RecordBatch], raw=raw) -> Iterator[pa.RecordBatch]:
            block = raw.value
            for batch in slices(batches):
                hits = block.hits(batch.column(1), threshold, copied)
                owner, item, score, first, end = zip(*hits) if hits else ((),) * 5
                yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), pa.array([block.ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=[id_col, "item_id", "score", "first_word", "end_word"])

        out = out.unionAll(source.mapInArrow(find, schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", n: int = 3, fan: float = 0.5, threshold: float = 0.5, copied: int = 50, block_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` without contaminated ones, filtered where they lie: only texts go through Python."""

    def without(raw: Broadcast) -> Column:
        def clean(text: pa.Array) -> pa.Array:
            flags = []
            for batch in slices(iter([pa.record_batch([text], names=["text"])]), 0):
                own = np.ones(batch.num_rows, bool)
                own[[h[0] for h in raw.value.hits(batch.column(0), threshold, copied)]] = False
                flags.append(own)
            return pa.array(np.concatenate([*flags, np.zeros(0, bool)]))

        return F.arrow_udf(clean, "boolean")(F.col(text_col).cast("string"))

    out = docs
    for raw in _blocks(docs, benchmark, text_col, item_col, n, fan, block_words):
        out = out.where(without(raw))
    return out
