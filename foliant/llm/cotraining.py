"""Operator 8: quality classifier by co-training of a text view and a metadata view.

Two faults are learned from labelled documents: low quality and toxicity. For each there are two logistic
classifiers with features of their own: the text view sees words (hashed, those that labels depend on most) and the
text's shape (letter case, signs, repeats, lengths, in bins); the metadata view sees source, language and stated
length. Over ``rounds``, each scores all unlabelled documents in Spark, and those that it is most sure of (a distributed
top-k per fault and class) are handed to the other for training. A fold that neither is trained on shows how sure a view may be:
there its margins are calibrated, in each round, and in the end both are combined by a logistic fit. Every document is
then scored; one whose faults together are likelier than ``threshold`` is rejected.

Words are chosen by counts over all labelled documents outside the fold. One pass over the texts makes a table of compact features (chosen words,
shape, metadata), which the rounds and the final scores read instead of texts. Only the weights are fitted on a sample:
about ``labelled_bound`` labelled rows, chosen by a hash of the id, and the ``a_round`` surest pseudo-labelled ones of
each round, fault, view and class; both are bounded whatever the input's size and fit the driver.

Words are runs of ASCII letters, digits and signs beyond ASCII. Defined cases: null or empty texts have no words and
the shape of an empty text; texts of any length are read whole, in pieces; null source, language or length is a
value of its own; labels without a document, with a null id, or null in both marks are ignored, and of several rows
for one id the worst marks count; a fault with labels of one kind only is never predicted; rows with equal ids are
scored row by row; an empty table gives an empty result; other columns are ignored by ``score_documents`` and
carried by ``good_documents``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small, stored
from .shingles import mix, pieces, span_hashes, spans

HASHED, CHOSEN, BINS, META, SHAPES = 1 << 20, 400, 12, 1 << 10, 9
FAULTS = ("low", "toxic")
SHORT = math.log(25)
STEM = np.uint64(0xD6E8FEB86659FD93)
_LETTER, _UPPER, _LOWER, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _SPACE[[32, *range(9, 14)]] = True
_LETTER[:] = _UPPER | _LOWER | (np.arange(256) >= 128)
_WORD = _LETTER | np.isin(np.arange(256), np.arange(48, 58))
_FOLDED = np.where(_UPPER, np.arange(256) + 32, np.arange(256)).astype(np.uint8)


@dataclass
class Read:
    """What the classifiers see of some texts: words (owner, hash below HASHED, possibly repeated) and shapes."""

    owner: np.ndarray
    words: np.ndarray
    shapes: np.ndarray


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of ``n`` owners has."""
    if not len(owner):
        return np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    return np.bincount(o[np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])))], minlength=n).astype(float)


def read_texts(texts: pa.Array) -> Read:
    """Words and shapes of texts; the shape of one without words is 0 throughout."""
    raw = [(t or "").encode() for t in texts.to_pylist()]
    n = len(raw)
    add = lambda owner, flags: np.bincount(owner[flags], minlength=n).astype(float)
    word_owner, words, solid_owner, solids, line_owner, lines = ([] for _ in range(6))
    count, chars, changed, plain, ended, repeated = (np.zeros(n) for _ in range(6))
    for data, ends, numbers in pieces(raw):
        folded = _FOLDED[data]
        inside = _WORD[data]
        first, last = spans(inside)
        own = numbers[np.searchsorted(ends, first, "right")]
        word_owner.append(own)
        words.append((span_hashes(folded, inside, first, last) & np.uint64(HASHED - 1)).astype(np.int32))
        begin, value = first[last - first > 5], np.zeros(int((last - first > 5).sum()), np.uint64)
        for k in range(5):  # the first four and five bytes of longer words
            value = value * STEM + folded[begin + k]
            if k > 2:
                word_owner.append(own[last - first > 5])
                words.append((mix(value + np.uint64(k)) & np.uint64(HASHED - 1)).astype(np.int32))
        solid = ~_SPACE[data]
        first, last = spans(solid)
        own, size, start = numbers[np.searchsorted(ends, first, "right")], last - first, np.cumsum(last - first) - (last - first)
        value = span_hashes(folded, solid, first, last)
        if len(first):
            total = lambda table: np.add.reduceat(table[data[solid]].astype(np.int64), start)
            upper, lower, letters = total(_UPPER), total(_LOWER), total(_LETTER)
            count += np.bincount(own, minlength=n)
            chars += np.bincount(own, weights=size, minlength=n)
            changed += add(own, (upper > 0) & (lower == 0))
            plain += add(own, letters == size)
            ended += add(own, ~_WORD[data[last - 1]])
            repeated += add(own[1:], (value[1:] == value[:-1]) & (own[1:] == own[:-1]))
            solid_owner.append(own)
            solids.append(value)
        inside = data != 10
        first, last = spans(inside)
        line_owner.append(numbers[np.searchsorted(ends, first, "right")])
        lines.append(span_hashes(data, inside, first, last))
    all_of = lambda xs, kind: np.concatenate([*xs, np.zeros(0, kind)])
    n_bytes, has = np.array([len(t) for t in raw], float), np.maximum(count, 1)
    line_owner, lines = all_of(line_owner, np.int64), all_of(lines, np.uint64)
    distinct, own_lines = _distinct(all_of(solid_owner, np.int64), all_of(solids, np.uint64), n), np.maximum(np.bincount(line_owner, minlength=n), 1)
    shapes = np.stack([np.log(has), chars / has, changed / has, plain / has, ended / has, repeated / has, distinct / has, _distinct(line_owner, lines, n) / own_lines, 1 - chars / np.maximum(n_bytes, 1)], 1)
    shapes[count == 0] = 0
    return Read(all_of(word_owner, np.int64), all_of(words, np.int32), shapes.astype(np.float32))


def meta_of(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Hashed metadata values: each alone and source with language."""
    size = "none" if n_chars is None else str(int(2 * math.log2(max(1, n_chars))))
    return [zlib.crc32(f"{k}={v}".encode()) & (META - 1) for k, v in (("s", source), ("l", lang), ("n", size), ("sl", f"{source}/{lang}"))]


@dataclass
class Rows:
    """Sparse rows: the features of row i are ``flat[start[i] : start[i + 1]]``, at least one."""

    flat: np.ndarray
    start: np.ndarray
    width: int

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.flat], self.start[:-1]) + w[-1] if len(self.start) > 1 else np.zeros(0)

    def pick(self, which: np.ndarray) -> "Rows":
        size = np.diff(self.start)[which]
        start = np.concatenate(([0], np.cumsum(size)))
        return Rows(self.flat[np.repeat(self.start[:-1][which] - start[:-1], size) + np.arange(start[-1])], start, self.width)


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression with an intercept (last) by Adam over all rows; the step shrinks to the end.

    Its steps have one size for rare features and common ones, so words in a few documents get their weight too.
    """
    n, size = len(y), np.diff(rows.start)
    weight = weight / weight.sum()
    w, mean, square = (np.zeros(rows.width + 1) for _ in range(3))
    for k in range(1, steps + 1):
        residual = weight * (_chance(rows.margins(w)) - y)
        gradient = np.append(np.bincount(rows.flat, weights=np.repeat(residual, size), minlength=rows.width), residual.sum())
        gradient[:-1] += (l2 + 0.3 / n) * w[:-1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w - (0.2 * (1 - k / (steps + 1))) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return w


def _chance(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 60) -> np.ndarray:
    """Logistic regression on one or two numbers a row with an intercept (last), by Newton's method."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    w, ridge = np.zeros(x.shape[1]), np.diag([*[l2] * (x.shape[1] - 1), 1e-9])
    for _ in range(steps):
        p = _chance(x @ w)
        gradient = x.T @ (p - y) / len(x) + ridge @ w
        change = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x / len(x) + ridge, gradient)
        w = w - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-9:
            break
    return w


@dataclass
class View:
    """Weights and calibration of one view for one fault."""

    weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def calibrated_margins(self, rows: Rows) -> np.ndarray:
        return self.scale * rows.margins(self.weights) + self.shift


@dataclass
class Model:
    """Bin borders, the place of each hashed word among the chosen ones (or -1) and, per fault, both views and their combination."""

    borders: np.ndarray
    place: np.ndarray
    views: dict[str, tuple[View, View]] = field(default_factory=dict)
    combined: dict[str, np.ndarray] = field(default_factory=dict)

    def text_rows(self, words: np.ndarray, counts: np.ndarray, shapes: np.ndarray) -> Rows:
        """Features of the text view: a bin of each shape, and the places of chosen words (``counts`` of them a row)."""
        n = len(shapes)
        start = np.concatenate(([0], np.cumsum(counts + SHAPES)))
        flat = np.zeros(int(start[-1]), np.int64)
        is_word = np.ones(len(flat), bool)
        short = np.where(shapes[:, 0] < SHORT, BINS, 0)  # in a few words, shares mean something else
        for k in range(SHAPES):
            at = start[:-1] + k
            flat[at] = 2 * k * BINS + short + np.searchsorted(self.borders[k], shapes[:, k], "right")
            is_word[at] = False
        flat[is_word] = 2 * SHAPES * BINS + words
        return Rows(flat, start, 2 * SHAPES * BINS + int(self.place.max(initial=-1)) + 1) if n else Rows(flat, start, 1)

    @staticmethod
    def meta_rows(meta: np.ndarray) -> Rows:
        return Rows(meta.reshape(-1).astype(np.int64), np.arange(0, meta.size + 1, 4), META)

    def chances(self, rows: tuple[Rows, Rows]) -> dict[str, np.ndarray]:
        """Chance of each fault, from both calibrated views."""
        n, out = len(rows[0].start) - 1, {}
        for fault in FAULTS:
            out[fault] = np.zeros(n)
            if fault in self.combined and n:
                both = np.stack([v.calibrated_margins(x) for x, v in zip(rows, self.views[fault])], 1)
                out[fault] = _chance(both @ self.combined[fault][:-1] + self.combined[fault][-1])
        return out


def _calibrated(rows: Rows, weights: np.ndarray, y: np.ndarray) -> View:
    """A view whose margins are scaled to chances by rows that its weights weren't fitted to."""
    m = rows.margins(weights)
    spread = float(m.std()) or 1.0
    a, b = fit_dense((m / spread)[:, None], y, 1e-3)
    return View(weights, float(a) / spread, float(b))


def _source(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def _marks(labels: DataFrame) -> DataFrame:
    """(marked, low, toxic, fold): one row per labelled id; every fifth id is in the fold that is kept from training."""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    marks = known.groupBy(F.col("doc_id").alias("marked")).agg((F.coalesce(F.min("quality"), F.lit(1)) == 0).cast("int").alias("low"), F.coalesce(F.max("toxic"), F.lit(0)).cast("int").alias("toxic"))
    return marks.withColumn("fold", F.crc32(F.col("marked").cast("string").cast("binary")) % 5 == 0)


def choose_words(source: DataFrame, marks: DataFrame, least: int = 8) -> np.ndarray:
    """Place of each hashed word among those whose presence tells most about a fault (chi square over all labelled documents)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, HASHED + 1), np.int64)  # the last place counts documents
        for batch in slices(batches, 0):
            read = read_texts(batch.column(0))
            key = np.unique(read.owner * HASHED + read.words)
            owner, word = key // HASHED, key % HASHED
            for k, mark in enumerate((np.ones(batch.num_rows, np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy())):
                sums[k] += np.bincount(word, weights=mark[owner], minlength=HASHED + 1).astype(np.int64)
                sums[k, HASHED] += mark.sum()
        at = np.flatnonzero(sums[0])
        yield pa.record_batch([pa.array(at, pa.int32()), *(pa.array(x[at]) for x in sums)], names=["word", "n", *FAULTS])

    labelled = source.join(small(marks.where("not fold"), 32), F.col("id") == F.col("marked")).select("text", *FAULTS)
    counts = stored(labelled.mapInArrow(count, "word int, n long, low long, toxic long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", *FAULTS))), "word-counts")
    total = counts.where(F.col("word") == HASHED).first()
    place = np.full(HASHED, -1, np.int16)
    if total is None:
        return place
    chosen: set[int] = set()
    for fault in FAULTS:
        rate = total[fault] / total["n"]
        if 0 < rate < 1:
            chi = (F.col(fault) - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate)) / F.greatest(F.lit(1e-9), 1 - F.col("n") / total["n"])
            best = counts.where((F.col("word") < HASHED) & (F.col("n") >= least)).select("word", chi.alias("chi")).where("chi > 15").orderBy(F.desc("chi"), "word").limit(CHOSEN)  # far beyond chance
            chosen.update(r.word for r in best.collect())
    place[sorted(chosen)] = np.arange(len(chosen))
    return place


def _chosen_words(read: Read, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen words, each once per text, and how many each text has."""
    at = place[read.words]
    key = np.unique(read.owner[at >= 0] * HASHED + at[at >= 0])
    return key % HASHED, np.bincount(key // HASHED, minlength=n)


def _metas(*columns: pa.Array) -> np.ndarray:
    return np.array([meta_of(*x) for x in zip(*(c.to_pylist() for c in columns))], np.int64).reshape(-1, 4)


def features(source: DataFrame, place: np.ndarray) -> DataFrame:
    """(id, row, words, shape, meta) of every document: all that the classifiers see of it; ``row`` is a hash of id and text."""
    shared = source.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            read = read_texts(batch.column(2))
            words, counts = _chosen_words(read, shared.value, batch.num_rows)
            lists = lambda flat, counts, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat, kind))
            each = np.ones(batch.num_rows, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), lists(words.astype(np.int16), counts, pa.int16()), lists(read.shapes.reshape(-1), each * SHAPES, pa.float32()), lists(_metas(*(batch.column(k) for k in (3, 4, 5))).reshape(-1).astype(np.int16), each * 4, pa.int16())], names=["id", "row", "words", "shape", "meta"])

    kind = source.schema["id"].dataType.simpleString()
    keyed = source.select("id", F.xxhash64("id", "text").alias("row"), "text", "source", "lang", "n_chars")
    return stored(keyed.mapInArrow(run, f"id {kind}, row long, words array<smallint>, shape array<float>, meta array<smallint>"), "features")


def _unpacked(batch: pa.RecordBatch | pa.Table, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their counts, shapes and metadata of the three feature columns from ``at`` on."""
    words, shape, meta = (batch.column(at + k).combine_chunks() if isinstance(batch, pa.Table) else batch.column(at + k) for k in range(3))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda x, kind: x.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat(words, np.int64), counts, flat(shape, np.float32).reshape(-1, SHAPES), flat(meta, np.int64).reshape(-1, 4)


def _surest(unlabelled: DataFrame, model: Model, judges: dict[tuple[str, int], View], given: np.ndarray, a_round: int, sure: float) -> pa.Table:
    """(list, chance, row, words, shape, meta): for each fault, view and class the ``a_round`` documents that the view is surest of.

    Of documents with equal chances those with the smallest ``row`` come first; ``given`` ones are left out.
    """
    shared = unlabelled.sparkSession.sparkContext.broadcast((model, judges, given))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, judges, given = shared.value
        held: dict[int, pa.Table] = {}
        for batch in batches:
            words, counts, shapes, meta = _unpacked(batch, 1)
            views = (model.text_rows(words, counts, shapes), model.meta_rows(meta))
            free = ~np.isin(batch.column(0).to_numpy(), given)
            for number, ((_, k), judge) in enumerate(judges.items()):
                chance = _chance(judge.calibrated_margins(views[k]))
                for y in (0, 1):
                    certain = chance if y else 1 - chance
                    at = np.flatnonzero(free & (certain >= sure))
                    if len(at):
                        own = pa.table(batch.take(pa.array(at))).add_column(0, "chance", pa.array(certain[at])).add_column(0, "list", pa.array(np.full(len(at), 2 * number + y), pa.int32()))
                        own = pa.concat_tables([held[2 * number + y], own]) if 2 * number + y in held else own
                        held[2 * number + y] = own.sort_by([("chance", "descending"), ("row", "ascending")]).slice(0, a_round).combine_chunks()
        for own in held.values():
            yield from own.to_batches()

    schema = "list int, chance double, row long, words array<smallint>, shape array<float>, meta array<smallint>"
    sure_ones = stored(unlabelled.select("row", "words", "shape", "meta").mapInArrow(best, schema), "sure")
    tops = [sure_ones.where(F.col("list") == k).orderBy(F.desc("chance"), "row").limit(a_round) for k in range(2 * len(judges))]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionAll(top)
    return out.toArrow()


def train(found: DataFrame, marks: DataFrame, place: np.ndarray, labelled_bound: int = 12_000, rounds: int = 3, a_round: int = 500, sure: float = 0.98) -> Model:
    """The model from ``features`` and ``_marks``."""
    joined = found.join(small(marks, 32), F.col("id") == F.col("marked"), "left")
    unlabelled = joined.where("marked is null")
    share = min(1.0, labelled_bound / max(1, marks.count()))
    sample = F.pmod(F.xxhash64("marked", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))
    known = joined.where(F.col("marked").isNotNull() & sample).select("row", "words", "shape", "meta", *FAULTS, "fold").toArrow().sort_by("row")  # about labelled_bound rows
    words, counts, shapes, meta = _unpacked(known, 1)
    ys, fold = {f: known[f].to_numpy().astype(float) for f in FAULTS}, known["fold"].to_numpy().astype(bool)
    trained = np.flatnonzero(~fold)
    borders = np.quantile(shapes[trained], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(trained) else np.zeros((SHAPES, BINS - 1))
    model = Model(borders, place)
    faults = [f for f in FAULTS if len(trained) and 0 < ys[f][trained].sum() < len(trained) and 0 < ys[f][fold].sum() < fold.sum()]
    if not faults:
        return model
    views = (model.text_rows(words, counts, shapes), model.meta_rows(meta))
    own, held = [v.pick(trained) for v in views], [v.pick(np.flatnonzero(fold)) for v in views]
    extra: dict[tuple[str, int], list[tuple[Rows, np.ndarray]]] = {(f, k): [] for f in faults for k in (0, 1)}  # what each view got from the other
    given = np.zeros(0, np.int64)
    for left in range(rounds, -1, -1):
        judges = {}
        for f in faults:
            for k in (0, 1):
                parts = [(own[k], ys[f][trained]), *extra[f, k]]
                flat, size = np.concatenate([r.flat for r, _ in parts]), np.concatenate([np.diff(r.start) for r, _ in parts])
                weights = fit(Rows(flat, np.concatenate(([0], np.cumsum(size))), own[k].width), np.concatenate([y for _, y in parts]), np.concatenate([np.full(len(y), 0.5 if i else 1.0) for i, (_, y) in enumerate(parts)]))
                judges[f, k] = _calibrated(held[k], weights, ys[f][fold])  # how sure it may be, shown by rows it wasn't fitted to
        if not left:
            break
        surest = _surest(unlabelled, model, judges, given, a_round, sure)
        for number, (f, k) in enumerate(judges):
            for y in (0, 1):
                part = surest.filter(pc.equal(surest["list"], 2 * number + y))
                if part.num_rows:
                    w, n, s, m = _unpacked(part, 3)
                    extra[f, 1 - k].append(((model.text_rows(w, n, s), model.meta_rows(m))[1 - k], np.full(part.num_rows, float(y))))
        given = np.union1d(given, surest["row"].to_numpy())
    for f in faults:
        model.views[f] = (judges[f, 0], judges[f, 1])
        model.combined[f] = fit_dense(np.stack([v.calibrated_margins(x) for x, v in zip(held, model.views[f])], 1), ys[f][fold], 1e-4)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.6, **options) -> DataFrame:
    """Chances of both faults, the score (chance of neither) and whether each document is kept."""
    source, marks = _source(docs, id_col), stored(_marks(labels), "marks")
    place = choose_words(source, marks)
    found = features(source, place)
    model = docs.sparkSession.sparkContext.broadcast(train(found, marks, place, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, shapes, meta = _unpacked(batch, 1)
            chances = model.value.chances((model.value.text_rows(words, counts, shapes), model.value.meta_rows(meta)))
            score = (1 - chances["low"]) * (1 - chances["toxic"])
            yield pa.record_batch([batch.column(0), *(pa.array(chances[f]) for f in FAULTS), pa.array(score), pa.array(1 - score <= threshold)], names=[id_col, *FAULTS, "score", "keep"])

    return found.select("id", "words", "shape", "meta").mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, low double, toxic double, score double, keep boolean")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.6, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, filtered where they lie: only a text and its metadata go through Python, once more."""
    source, marks = _source(docs, id_col), stored(_marks(labels), "marks")
    place = choose_words(source, marks)
    model = docs.sparkSession.sparkContext.broadcast(train(features(source, place), marks, place, **options))

    def keep(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = []
        for batch in slices(iter([pa.record_batch([source, text, lang, n_chars], names=["s", "t", "l", "n"])])):
            read = read_texts(batch.column(1))
            words, counts = _chosen_words(read, model.value.place, batch.num_rows)
            chances = model.value.chances((model.value.text_rows(words, counts, read.shapes), model.value.meta_rows(_metas(*(batch.column(k) for k in (0, 2, 3))))))
            out.append(1 - (1 - chances["low"]) * (1 - chances["toxic"]) <= threshold)
        return pa.array(np.concatenate([*out, np.zeros(0, bool)]))

    kept: Column = F.arrow_udf(keep, "boolean")(F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    return docs.where(kept)
