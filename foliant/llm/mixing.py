"""Operator 4: mixing sources to target weights along a curriculum; DataFrame functions only.

Sizes are words. Each source has a target: its weight's part of ``share`` times all words, at most ``max_repeats``
times its own words, what is above going to the others by weight until none is above. That level has a closed
form: with sources ordered by cap over weight, the first for which the rest's even share is within its cap sets it.

A source's documents stand in a fixed pseudo-random order (the MD5 digest of the id). Its words are taken from the start
of that order, again from the start when all are taken, until the target is met to the word; so the last document
may give a part of its words.

Each source's weight changes linearly over training: ``ramp`` at the start, 2 - ``ramp`` at the end, 1 on average.
Integrated up to time t it gives ramp*t + (1 - ramp)*t*t of the target; a document whose first word stands at
share u of its source's demand gets the t at which that integral is u as its training position.

Prefix sums run in hash buckets of some hundred rows, bucket sums in stretches of a thousand buckets, and stretch sums over
a source, so a source with a third of all rows is spread over all tasks.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source, last in order; rows
with equal ids are ordered by text hash, and rows equal in both share one decision in ``mixed_documents``; an
empty table gives an empty result; other columns are carried by ``mixed_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RAMPS = (1.5, 1.0, 0.5)
BUCKET_ROWS = 512


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """One row per source of (source, size): source_size, rank, target."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", _cycle(weights, F.col("rank")).cast("double"))
    ranked = ranked.withColumn("cap", max_repeats * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.sum(share * F.col("source_size")).over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"]
    leveled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio)).withColumn("final", first)
    return leveled.select("source", "source_size", "rank", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, share: float = 1.5, max_repeats: float = 2.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """What the mix takes of each document, and when: one row per row of ``docs``.

    Columns: the id, text_hash, source, size, source_size, target, taken, first_words and second_words (taken
    in the first and in the second run over the source), position and second_position in [0, 1].
    """
    if max_repeats > 2:
        raise ValueError("a document is taken twice at most")
    text = F.col(text_col).cast("string")
    sized = docs.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = stored(sized, "mix-sizes")
    buckets = max(1, sized.count() // bucket_rows)
    spread = F.conv(F.substring(F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("0")), 1, 8), 16, 10).cast("long")  # 32 bits
    placed = sized.withColumn("h", spread).withColumn("bucket", F.shiftright(F.col("h") * F.lit(min(buckets, 1 << 30)).cast("long"), 32))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn("stretch", F.shiftright("bucket", 10))
    before = lambda over, order: Window.partitionBy(*over).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stretches = sums.groupBy("source", "stretch").agg(F.sum("bucket_size").alias("stretch_size"))
    stretches = stretches.select(F.col("source").alias("its_source"), F.col("stretch").alias("its_stretch"), F.coalesce(F.sum("stretch_size").over(before(["source"], "stretch")), F.lit(0)).alias("stretch_start"))
    inner = F.coalesce(F.sum("bucket_size").over(before(["source", "stretch"], "bucket")), F.lit(0))
    starts = sums.withColumn("inner", inner).join(stretches, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("stretch") == F.col("its_stretch"))).select("source", "bucket", (F.col("stretch_start") + F.col("inner")).alias("bucket_start"))
    targets = source_targets(sized, weights, share, max_repeats)
    of_bucket = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("of_source"), F.col("bucket").alias("of_bucket"), "bucket_start", "source_size", "rank", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("h", id_col, "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(of_bucket, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    start, words = F.col("bucket_start") + F.col("in_bucket"), F.round("target").cast("long")
    taken = lambda left: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - start))
    ramp = _cycle(ramps, F.col("rank"))

    def when(at: Column, words_taken: Column) -> Column:
        u = at / F.col("target")
        return F.when(words_taken > 0, 2 * u / (ramp + F.sqrt(F.greatest(F.lit(0.0), ramp * ramp + 4 * (1 - ramp) * u))))

    out = run.withColumn("first_words", taken(words)).withColumn("second_words", taken(words - F.col("source_size")))
    return out.select(F.col(id_col), "text_hash", "source", "size", "source_size", "target", (F.col("first_words") + F.col("second_words")).alias("taken"), "first_words", "second_words", when(start, F.col("first_words")).alias("position"), when(start + F.col("source_size"), F.col("second_words")).alias("second_position"))


def training_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` range-sorted by position; what is never taken comes last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), mixed.columns[0])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as the mix takes them, in training order: whole copies, none, one or two of each row.

    A copy of which the mix takes half of the words or more is there whole; with the smaller ones left out, a
    source's words differ from its target by half a document at most.
    """
    mixed = mix(docs, id_col, text_col, source_col, **options)
    copies = F.filter(F.array(F.when(2 * F.col("first_words") >= F.col("size"), F.col("position")), F.when(2 * F.col("second_words") >= F.col("size"), F.col("second_position"))), lambda x: x.isNotNull())
    decided = mixed.where(F.col("size") > 0).groupBy(F.col(id_col).alias("foliant_mix_id"), F.col("text_hash").alias("foliant_mix_hash"), F.col("source").alias("foliant_mix_source")).agg(F.min_by(copies, F.col("position")).alias("foliant_mix_copies"))
    joined = docs.join(decided, F.col(id_col).eqNullSafe(F.col("foliant_mix_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("foliant_mix_hash")) & F.col(source_col).cast("string").eqNullSafe(F.col("foliant_mix_source")))
    return joined.select(*[docs[c] for c in docs.columns], F.explode("foliant_mix_copies").alias("foliant_mix_position")).orderBy("foliant_mix_position", id_col).drop("foliant_mix_position")
