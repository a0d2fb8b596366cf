"""Joins of intervals by equality: every interval is cut into pieces of a binary division of the axis.

An interval of any length is at most two pieces per level, and a point lies in one piece of each level, so point and interval meet in
exactly one common piece. Two intervals overlap if the later beginning lies in the other one: two such
joins give each pair once. Nothing is compared that doesn't match, and nothing grows with the length of an interval but its logarithm.
Numbers, least and greatest values of the overlaps come from sums per piece, without any pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 40


def days(date: Column) -> Column:
    """A date as a whole number that isn't negative for dates from the year 1 on."""
    return (F.unix_date(date) + 719_162).cast("long")


def pieces(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The pieces (level, place) of an interval of whole numbers from 0 on, both ends included; none if it is empty or null."""

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.floor((start + size - 1) / size).cast("long"), F.floor((end + 1) / size).cast("long")
        left = F.when((low < high) & (low % 2 == 1), F.struct(k.alias("level"), low.alias("place")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("place")))
        return F.array(left, right)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda p: p.isNotNull())


def ancestors(point: Column, levels: int = LEVELS) -> Column:
    """The piece (level, place) that a point lies in, for every level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", point, k).alias("place")))


def _top(*tables: tuple[DataFrame, Column]) -> int:
    """The highest level that pieces of the tables' intervals may have: by the largest number in them."""
    most = max((df.agg(F.max(c).alias("m")).first().m or 0) for df, c in tables)
    return max(1, int(most).bit_length())


def stabbed(points: DataFrame, point: Column, intervals: DataFrame, start: Column, end: Column, levels: int | None = None) -> DataFrame:
    """Every row of ``points`` with every row of ``intervals`` that holds its point; the two have no column names in common.

    Points and bounds are whole numbers from 0 on; null or inverted ones match nothing.
    """
    levels = _top((points, point), (intervals, end)) if levels is None else levels
    cut = intervals.withColumn("_piece", F.explode(pieces(start, end, levels)))
    above = points.where(point.isNotNull()).withColumn("_above", F.explode(ancestors(point, levels)))
    return above.join(cut, F.col("_above") == F.col("_piece")).drop("_above", "_piece")


def overlapping(left: DataFrame, right: DataFrame, start: str = "start", end: str = "end", other_start: str = "other_start", other_end: str = "other_end") -> DataFrame:
    """All pairs of overlapping intervals (ends included), each once; columns hold whole numbers from 0 on, and names differ."""
    left = left.where(F.col(start) <= F.col(end))
    right = right.where(F.col(other_start) <= F.col(other_end))
    levels = _top((left, F.col(end)), (right, F.col(other_end)))
    late_left = stabbed(left, F.col(start), right, F.col(other_start), F.col(other_end), levels)
    late_right = stabbed(right, F.col(other_start), left, F.col(start) + 1, F.col(end), levels)
    columns = [*left.columns, *right.columns]
    return late_left.select(columns).unionAll(late_right.select(columns))


def overlap_totals(left: DataFrame, right: DataFrame, value: str, start: str = "start", end: str = "end", other_start: str = "other_start", other_end: str = "other_end") -> DataFrame:
    """(start, end, n, low, high): how many intervals of ``right`` each one of ``left`` overlaps, and the least and greatest ``value`` of these.

    Equal intervals of ``left`` have one row, those without overlaps none. Pairs, which may be as many as the square of the rows, are
    not made: beginnings on the right are summed by the pieces above them, intervals on the right by their own pieces, and an interval of
    ``left`` meets a sum for each of its pieces.
    """
    own = left.where(F.col(start) <= F.col(end)).select(start, end).distinct()
    totals = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    others = right.where(F.col(other_start) <= F.col(other_end)).select(other_start, other_end, F.lit(1).cast("long").alias("n"), F.col(value).alias("low"), F.col(value).alias("high"))
    others = totals(others, other_start, other_end)
    levels = _top((own, F.col(end)), (others, F.col(other_end)))
    began = totals(others.withColumn("piece", F.explode(ancestors(F.col(other_start), levels))), "piece")
    held = totals(others.withColumn("piece", F.explode(pieces(F.col(other_start) + 1, F.col(other_end), levels))), "piece")
    met = own.withColumn("piece", F.explode(pieces(F.col(start), F.col(end), levels))).join(began, "piece")
    met = met.unionByName(own.withColumn("piece", F.explode(ancestors(F.col(start), levels))).join(held, "piece"))
    return totals(met, start, end)
