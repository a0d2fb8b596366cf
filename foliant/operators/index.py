"""Keyword searches that the positional index answers by itself, without a look at contents.

The index holds (db_id, token, id, positions) sorted by token; its dictionary holds every token once, sorted, with numbers of rows and places. A
query's tokens are looked up in the dictionary together, and a prefix is a range of it. Phrases are intersected by
position, the rarest token first; NEAR is a band join by position; AND, OR and NOT are semi joins, unions and anti joins of keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.keywords import Both, Either, Near, Nothing, Phrase, Without, parse, sanitize

KEY = ("db_id", "id")


def write_dictionary(index: DataFrame, path: str) -> None:
    """Every token with the number of rows and places that hold it, sorted."""
    counted = index.groupBy("token").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("places"))
    counted.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").option("compression", "zstd").parquet(path)


def phrases(node: object) -> Iterator[Phrase]:
    if isinstance(node, Phrase):
        yield node
    elif isinstance(node, Near):
        yield from node.phrases
    elif not isinstance(node, Nothing):
        yield from phrases(node.left)
        yield from phrases(node.right)


def _is(token: str, prefix: bool) -> Column:
    """A token, or a range of them; both are tests that a sorted file's statistics can rule out."""
    return F.startswith(F.col("token"), F.lit(token)) if prefix else F.col("token") == token


def met(left: DataFrame, right: DataFrame, on: tuple[str, ...] = KEY, how: str = "left_semi", extra: Column | None = None) -> DataFrame:
    """A join by key (semi, unless told) in which null shards and null cases are equal; ``extra`` sees the right side's columns with ``_`` before."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])
    tests = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c in ("db_id", "process_number") else F.col(c) == F.col(f"_{c}") for c in on]
    return left.join(renamed, reduce(and_, tests if extra is None else [*tests, extra]), how)


class IndexSearch:
    """Searches over one index and its dictionary."""

    def __init__(self, index: DataFrame, dictionary: DataFrame):
        self.index, self.dictionary = index, dictionary

    def frequencies(self, asked: list[Phrase]) -> dict[tuple[str, bool], int]:
        """Places of each token and prefix of a query: one row of sums over the few dictionary rows that they choose."""
        terms = sorted({(t, p.prefix and k == len(p.tokens) - 1) for p in asked for k, t in enumerate(p.tokens)})
        if not terms:
            return {}
        chosen = self.dictionary.where(reduce(lambda a, b: a | b, [_is(*t) for t in terms]))
        sums = chosen.agg(*[F.coalesce(F.sum(F.when(_is(*t), F.col("places"))), F.lit(0)).alias(f"n{k}") for k, t in enumerate(terms)]).first()
        return dict(zip(terms, sums))

    def starts(self, phrase: Phrase, often: dict[tuple[str, bool], int]) -> DataFrame:
        """(db_id, id, starts): rows with a phrase, and the places where it begins."""
        last = len(phrase.tokens) - 1
        steps = sorted((often[t, phrase.prefix and k == last], k, t) for k, t in enumerate(phrase.tokens))
        found = None
        for _, k, token in steps:
            prefix = phrase.prefix and k == last
            here = self.index.where(_is(token, prefix)).select(*KEY, F.transform("positions", lambda p: p - k).alias("here"))  # noqa: B023
            if prefix:  # several tokens of a row
                here = here.groupBy(*KEY).agg(F.flatten(F.collect_list("here")).alias("here"))
            if found is None:
                found = here.withColumnRenamed("here", "starts")
            else:
                joined = met(found, here, how="inner").withColumn("starts", F.array_intersect("starts", "_here"))
                found = joined.where(F.size("starts") > 0).select(*KEY, "starts")
        return found

    def near(self, node: Near, often: dict[tuple[str, bool], int]) -> DataFrame:
        """Keys of rows where, for some place of one phrase, each other one begins there or before and ends at most ``distance`` tokens before.

        Rows without all phrases go first, by key. Places of the others are joined by bands of the reach's width, so a
        row with very many of them makes no pairs of all.
        """
        found = [self.starts(p, often) for p in node.phrases]
        sizes = [len(p.tokens) for p in node.phrases]
        whole = [reduce(met, [f for j, f in enumerate(found) if j != i], own) for i, own in enumerate(found)]
        places = [w.select(*KEY, F.explode("starts").alias("start")) for w in whole]
        out = None
        for j in range(len(sizes)):
            kept = places[j]
            for i in range(len(sizes)):
                if i != j:
                    reach = node.distance + sizes[i]
                    band = lambda c: F.floor(F.col(c) / (reach + 1))  # noqa: B023, E731
                    before = places[i].withColumn("band", F.explode(F.array(band("start"), band("start") + 1)))
                    kept = met(kept.withColumn("band", band("start")), before, (*KEY, "band"), extra=F.col("_start").between(F.col("start") - reach, F.col("start"))).drop("band")
            keys = kept.select(*KEY)
            out = keys if out is None else out.unionAll(keys)
        return out

    def keys(self, node: object, often: dict[tuple[str, bool], int]) -> DataFrame:
        """(db_id, id) of the matching rows, some more than once."""
        if isinstance(node, Phrase):
            return self.starts(node, often).select(*KEY)
        if isinstance(node, Near):
            return self.near(node, often)
        if isinstance(node, Nothing):
            return self.index.where("false").select(*KEY)
        left = self.keys(node.left, often)
        right = self.keys(node.right, often)
        return left.unionAll(right) if isinstance(node, Either) else met(left, right, how="left_semi" if isinstance(node, Both) else "left_anti")

    def search(self, keywords: str) -> DataFrame:
        """(db_id, id) of the rows that a keyword search finds, each once."""
        tree = parse(sanitize(keywords))
        return self.keys(tree, self.frequencies(list(phrases(tree)))).distinct()

    def matches(self, paragraphs: DataFrame, keywords: str) -> DataFrame:
        """The rows themselves; of their columns only those that are asked for later are read."""
        return met(paragraphs, self.search(keywords))
