"""Operator 12: hard negatives by a dual-tree search.

One binary tree of principal directions (fitted on ``SAMPLE`` rows, chosen by a hash of the id) holds all candidate
rows in its leaves; the anchors lie in the same tree, cut where a node has about ``ANCHORS`` of them. A node is a ball: the
centre is the sample's, the radius the largest distance of any row that lies in it. For a pair of nodes the two
balls bound every inner product between their rows, so one look at a pair tells whether a whole group of
anchors may find anything in a whole group of candidates. The search descends from the two roots over pairs of nodes and
drops those whose interval can't hold a wanted score; the pairs of leaves that are left are scored exactly.

This is done four times. Positives: each group of anchors is first scored against the leaf whose centre suits it best;
the k-th best scores so found are what other pairs have to reach. Negatives: each anchor and positive asks for the scores
between two shares of the positive score; again one leaf first, whose results raise the lower bounds.

Scaling: leaves are cut into blocks of at most about ``BLOCK`` rows, whatever their number of rows (copies of one vector
make a leaf of radius 0 with many blocks), and anchors into blocks of ``ANCHORS``, as rows of bytes. Spark joins the pairs of leaves with both
kinds of blocks; a task scores a pair of blocks at a time and returns each anchor's best only. The best of all blocks come from a rank
that is cut before its shuffle. The driver holds the tree and radii: 2 * ``LEAVES`` nodes at most, whatever the table.
The work on data without any structure is that of scoring all anchors against all rows in blocks.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; shorter vectors
are filled with zeros; components are cut at 2**62 and scores at 63 bits; every row counts as itself, so repeated rows repeat in the results; an
anchor's other rows are those with other ids; an anchor without positives, and one without negatives in its range,
gives no rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES
from .common import stored

SAMPLE, LEAVES, BLOCK, ANCHORS = 8192, 256, 2048, 512
_BLOCKS = "leaf int, chunk int, n int, reach double, ids binary, labels binary, vectors binary, width int, places binary"


def quantized(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, before any relabelling; components are ``floor(256 * x)``."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cut = lambda c: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), 256.0 * c))).cast("long")
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(whole)
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(x, cut).alias("v"))


@dataclass
class Tree:
    """A complete binary tree; node 1 is the root, 2k and 2k + 1 are under k. ``centres`` has a row per node."""

    depth: int
    directions: np.ndarray
    borders: np.ndarray
    centres: np.ndarray

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row belongs to, from 0."""
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", rows, self.directions[node]) > self.borders[node])
        return node - (1 << self.depth)


def fit_tree(sample: np.ndarray, depth: int) -> Tree:
    """Split at the median of the direction in which a node's sample varies most."""
    nodes, width = 2 << depth, sample.shape[1]
    tree = Tree(depth, np.zeros((nodes, width)), np.zeros(nodes), np.zeros((nodes, width)))
    parts = {1: sample}
    for node in range(1, nodes):
        own = parts.pop(node)
        tree.centres[node] = own.mean(0) if len(own) else tree.centres[node // 2]
        if node < 1 << depth:
            if len(own) > 1:
                tree.directions[node] = _widest(own - tree.centres[node])
            along = own @ tree.directions[node]
            tree.borders[node] = np.median(along) if len(own) else 0.0
            above = along > tree.borders[node]
            parts[2 * node], parts[2 * node + 1] = own[~above], own[above]
    return tree


def _widest(rows: np.ndarray, steps: int = 25) -> np.ndarray:
    """About the direction in which centred rows vary most, by power iteration from the row farthest out."""
    axis = rows[np.argmax((rows**2).sum(1))]
    for _ in range(steps):
        length = np.linalg.norm(axis)
        if length == 0:
            return axis
        axis = rows.T @ (rows @ (axis / length))
    return axis / max(np.linalg.norm(axis), np.finfo(np.float64).tiny)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width, shorter vectors filled with zeros."""
    size = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _narrow(rows: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    most = int(max(rows.max(initial=0), -rows.min(initial=0)))
    return np.ascontiguousarray(rows, "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _dealt(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """Rows with their leaf and a running number of their task, by which large leaves are cut."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            leaf = shared.value.leaves(_matrix(b.column(2), width).astype(np.float64))
            yield pa.record_batch([*b.columns, pa.array(leaf, pa.int32()), pa.array(np.arange(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "leaf", "slot"])
            at += b.num_rows

    return stored(rows.mapInArrow(route, "vec_id long, label long, v array<long>, leaf int, slot long"), "negatives-rows")


def _blocks(dealt: DataFrame, leaf: Column, rows_each: int, tree: Tree, level: int, width: int, name: str) -> DataFrame:
    """Rows packed by leaf of a level, at most about ``rows_each`` a block, by id; ``reach`` is the largest distance from the node's centre."""
    centres = dealt.sparkSession.sparkContext.broadcast(tree.centres[1 << level : 2 << level])
    placed = dealt.withColumn("leaf", leaf.cast("int"))
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / rows_each).alias("chunks"))  # LEAVES rows at most
    cut = placed.join(F.broadcast(sizes), "leaf").withColumn("chunk", (F.col("slot") % F.col("chunks")).cast("int")).select("leaf", "chunk", "vec_id", "label", "v")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending"), ("label", "ascending")]).combine_chunks()
        node = group["leaf"][0].as_py()
        rows = _matrix(group["v"].chunk(0), width)
        reach = float(np.sqrt(((rows - centres.value[node]) ** 2).sum(1).max()))
        ids, labels, narrow = group["vec_id"].to_numpy(), group["label"].to_numpy(), _narrow(rows)
        cells = [node, group["chunk"][0].as_py(), len(rows), reach, ids.tobytes(), labels.tobytes(), narrow.tobytes(), narrow.itemsize, b""]
        return pa.table([[c] for c in cells], schema=pa.schema([("leaf", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("reach", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("places", pa.binary())]))

    return stored(cut.groupBy("leaf", "chunk").applyInArrow(pack, _BLOCKS), name)


def _balls(tree: Tree, level: int, blocks: DataFrame) -> np.ndarray:
    """Radius of every node down to a level, -1 without rows; a node's ball holds those under it."""
    out = np.full(2 << level, -1.0)
    for r in blocks.groupBy("leaf").agg(F.max("reach").alias("reach")).collect():  # LEAVES rows at most
        out[(1 << level) + r.leaf] = r.reach
    for node in range((1 << level) - 1, 0, -1):
        under = [c for c in (2 * node, 2 * node + 1) if out[c] >= 0]
        out[node] = max((float(np.linalg.norm(tree.centres[node] - tree.centres[c])) + out[c] for c in under), default=-1.0)
    return out


def intervals(tree: Tree, a: np.ndarray, c: np.ndarray, a_balls: np.ndarray, c_balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that rows of nodes ``a`` and ``c`` may have, with room for rounding."""
    norms = np.linalg.norm(tree.centres, axis=1)
    middle = np.einsum("ij,ij->i", tree.centres[a], tree.centres[c])
    spread = norms[a] * c_balls[c] + norms[c] * a_balls[a] + a_balls[a] * c_balls[c]
    spread += 1e-9 * (norms[a] + a_balls[a]) * (norms[c] + c_balls[c]) + 1e-6
    return middle - spread, middle + spread


def descend(tree: Tree, levels: tuple[int, int], balls: tuple[np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (of anchors, of candidates) between which there may be scores from ``low`` to ``high``.

    Both bounds are by node of the anchors' tree: the least and greatest of what is asked for under it.
    """
    a, c = np.ones(1, np.int64), np.ones(1, np.int64)
    for step in range(max(levels) + 1):
        alive = (balls[0][a] >= 0) & (balls[1][c] >= 0)
        a, c = a[alive], c[alive]
        least, greatest = intervals(tree, a, c, *balls)
        open_ = (greatest >= low[a]) & (least <= high[a])
        a, c = a[open_], c[open_]
        if step < levels[0]:
            a, c = np.concatenate((2 * a, 2 * a + 1)), np.concatenate((c, c))
        if step < levels[1]:
            a, c = np.concatenate((a, a)), np.concatenate((2 * c, 2 * c + 1))
    return a - (1 << levels[0]), c - (1 << levels[1])


def _upwards(values: np.ndarray, level: int, best) -> np.ndarray:
    """Values of leaves, and of each node above the best of those under it."""
    out = np.concatenate((np.zeros(1 << level), values))
    for node in range((1 << level) - 1, 0, -1):
        out[node] = best(out[2 * node], out[2 * node + 1])
    return out


def _unpacked(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[prefix + k], "<i8") for k in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[prefix + "vectors"], f"<i{row[prefix + 'width']}").reshape(len(ids), -1)


def inner_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; as floating-point numbers where these hold them all."""
    most = a.shape[1] * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0))
    if most < 2**51:
        return a.astype(np.float64) @ c.astype(np.float64).T
    exact = a.astype(object) @ c.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_places(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` best allowed scores, the first columns where scores are equal."""
    n = scores.shape[1]
    if scores.dtype == np.float64 and np.abs(scores).max(initial=0) < 2**52 / max(1, n):
        keys = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), -np.inf)
        at = np.argpartition(-keys, k - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), scores.shape)
        row, col = np.repeat(np.arange(len(scores)), at.shape[1]), at.ravel()
        kept = keys[row, col] > -np.inf
        return row[kept], col[kept]
    chosen = [(r, c) for r in range(len(scores)) for c in sorted(np.flatnonzero(allowed[r]), key=lambda c: (-int(scores[r, c]), c))[:k]]
    return tuple(np.array(x, np.int64) for x in zip(*chosen)) if chosen else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_FOUND = "leaf int, chunk int, place int, asked int, anchor_id long, id long, score long"


def _scored(asks: DataFrame, blocks: DataFrame, pairs: tuple[np.ndarray, np.ndarray], k: int, same_label: bool, kept: int) -> DataFrame:
    """The best ``k`` rows of each pair of blocks for everything that the anchors ask; then of all pairs.

    ``asks`` are the anchors' blocks with ``wants``: (place, asked, low, high) of each question.
    """
    spark = asks.sparkSession
    if not len(pairs[0]):
        return spark.createDataFrame([], _FOUND)
    listed = spark.createDataFrame(pa.table({"leaf": pa.array(pairs[0], pa.int32()), "c_leaf": pa.array(pairs[1], pa.int32())}))  # LEAVES**2 rows at most
    own = asks.select("leaf", "chunk", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors", "width")], "wants")
    theirs = blocks.select(F.col("leaf").alias("c_leaf"), *[F.col(c).alias(f"c_{c}") for c in ("ids", "labels", "vectors", "width")])
    a_block = F.length("a_ids") + F.length("a_labels") + F.length("a_vectors") + 64 * F.size("wants")
    size = own.agg(F.coalesce(F.sum(a_block), F.lit(0)).alias("n")).first().n
    met = theirs.join(F.broadcast(listed), "c_leaf").join(F.broadcast(own) if size <= BROADCAST_BYTES else own, "leaf")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, labels, a = _unpacked(row, "a_")
                c_ids, c_labels, c = _unpacked(row, "c_")
                scores = inner_products(a, c)
                allowed = (labels[:, None] == c_labels) == same_label
                if same_label:
                    allowed &= ids[:, None] != c_ids
                out = []
                for asked in sorted({w["asked"] for w in row["wants"]}):
                    wants = [w for w in row["wants"] if w["asked"] == asked]
                    at = np.array([w["place"] for w in wants])
                    low, high = np.array([w["low"] for w in wants])[:, None], np.array([w["high"] for w in wants])[:, None]
                    own_scores = scores[at]
                    r, col = best_places(own_scores, allowed[at] & (own_scores >= low) & (own_scores <= high), k)
                    out.append((at[r], np.full(len(r), asked), ids[at[r]], c_ids[col], own_scores[r, col]))
                place, asked, anchor, found, score_ = (np.concatenate(x) for x in zip(*out))
                n = len(place)
                yield pa.record_batch([pa.array(np.full(n, row["leaf"]), pa.int32()), pa.array(np.full(n, row["chunk"]), pa.int32()), pa.array(place, pa.int32()), pa.array(asked, pa.int32()), pa.array(anchor, pa.int64()), pa.array(found, pa.int64()), pa.array(score_.astype(np.int64), pa.int64())], names=["leaf", "chunk", "place", "asked", "anchor_id", "id", "score"])

    return _best(met.mapInArrow(score, _FOUND), kept)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("leaf", "chunk", "place", "asked").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(tree: Tree, levels: tuple[int, int], anchors: DataFrame, blocks: DataFrame, balls: tuple[np.ndarray, np.ndarray], wants: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
    """Best ``k`` rows for every question: first from one leaf for each group, then from all pairs that may hold better ones.

    ``wants``: leaf, chunk and an array of (place, asked, low, high), a row per block of anchors.
    """
    def asked(w: DataFrame) -> DataFrame:
        return anchors.join(w, ["leaf", "chunk"])

    def bounds(w: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(1 << levels[0], np.inf), np.full(1 << levels[0], -np.inf)
        for r in w.groupBy("leaf").agg(F.min(F.array_min("wants.low")).alias("low"), F.max(F.array_max("wants.high")).alias("high")).collect():  # LEAVES rows at most
            low[r.leaf], high[r.leaf] = r.low, r.high
        return low, high

    low, high = bounds(wants)
    pairs = descend(tree, levels, balls, _upwards(low, levels[0], min), _upwards(high, levels[0], max))
    if not len(pairs[0]):
        return wants.sparkSession.createDataFrame([], _FOUND + ", rank int")
    middle = np.einsum("ij,ij->i", tree.centres[pairs[0] + (1 << levels[0])], tree.centres[pairs[1] + (1 << levels[1])])
    aim = np.abs(middle - np.minimum(high[pairs[0]], np.finfo(np.float64).max))
    order = np.lexsort((pairs[1], -middle if same_label else aim, pairs[0]))
    first = np.zeros(len(order), bool)
    first[order[np.flatnonzero(np.diff(pairs[0][order], prepend=-1))]] = True
    probed = stored(_scored(asked(wants), blocks, (pairs[0][first], pairs[1][first]), k, same_label, k), f"{name}-first")
    reached = probed.where(F.col("rank") == k).select("leaf", "chunk", "place", "asked", F.col("score").alias("reached"))
    each = wants.select("leaf", "chunk", F.inline("wants")).join(reached, ["leaf", "chunk", "place", "asked"], "left")
    raised = each.withColumn("low", F.greatest("low", F.coalesce(F.col("reached").cast("double"), F.col("low")))).groupBy("leaf", "chunk").agg(F.collect_list(F.struct("place", "asked", "low", "high")).alias("wants"))  # a block's questions
    raised = stored(raised, f"{name}-raised")
    low, _ = bounds(raised)
    again = set(zip(*descend(tree, levels, balls, _upwards(low, levels[0], min), _upwards(high, levels[0], max))))
    rest = [(a, c) for a, c, done in zip(*pairs, first) if not done and (a, c) in again]
    others = _scored(asked(raised), blocks, tuple(np.array(x, np.int64) for x in zip(*rest)) if rest else (np.zeros(0, np.int64),) * 2, k, same_label, k)
    return stored(_best(probed.drop("rank").unionByName(others.drop("rank")), k), name)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, sample: int = SAMPLE, block: int = BLOCK, group: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of (vec_id, label, v).

    ``is_anchor`` is over ``vec_id``. An anchor's negatives for a positive are the ``negatives`` best rows of other labels whose scores lie between
    ``least`` and ``most`` percent of the positive's score.
    """
    spark = rows.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("width")).first()
    if not facts.anchors:
        return _named(spark, None, None)
    width = max(1, facts.width)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()  # the tree's shape only; a fixed number of rows
    depth = min(int(math.log2(LEAVES)), max(0, math.ceil(math.log2(facts.n / block))))
    tree = fit_tree(_matrix(drawn["v"].combine_chunks(), width).astype(np.float64), depth)
    a_level = min(depth, max(0, math.ceil(math.log2(facts.anchors / group))))
    dealt = _dealt(rows, tree, width)
    blocks = _blocks(dealt, F.col("leaf"), block, tree, depth, width, "negatives-blocks")
    anchors = _blocks(dealt.where(is_anchor), F.shiftright("leaf", depth - a_level), group, tree, a_level, width, "negatives-anchors")
    levels, balls = (a_level, depth), (_balls(tree, a_level, anchors), _balls(tree, depth, blocks))
    whole = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.cast("int").alias("place"), F.lit(0).alias("asked"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    found = _search(tree, levels, anchors, blocks, balls, anchors.select("leaf", "chunk", whole.alias("wants")), positives, True, "negatives-positives")
    share = lambda percent, up: F.floor((F.col("score").cast("decimal(20,0)") * percent + up) / 100).cast("double")
    ranges = found.where("score >= 0").select("leaf", "chunk", "place", F.col("rank").alias("asked"), share(least, 99).alias("low"), share(most, 0).alias("high")).where("low <= high")
    wants = stored(ranges.groupBy("leaf", "chunk").agg(F.collect_list(F.struct("place", "asked", "low", "high")).alias("wants")), "negatives-wants")  # a block's questions
    mined = _search(tree, levels, anchors, blocks, balls, wants, negatives, False, "negatives-mined")
    return _named(spark, found, mined)


def _named(spark: SparkSession, found: DataFrame | None, mined: DataFrame | None) -> DataFrame:
    if found is None or mined is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    own = found.select("leaf", "chunk", "place", F.col("rank").alias("asked"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(own, ["leaf", "chunk", "place", "asked"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
