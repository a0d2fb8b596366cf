"""Operator 5: near duplicates by Order MinHash and banded alignment.

Texts are lower-cased words; their five-word shingles, each labelled with its occurrence, are the k-mers. For each of
``SKETCHES`` hash functions a sketch holds the ``ORDERED`` smallest labelled shingles in text order; two texts agree in a
sketch only if they share these shingles and their order, with a chance near the seventh power of their similarity:
at 0.8 a pair agrees in none with a chance of about 1e-5, and at 0.3 in any with one of 0.01. Short texts have sketches
of one shingle besides.

Equal texts are one node. Nodes that agree in a sketch form a bucket. Each bucket's most popular node (the one that
shares most sketches with others, such as the original of many edited copies) is its centre, and every member is compared
with it; a bucket of many copies so makes one pair per member. Then, in two rounds, members that are still in another
class than somebody in their bucket are compared further: all pairs of small buckets, and in large ones with about 32,
then 1024 nodes that are drawn anew for each bucket and round. So buckets of up to 1024 are searched whole. Pairs whose
ends already are in one class are left out, since no link between them changes the result.

Members of larger buckets that still hold more than one class are searched whole by their rare shingles. All texts
have their labelled shingles in one order, those that are frequent among these members last (the frequencies come from
a sample and only balance the groups; any order finds the same). If two texts of n and m shingles are a link, at
most (n + m) / 9 shingles are in one of both only, and all that come before the first common one are. So its places i
and j have i + j <= (n + m) / 9: it is among the first n / 9 of one text and, since each text has 0.8 of all, among the
first fifth of the other. Only these are joined; a passage that all members share comes late in all of them and groups
nobody. Of a group's largest class no pairs within are made, and groups with many pairs are dealt to many tasks.

Every node has a parity map: 1024 bits, each telling whether an odd number of its labelled shingles falls there. Two maps
differ in no more bits than the texts differ in shingles, so maps (and numbers of shingles) that are too far apart prove
that there is no link. This is looked at inside the joins, before a pair becomes a row or moves any text.

A pair is a link when the shingles that both have in the same order, found by banded alignment, are 0.8 or more of
all shingles of both. Classes are connected components of links: each round takes
every class to its smallest neighbour, with pointer jumps.

Defined cases: a null text is empty; texts without words are alike only if equal; fewer than five words are one
shingle; rows with equal ids are rows of their own; a class is named by its smallest id (null if it has no other);
columns besides the id and the text are ignored by ``near_duplicate_classes`` and carried by
``without_near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .common import small as _small
from .shingles import in_order_similarity, mix, occurrences, shingles, word_hashes

SHINGLE_WORDS, SKETCHES, ORDERED, LEAST = 5, 48, 7, 0.8
SHORT_SHINGLES, SHORT_SKETCHES = 24, 12
SMALL_BUCKET, DRAWN = 16, 32
MAP_LONGS = 16
ORDER_CELLS, ORDER_TEXTS, GROUP_PAIRS = 1 << 20, 100_000, 4 << 20
BROADCAST_BYTES = 16 << 20
_SEEDS = mix(np.arange(1, SKETCHES + SHORT_SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def label(grams: np.ndarray) -> np.ndarray:
    """Shingles labelled with their occurrence."""
    return mix(grams + occurrences(grams).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def parities(labelled: np.ndarray) -> np.ndarray:
    """A parity map of labelled shingles, as 64-bit values."""
    bits = 64 * MAP_LONGS
    odd = np.bincount((labelled >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(labelled: np.ndarray) -> np.ndarray:
    """Order MinHash sketches of a text's labelled shingles as 64-bit values; none for a text without words."""
    n = len(labelled)
    if not n:
        return np.zeros(0, np.uint64)
    some = _SEEDS[: SKETCHES + (SHORT_SKETCHES if n <= SHORT_SHINGLES else 0), None]
    value = ((labelled[None, :] ^ some) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(32)
    value = (value.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ value.astype(np.uint32)
    kept = min(ORDERED, n)
    at = np.argpartition(value[:SKETCHES], kept - 1, axis=1)[:, :kept] if n > kept else np.broadcast_to(np.arange(n), (SKETCHES, n))
    at = np.sort(at, axis=1)  # in text order
    out = _SEEDS[:SKETCHES].copy()
    for k in range(kept):
        out = mix(out * np.uint64(3) + labelled[at[:, k]])
    if n <= SHORT_SHINGLES:
        out = np.concatenate((out, mix(_SEEDS[SKETCHES:] + labelled[value[SKETCHES:].argmin(axis=1)])))
    return out


def _grams(texts: list[str]) -> list[np.ndarray]:
    return [shingles(w, SHINGLE_WORDS) for w in word_hashes([t.lower().encode() for t in texts])]


def _node(text: Column) -> Column:
    """The first 16 bytes of a text's SHA-256 digest: equal texts have one node, different ones can't be made to share it."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _may_link(n: Column, m: Column, x: Column, y: Column) -> Column:
    """False only where numbers of shingles or parity maps prove that two nodes are no link."""
    differ = sum((F.bit_count(x[f"m{k}"].bitwiseXOR(y[f"m{k}"])) for k in range(1, MAP_LONGS)), F.bit_count(x["m0"].bitwiseXOR(y["m0"])))
    return (F.least(n, m) >= LEAST * F.greatest(n, m)) & (differ * (1 + LEAST) <= (n + m) * (1 - LEAST) + 1e-6)


def _components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) after joining the classes that new links (a, b) connect; a class is named by its smallest node."""
    while True:
        known = _small(labels, 64)
        end = lambda x: known.select(F.col("node").alias(x), F.col("class").alias(f"{x}_class"))
        across = links.join(end("a"), "a").join(end("b"), "b").where("a_class != b_class")
        low, high = F.least("a_class", "b_class"), F.greatest("a_class", "b_class")
        hook = stored(across.select(high.alias("class"), low.alias("to")).groupBy("class").agg(F.min("to").alias("to")), "hooks")
        n = hook.count()
        if not n:
            return labels
        few = n * 64 <= BROADCAST_BYTES
        for _ in range(3):  # ends of chains, eight steps at a time
            over = (F.broadcast(hook) if few else hook).select(F.col("class").alias("to"), F.col("to").alias("further"))
            hook = hook.join(over, "to", "left").select("class", F.coalesce("further", "to").alias("to"))
        labels = stored(labels.join(F.broadcast(hook) if few else hook, "class", "left").select("node", F.coalesce("to", "class").alias("class")), "labels")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, with their similarity; ``texts`` has (node, grams) with the shingle hashes as bytes."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("grams").alias(f"{x}_grams"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_grams", "b_grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            alike = np.array([in_order_similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), LEAST) for p, q in zip(x, y)], np.float64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(alike)], names=["a", "b", "similarity"]).filter(pa.array(alike >= LEAST))

    return both.mapInArrow(run, "a binary, b binary, similarity double")


def _prefixes(texts: DataFrame) -> DataFrame:
    """(token, node, class, at, shingles, starts) of the first fifth of each text's labelled shingles, rare ones first.

    ``at`` is the place in that order, ``starts`` tells whether it is in the first ninth.
    """
    spark = texts.sparkSession
    share = max(1, texts.count() // ORDER_TEXTS)
    own = lambda b: label(np.frombuffer(b, np.uint64))
    cell = lambda x: (x % np.uint64(ORDER_CELLS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(ORDER_CELLS, np.int64)
        for batch in slices(batches, 0):
            often += np.bincount(cell(np.concatenate([own(b) for b in batch.column(0).to_pylist()])), minlength=ORDER_CELLS)
        k = np.flatnonzero(often)
        yield pa.record_batch([pa.array(k, pa.int64()), pa.array(often[k], pa.int64())], names=["cell", "n"])

    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("grams")
    counted = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # ORDER_CELLS rows at most
    often = np.zeros(ORDER_CELLS, np.int64)
    often[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    frequent = spark.sparkContext.broadcast(often)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            tokens, sizes = [], []
            for b in batch.column(1).to_pylist():
                x = own(b)
                sizes.append(len(x))
                tokens.append(x[np.lexsort((x, frequent.value[cell(x)]))[: int(len(x) * (1 - LEAST) + 1e-6) + 1]])
            kept = np.array([len(x) for x in tokens], np.int64)
            owner = np.repeat(np.arange(len(kept)), kept)
            at, size = np.arange(len(owner)) - np.repeat(np.cumsum(kept) - kept, kept), np.array(sizes, np.int64)[owner]
            starts = at <= size * ((1 - LEAST) / (1 + LEAST)) + 1e-6
            yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array(at), pa.array(size), pa.array(starts)], names=["token", "node", "class", "at", "shingles", "starts"])

    return texts.select("node", "grams", "class").mapInArrow(prefix, "token long, node binary, class binary, at long, shingles long, starts boolean")


def _prefix_pairs(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in different classes, among them every link; ``left`` has (node, class, shingles, map)."""
    postings = stored(_prefixes(stored(texts.join(_small(left.select("node", "class"), 64), "node"), "left")), "postings")
    tokens = postings.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("starts").alias("begun")).where("low != high and begun").select("token")
    shared = stored(postings.join(tokens, "token"), "shared")
    by_class = shared.groupBy("token", "class").agg(F.count("*").alias("n"), F.count_if("starts").alias("first"))
    groups = by_class.groupBy("token").agg(F.max(F.struct("n", "class", "first")).alias("main"), F.sum("n").alias("n"), F.sum("first").alias("first"))
    parts = lambda x, y: F.ceil(F.greatest(x * y, F.lit(1)) / GROUP_PAIRS).cast("int")
    others, main = parts(F.col("first") - F.col("main.first"), F.col("n")), parts(F.col("main.first"), F.col("n") - F.col("main.n"))
    grouped = stored(shared.join(groups.select("token", F.col("main.class").alias("largest"), others.alias("others"), main.alias("main")), "token"), "grouped")
    found = []
    for of, to, n in (("class != largest", "true", "others"), ("class = largest", "class != largest", "main")):
        x = grouped.where("starts").where(of).select("token", F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("part"), "node", "class", "at", "shingles")
        y = grouped.where(to).select("token", F.pmod(F.xxhash64("node"), F.col(n)).cast("int").alias("part"), F.col("node").alias("node2"), F.col("class").alias("class2"), F.col("at").alias("at2"), F.col("shingles").alias("shingles2"))
        n, m = F.col("shingles"), F.col("shingles2")
        near = (F.least(n, m) >= LEAST * F.greatest(n, m)) & ((F.col("at") + F.col("at2")) * (1 + LEAST) <= (n + m) * (1 - LEAST) + 1e-6)
        found.append(x.join(y, ["token", "part"]).where("class != class2").where(near).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")))
    pairs = found[0].unionAll(found[1]).groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b")
    side = lambda x, n, m: _small(left, 256).select(F.col("node").alias(x), F.col("shingles").alias(n), F.col("map").alias(m))
    both = pairs.join(side("a", "n", "map"), "a").join(side("b", "m", "its_map"), "b")
    return both.where(_may_link(F.col("n"), F.col("m"), F.col("map"), F.col("its_map"))).select("a", "b")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, node (digest of its text), class_id (smallest id of its class), kept, and its links.

    ``kept`` is true for the document that gives its class the name; of rows equal in id and text for all of them. ``n_links`` is the number of
    other texts that were found to be links of this one, ``linked_id`` the smallest id of the most similar of these and ``similarity`` theirs (null
    without links). Links within a class that is known already aren't sought, so there may be more.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = source.select("id", _node(F.col("text")).alias("node"), "text")
    kind = source.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}
        for batch in slices(batches, 2):
            nodes, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = {n: t for n, t in zip(nodes, texts) if n not in seen}
            if len(seen) + len(new) > 20_000:
                seen, new = {}, dict(zip(nodes, texts))
            seen.update((n, (sketches(g), parities(g), len(g))) for n, g in zip(new, map(label, _grams(list(new.values())))))
            own = [seen[n][0].view(np.int64) for n in nodes]
            maps = np.array([seen[n][1] for n in nodes], np.int64).reshape(-1, MAP_LONGS)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*own, np.zeros(0, np.int64)]))), pa.array([seen[n][2] for n in nodes], pa.int64()), pa.StructArray.from_arrays([pa.array(maps[:, k]) for k in range(MAP_LONGS)], [f"m{k}" for k in range(MAP_LONGS)])], names=["id", "node", "sketches", "shingles", "map"])

    a_map = ", ".join(f"m{k}: long" for k in range(MAP_LONGS))
    sketched = stored(hashed.mapInArrow(sketch, f"id {kind}, node binary, sketches array<long>, shingles long, map struct<{a_map}>"), "sketches")
    nodes = sketched.groupBy("node").agg(F.min("id").alias("first"))
    buckets = sketched.groupBy("node").agg(F.first("sketches").alias("sketches"), F.first("shingles").alias("shingles")).select("node", "shingles", F.explode("sketches").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(buckets.join(sizes, "bucket"), "buckets")
    involved = stored(members.groupBy("node").agg(F.sum("size").alias("popular")), "involved")
    one_each = stored(sketched.join(_small(involved, 64), "node").groupBy("node").agg(F.min("id").alias("id"), F.first("popular").alias("popular"), F.first("map").alias("map")), "one-each")
    members = stored(members.join(_small(one_each.select("node", "popular", "map"), 256), "node"), "members")
    first_of = hashed.join(_small(involved.select("node"), 48), "node", "left_semi")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.record_batch([batch.column(0), pa.array([g.tobytes() for g in _grams(batch.column(1).to_pylist())], pa.binary())], names=["node", "grams"])

    own = first_of.join(_small(one_each.select(F.col("node").alias("n"), F.col("id").alias("i")), 64), (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    texts = stored(own.select("node", "text").mapInArrow(grams, "node binary, grams binary").dropDuplicates(["node"]), "grams")

    alike = _may_link(F.col("shingles"), F.col("others"), F.col("map"), F.col("its_map"))
    centre = members.groupBy("bucket").agg(F.max(F.struct("popular", "node", "shingles", "map")).alias("top")).select("bucket", F.col("top.node").alias("centre"), F.col("top.shingles").alias("others"), F.col("top.map").alias("its_map"))
    star = members.join(centre, "bucket").where(F.col("node") != F.col("centre")).where(alike).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    tried = stored(star.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b"), "pairs")
    found, classes = stored(_verified(tried, texts), "links"), involved.select("node", F.col("node").alias("class"))
    links = found
    for turn in range(2):
        classes = _components(classes, found)
        placed = members.join(_small(classes, 64), "node")
        opened = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("bucket")
        placed = stored(placed.join(opened, "bucket").select("bucket", "node", "class", "size", "shingles", "map"), "open")
        small = placed.where(F.col("size") <= SMALL_BUCKET)
        other = small.select("bucket", F.col("node").alias("node2"), F.col("class").alias("class2"), F.col("shingles").alias("others"), F.col("map").alias("its_map"))
        pairs = small.join(other, "bucket").where("node < node2 and class != class2").where(alike).select(F.col("node").alias("a"), F.col("node2").alias("b"))
        large = placed.where(F.col("size") > SMALL_BUCKET)
        drawn = F.pmod(F.xxhash64("node", "bucket", F.lit(turn)), F.col("size")) < DRAWN ** (turn + 1)
        second = large.where(drawn).select("bucket", F.col("node").alias("centre"), F.col("class").alias("its"), F.col("shingles").alias("others"), F.col("map").alias("its_map"))
        more = large.join(second, "bucket").where("class != its").where(alike).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        fresh = stored(pairs.unionAll(more).groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b").join(_small(tried, 64), ["a", "b"], "left_anti"), "pairs")
        found = stored(_verified(fresh, texts), "links")
        links = links.unionAll(found)
        tried = tried.unionAll(fresh)
        if found.isEmpty() and large.where(F.col("size") > DRAWN).isEmpty():
            break
    classes = _components(classes, found)
    huge = members.where(F.col("size") > DRAWN**2)
    if not huge.isEmpty():  # all smaller buckets have been searched whole
        placed = huge.join(_small(classes, 64), "node")
        opened = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("bucket")
        left = stored(placed.join(opened, "bucket").groupBy("node").agg(*(F.first(c).alias(c) for c in ("class", "shingles", "map"))), "left-nodes")
        if not left.isEmpty():
            fresh = stored(_prefix_pairs(left, texts).join(_small(tried, 64), ["a", "b"], "left_anti"), "pairs")
            found = stored(_verified(fresh, texts), "links")
            links = links.unionAll(found)
            classes = _components(classes, found)
    named = nodes.join(classes, "node", "left").select("node", F.coalesce("class", "node").alias("class"), "first")
    names = named.groupBy("class").agg(F.min("first").alias("class_id"), F.min(F.struct(F.col("first").isNull(), "first", "node")).alias("keeper")).select("class", "class_id", F.col("keeper.node").alias("keeper"))
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("end"), "similarity").select("end.node", "end.other", "similarity")
    partners = ends.join(_small(one_each.select(F.col("node").alias("other"), F.col("id").alias("other_id")), 48), "other")
    linked = partners.groupBy("node").agg(F.count("*").alias("n_links"), F.min(F.struct((-F.col("similarity")).alias("far"), "other_id")).alias("best"))
    result = named.join(names, "class").select("node", "class_id", "keeper", "first").join(linked, "node", "left")
    out = sketched.select("id", "node").join(result, "node")
    kept = (F.col("node") == F.col("keeper")) & F.col("id").eqNullSafe(F.col("first"))
    return out.select(F.col("id").alias(id_col), "node", "class_id", kept.alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.other_id").alias("linked_id"), (-F.col("best.far")).alias("similarity"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each class."""
    classes = stored(near_duplicate_classes(docs, id_col, text_col), "classes")
    dropped = stored(classes.where("not kept").select(F.col(id_col).alias("foliant_id"), F.col("node").alias("foliant_node")).distinct(), "dropped")
    kept = docs.join(_small(dropped, 64), docs[id_col].eqNullSafe(F.col("foliant_id")) & (_node(docs[text_col].cast("string")) == F.col("foliant_node")), "left_anti")
    if not classes.where("kept").groupBy(id_col, "node").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept
