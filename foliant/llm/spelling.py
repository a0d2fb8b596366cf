"""Operator 13: words grouped with their spelling variants by tries and Levenshtein automata.

Words are runs of Latin letters with their counts over all texts. The words are sorted and cut into shards, each a
compact trie: single words hang from the node at which they become single, as tails of bytes. Shards are broadcast, and
every word's automaton for distance one walks every shard that may hold an answer, depth first and for a block of words at a
time: a state is a place in the word, a node, and whether the one edit is spent. Accepting states are the neighbours.

An edit near the beginning of a word would open most of the trie. So there are two sets of shards, of words and
of reversed words: a neighbour has the word's first half, and the walk takes that without edits and then looks for one behind it,
or else it has the second half, which is the beginning of the reversed word. A neighbour that has both halves is
taken from the first walk only. Of insertions into and deletions from a run of equal letters only the last place is walked, so
each neighbour is met once.

Scaling: words are counted per task before the one shuffle. Shards hold ``SHARD`` words or ``SHARD_BYTES`` bytes
at most and are both what is broadcast and what the tasks read, so a task's words lie in few tries; broadcasts go in
batches of ``BROADCAST`` bytes, so their size doesn't grow with the vocabulary, and a batch is read by those shards only whose range meets
its own. Only sums and the best neighbour leave a task. Forms are followed by pointer doubling: a form has ten times its word's count,
so 5 joins are enough for any corpus.

Defined cases: a null text has no words, a null id counts as an empty one; words may be of any length; repeated rows count
each; columns besides the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

SHARD, SHARD_BYTES, BROADCAST, BLOCK = 32768, 1 << 20, 32 << 20, 4096
_NOT_LETTERS = r"[^A-Za-z\x{C0}-\x{FF}]+"
_HELD = 400_000


def word_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", slip: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` letters that occur ``least`` times or more.

    A run whose checksum with the document's id is a multiple of ``slip`` loses the letter that the checksum says.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in slices(batches, max_bytes=4 << 20):
            _count(part, slip, shortest, held)
            if len(held) > _HELD:
                yield _counted(held)
                held = Counter()
        yield _counted(held)

    rows = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _count(part: pa.RecordBatch, slip: int, shortest: int, held: Counter) -> None:
    """Add the words of some texts: distinct ones of each text are checked once."""
    runs = pc.split_pattern_regex(part.column(1).fill_null(""), _NOT_LETTERS)
    flat, doc = runs.flatten(), np.repeat(np.arange(part.num_rows), np.diff(np.asarray(runs.offsets)))
    long = pc.greater_equal(pc.utf8_length(flat), shortest)
    each, doc = pc.ascii_lower(flat.filter(long)).dictionary_encode(), doc[long.to_numpy(zero_copy_only=False)]
    words = each.dictionary.to_pylist()
    coded = [w.encode() for w in words]
    begun = [zlib.crc32(f"{'' if x is None else x}:".encode()) for x in part.column(0).to_pylist()]
    pairs, counts = np.unique(doc * max(1, len(words)) + each.indices.to_numpy(), return_counts=True)
    docs, codes = np.divmod(pairs, max(1, len(words)))
    crc = zlib.crc32
    sums = np.fromiter((crc(coded[c], begun[d]) for c, d in zip(codes.tolist(), docs.tolist())), np.int64, len(pairs))
    hit = sums % slip == 0
    whole = np.bincount(codes[~hit], weights=counts[~hit], minlength=len(words)).astype(np.int64)
    for k in np.flatnonzero(whole).tolist():
        held[words[k]] += int(whole[k])
    for c, h, n in zip(codes[hit].tolist(), sums[hit].tolist(), counts[hit].tolist()):
        at = h % len(words[c])
        word = words[c][:at] + words[c][at + 1 :]
        if len(word) >= shortest:
            held[word] += n


class Trie:
    """A compact trie of sorted distinct words (Latin-1 bytes): nodes in breadth-first order, node 0 the root.

    A node is a range of words and the letter that leads to it (0: the word ends). Ranges of one word have no children.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.data, self.start = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(self.length) - self.length
        low, high = np.zeros(1, np.int64), np.array([len(words)], np.int64)
        parts, depth, made = [(low, high, np.zeros(1, np.uint8), np.zeros(1, np.int64), np.full(1, -1))], 0, 1
        node = np.zeros(1, np.int64)
        while True:
            more = high - low > 1
            low, high, node = low[more], high[more], node[more]
            if not len(low):
                break
            size = high - low
            owner = np.repeat(np.arange(len(low)), size)
            word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[owner]
            letter = np.where(self.length[word] > depth, self.data[np.minimum(self.start[word] + depth, len(self.data) - 1)], 0)
            cut = np.flatnonzero((np.diff(owner, prepend=-1) > 0) | (np.diff(letter.astype(np.int64), prepend=-1) != 0))
            parent, low = node[owner[cut]], word[cut]
            high = np.append(word[cut[1:] - 1], word[-1]) + 1
            depth += 1
            parts.append((low, high, letter[cut].astype(np.uint8), np.full(len(cut), depth), parent))
            node = np.arange(made, made + len(cut))
            made += len(cut)
        self.low, high, self.letter, self.depth, parent = (np.concatenate(x) for x in zip(*parts))
        self.single = high - self.low == 1
        self.keys = parent[1:] * 256 + self.letter[1:]  # ascending: breadth first, and letters ascend
        self.first = np.searchsorted(parent, np.arange(made + 1))

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node that a letter leads to, or -1."""
        key = node * 256 + letter
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, at + 1, -1) if len(self.keys) else np.full(len(node), -1)

    def near(self, words: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, place in the trie) of words one edit apart that share the first ``exact`` letters."""
        length = np.array([len(w) for w in words], np.int64)
        data, start = np.frombuffer(b"".join(words) + b"\0\0", np.uint8), np.cumsum(length) - length
        letter_at = lambda w, i: np.where(i < length[w], data[np.minimum(start[w] + i, len(data) - 1)], 0).astype(np.int64)
        w, node, at = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ready = []
        while len(w):  # down the first half, without edits
            done = (at == exact[w]) | self.single[node]
            ready.append((w[done], node[done], at[done]))
            w, node, at = w[~done], node[~done], at[~done]
            node = self.child(node, letter_at(w, at))
            found = node >= 0
            w, node, at = w[found], node[found], at[found] + 1
        w, node, at = (np.concatenate(x) for x in zip(*ready)) if ready else (np.zeros(0, np.int64),) * 3
        out, stack = [], [(w, node, at, np.zeros(len(w), bool))]
        while stack:  # depth first
            w, node, at, spent = stack.pop()
            tail = self.single[node]
            out.append(self._tails(words, length, data, start, w[tail], node[tail], at[tail], spent[tail], exact))
            w, node, at, spent = w[~tail], node[~tail], at[~tail], spent[~tail]
            if not len(w):
                continue
            letter = letter_at(w, at)
            drop = np.flatnonzero(~spent & (letter > 0) & (letter != letter_at(w, at + 1)))
            stack.append((w[drop], node[drop], at[drop] + 1, np.ones(len(drop), bool)))
            width = self.first[node + 1] - self.first[node]
            k = np.repeat(np.arange(len(w)), width)
            child = np.arange(len(k)) - np.repeat(np.cumsum(width) - width, width) + self.first[node][k]
            found = self.letter[child].astype(np.int64)
            same, word = found == letter[k], found > 0
            ends = same & ~word & spent[k]
            out.append((w[k[ends]], self.low[child[ends]]))
            edit = ~same & word & ~spent[k]
            for chosen, step, used in ((same & word, 1, None), (edit & (letter[k] > 0), 1, True), (edit, 0, True)):
                j = np.flatnonzero(chosen)
                stack.append((w[k[j]], child[j], at[k[j]] + step, spent[k[j]] if used is None else np.ones(len(j), bool)))
            stack = [s for s in stack if len(s[0])]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2

    def _tails(self, words: list[bytes], length: np.ndarray, data: np.ndarray, start: np.ndarray, w: np.ndarray, node: np.ndarray, at: np.ndarray, spent: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States that have come to a single word: what is left of both is compared at once."""
        v = self.low[node]
        deep = np.where(self.letter[node] > 0, self.depth[node], self.length[v])
        mine, theirs = length[w] - at, self.length[v] - deep
        close = np.where(spent, mine == theirs, np.abs(mine - theirs) <= 1)
        last = data[start[w] + length[w] - 1] == self.data[self.start[v] + self.length[v] - 1]
        close &= ~spent | (mine == 0) | last
        j = np.flatnonzero(close)
        kept = []
        for k, a, b, i, d, used, e in zip(j.tolist(), w[j].tolist(), v[j].tolist(), at[j].tolist(), deep[j].tolist(), spent[j].tolist(), exact[w[j]].tolist()):
            x, y = words[a], self.words[b]
            if x[i:] == y[d:] if used else x[:e] == y[:e] and one_edit(x[i:], y[d:]):
                kept.append(k)
        return w[kept], v[kept]


def one_edit(x: bytes, y: bytes) -> bool:
    """Whether exactly one insertion, deletion or replacement makes ``y`` of ``x``."""
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    low, high, n = 0, min(len(x), len(y)), min(len(x), len(y))
    if x[:n] != y[:n]:
        while high - low > 1:  # the first difference lies in [low, high)
            middle = (low + high) // 2
            low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle)
        n = low
    return x[n + (len(x) >= len(y)) :] == y[n + (len(y) >= len(x)) :]


_SHARDS = "first string, last string, words binary, counts binary"


def shards(words: DataFrame, backwards: bool, n: int, name: str) -> DataFrame:
    """Sorted words in shards of bounded size: their range, the words as lines, and their counts."""
    key = F.reverse("word") if backwards else F.col("word")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (len(held) >= SHARD or size + len(word) > SHARD_BYTES):
                    yield _shard(held, counts)
                    held, counts, size = [], [], 0
                held.append(word)
                counts.append(count)
                size += len(word) + 1
        if held:
            yield _shard(held, counts)

    ordered = words.select(key.alias("word"), "n").repartitionByRange(max(1, -(-n // SHARD)), "word").sortWithinPartitions("word")
    return stored(ordered.mapInArrow(pack, _SHARDS), name)


def _shard(words: list[str], counts: list[int]) -> pa.RecordBatch:
    cells = [words[0], words[-1], "\n".join(words).encode("latin-1"), np.array(counts, "<i8").tobytes()]
    return pa.record_batch([pa.array([c], t) for c, t in zip(cells, (pa.string(), pa.string(), pa.binary(), pa.binary()))], names=["first", "last", "words", "counts"])


_tries: OrderedDict[tuple, tuple[Trie, np.ndarray]] = OrderedDict()


def _trie(key: tuple, words: bytes, counts: bytes) -> tuple[Trie, np.ndarray]:
    """A shard's trie, of which a worker keeps the last few."""
    if key not in _tries:
        _tries[key] = Trie(words.split(b"\n")), np.frombuffer(counts, "<i8")
        while len(_tries) > 4:
            _tries.popitem(last=False)
    _tries.move_to_end(key)
    return _tries[key]


def neighbours(table: DataFrame, backwards: bool) -> DataFrame:
    """(word, n_near, best_n, best) of the words of all shards that have near words, by the walk of one direction."""
    spark = table.sparkSession
    listed = table.select("first", "last", (F.length("words") + F.length("counts")).alias("size")).orderBy("first").collect()  # a row per shard
    out, k = None, 0
    while k < len(listed):
        end, size = k, 0
        while end < len(listed) and (end == k or size + listed[end]["size"] <= BROADCAST):
            size += listed[end]["size"]
            end += 1
        low, high = listed[k]["first"], listed[end - 1]["last"]
        batch = table.where(F.col("first").between(low, listed[end - 1]["first"])).orderBy("first").toArrow()  # BROADCAST bytes at most
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r.values()) for r in batch.to_pylist()]))
        meets = (F.substring("first", 1, 3) <= high[:3]) & (F.substring("last", 1, 3) >= low[:3])  # halves have 3 letters at least
        found = table.where(meets).repartition(len(listed)).mapInArrow(_walk(shared, backwards), "word string, n_near long, best_n long, best string")
        out, k = found if out is None else out.unionAll(found), end
    return out if out is not None else spark.createDataFrame([], "word string, n_near long, best_n long, best string")


def _walk(shared, backwards: bool):
    turned = (lambda w: w[::-1]) if backwards else (lambda w: w)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in batch.column(batch.schema.get_field_index("words")):
                words = lines.as_py().split(b"\n")
                for k in range(0, len(words), BLOCK):
                    yield _best(words[k : k + BLOCK], shared, backwards, turned)

    return walk


def _best(words: list[bytes], shared, backwards: bool, turned) -> pa.RecordBatch:
    length = np.array([len(w) for w in words])
    half = length // 2
    exact = length - half if backwards else half
    begins = np.array([w[: min(e, 16)] for w, e in zip(words, exact.tolist())], "S16")
    n_near, best = np.zeros(len(words), np.int64), [(0, b"")] * len(words)
    name, listed = shared.value
    for number, (first, last, lines, counts) in enumerate(listed):
        first, last = first.encode("latin-1"), last.encode("latin-1")
        cut = np.array([first[: min(e, 16)] for e in range(17)], "S16")[np.minimum(exact, 16)]
        chosen = np.flatnonzero((begins <= np.array(last[:16], "S16")) & (cut <= begins))
        if not len(chosen):
            continue
        trie, n = _trie((name, number), lines, counts)
        w, v = trie.near([words[c] for c in chosen], exact[chosen])
        for a, b in zip(chosen[w].tolist(), v.tolist()):
            word = trie.words[b]
            if backwards and turned(word)[: half[a]] == turned(words[a])[: half[a]]:
                continue  # the other walk has it
            n_near[a] += 1
            c = int(n[b])
            if c > best[a][0] or c == best[a][0] and turned(word) < best[a][1]:
                best[a] = (c, turned(word))
    hit = np.flatnonzero(n_near)
    text = lambda b: b.decode("latin-1")
    return pa.record_batch([pa.array([text(turned(words[k])) for k in hit], pa.string()), pa.array(n_near[hit]), pa.array([best[k][0] for k in hit], pa.int64()), pa.array([text(best[k][1]) for k in hit], pa.string())], names=["word", "n_near", "best_n", "best"])


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, n) of distinct words of at least 6 letters to (word, n, n_near, form, form_n, root)."""
    n = words.count()
    found = [neighbours(shards(words, back, n, f"spelling-{'back' if back else 'on'}"), back) for back in (False, True)]
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:long,best:string>").alias("best"))
    near = found[0].unionAll(found[1]).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("best"))
    each = none.unionAll(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    often = -F.col("best.less") >= F.col("n") * factor
    formed = stored(each.select("word", "n", "n_near", F.when(often, F.col("best.best")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return formed.join(_roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form."""
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if roots.join(ahead, "root", "left_semi").isEmpty():
            break
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return roots


def spelling_variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of a table of texts."""
    return variants(stored(word_counts(documents), "spelling-words")).select("word", "form", "root", "n", "n_near", "form_n")
