"""Re-Pair grammars over token ids: NumPy kernels that compress, expand and address one shard of documents."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIQQI")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _frequent_pairs(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur ``least`` times or more, sorted, and how often each does."""
    slot = ((keys * _MIX) >> np.uint64(44)).astype(np.int32)
    kept = keys[(np.bincount(slot, minlength=1 << 20) >= least)[slot]]
    kept.sort()
    starts = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1]))) if len(kept) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(kept)))
    good = counts >= least
    return kept[starts[good]], counts[good]


def _places(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The index of each key among ``pairs`` (sorted), or -1."""
    slot = lambda x: (x * _MIX) >> np.uint64(45)
    table = np.full(1 << 19, -1, np.int32)
    table[slot(pairs)] = np.arange(len(pairs), dtype=np.int32)
    which = table[slot(keys)]
    wrong = np.flatnonzero((which >= 0) & (pairs[which] != keys))  # another pair has the slot
    found = np.minimum(np.searchsorted(pairs, keys[wrong]), len(pairs) - 1)
    which[wrong] = np.where(pairs[found] == keys[wrong], found, -1)
    return which


def _chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which occurrences (positions in order, a rank of the pair at each) are replaced: of two that overlap the one of lower rank.

    Of occurrences of one pair that overlap each other, every other one from the left.
    """
    near = np.diff(at) == 1
    best = np.ones(len(at), bool)
    best[1:] &= ~(near & (rank[1:] > rank[:-1]))
    best[:-1] &= ~(near & (rank[:-1] > rank[1:]))
    same = np.flatnonzero(near & best[1:] & best[:-1])  # with the next one
    if len(same):
        run = np.maximum.accumulate(np.where(np.diff(same, prepend=-2) != 1, same, 0))
        best[same[(same - run) % 2 == 0] + 1] = False
    return best


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, least: int = 6, gain: float = 0.001, rounds: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent id pairs by new symbols, the most frequent ones first, until that pays no more.

    ``ends`` has the exclusive end of each document in ``ids``; no rule spans two documents. A round counts pairs and
    replaces all that occur ``least`` times or more, the more frequent ones before those that they overlap. After it only
    pairs next to a new symbol, and those left over, can be frequent: the next one looks at these alone. It ends
    with a round that shortens the sequence by a share under ``gain`` (``rounds`` is a bound that is not met). Returns the rules
    (left, right; rule r makes symbol vocabulary + r), the remaining sequence, and the ends in that sequence.
    """
    seq, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    last = np.zeros(len(seq), dtype=bool)
    last[ends[ends > 0] - 1] = True
    active, n_rules = np.flatnonzero(~last[:-1]), 0
    for _ in range(rounds):
        keys = seq[active].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= seq[active + 1]
        pairs, counts = _frequent_pairs(keys, least)
        if not len(pairs):
            break
        which = _places(keys, pairs)
        at, which = active[which >= 0], which[which >= 0]
        rank = np.empty(len(pairs), np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(pairs), dtype=np.int32)
        taken = _chosen(at, rank[which])
        paying = np.bincount(which[taken], minlength=len(pairs)) >= least // 2 + 1  # a rule costs two ids, and each use saves one
        taken &= paying[which]
        new, new_which = at[taken], which[taken]
        if len(new) < gain * len(seq) or not len(new):
            break
        seq[new] = (vocabulary + n_rules + np.cumsum(paying) - 1).astype(np.uint32)[new_which]
        rules.append(np.stack((pairs[paying] >> np.uint64(32), pairs[paying] & np.uint64(0xFFFFFFFF)), 1).astype(np.uint32))
        n_rules += int(paying.sum())
        last[new] = last[new + 1]
        open_pair = np.zeros(len(seq), bool)
        open_pair[at] = True
        open_pair[new] = True
        open_pair[new[new > 0] - 1] = True
        behind = new[new > 1] - 2  # where the symbol before was the second of a pair that went too
        open_pair[behind] = True
        stay = np.ones(len(seq), dtype=bool)
        stay[new + 1] = False
        seq, last, open_pair = seq[stay], last[stay], open_pair[stay]
        active = np.flatnonzero(open_pair[:-1] & ~last[:-1])
    closed = np.flatnonzero(last) + 1
    new_ends = np.zeros(len(ends), dtype=np.int64)
    filled = np.diff(np.concatenate(([0], ends))) > 0
    new_ends[filled] = closed
    return np.concatenate(rules), seq, np.maximum.accumulate(new_ends) if len(new_ends) else new_ends


def lengths_of(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Number of ids that each rule expands to; a rule refers to earlier ones only."""
    out = np.ones(len(rules), dtype=np.int64)
    if not len(rules):
        return out
    inner = rules.astype(np.int64) - vocabulary
    terminal, inner = inner < 0, np.maximum(inner, 0)
    while True:  # as often as rules are nested
        longer = np.where(terminal, 1, out[inner]).sum(axis=1)
        if np.array_equal(longer, out):
            return out
        out = longer


def expand(seq: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids behind a sequence of symbols."""
    seq = seq.astype(np.uint32)
    while len(seq):
        nonterminal = seq >= vocabulary
        if not nonterminal.any():
            break
        at = np.arange(len(seq)) + np.concatenate(([0], np.cumsum(nonterminal)[:-1]))
        out = np.empty(len(seq) + int(nonterminal.sum()), dtype=np.uint32)
        out[at] = seq
        pair = rules[seq[nonterminal] - vocabulary]
        out[at[nonterminal]], out[at[nonterminal] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def _narrow(x: np.ndarray, width: int) -> bytes:
    """Symbols in ``width`` bytes each."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def _wide(raw: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 4), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return out.view("<u4").reshape(n)


def _width(symbols: int) -> int:
    """Bytes that symbols under ``symbols`` need."""
    return max(1, ((symbols - 1).bit_length() + 7) // 8)


def pack(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> bytes:
    """One shard: header, rules, expansion lengths, each document's end in ids and in symbols, and the symbols."""
    rules, seq, seq_ends = compress(ids, ends, vocabulary)
    width = _width(vocabulary + len(rules))
    head = _HEAD.pack(_MAGIC, vocabulary, len(rules), len(seq), len(ids), len(ends))
    return b"".join((head, _narrow(rules.reshape(-1), width), lengths_of(rules, vocabulary).astype("<u4").tobytes(), np.asarray(ends, "<i8").tobytes(), seq_ends.astype("<i8").tobytes(), _narrow(seq, width)))


class Shard:
    """Random access to a packed shard."""

    def __init__(self, blob: bytes):
        magic, self.vocabulary, n_rules, n_seq, self.n_ids, n_docs = _HEAD.unpack_from(blob)
        if magic != _MAGIC:
            raise ValueError("not a Re-Pair shard")
        view, at = memoryview(blob), _HEAD.size
        width = _width(self.vocabulary + n_rules)
        self.rules, at = _wide(view[at:], 2 * n_rules, width).reshape(-1, 2), at + 2 * width * n_rules
        self.lengths, at = np.frombuffer(view, "<u4", n_rules, at).astype(np.int64), at + 4 * n_rules
        self.ends, at = np.frombuffer(view, "<i8", n_docs, at), at + 8 * n_docs
        self.seq_ends, at = np.frombuffer(view, "<i8", n_docs, at), at + 8 * n_docs
        self.seq = _wide(view[at:], n_seq, width)

    def all_ids(self) -> np.ndarray:
        """The ids of all documents, every symbol copied from its expansion."""
        terminals = np.arange(self.vocabulary, dtype=np.uint32)
        rules = expand(np.arange(self.vocabulary, self.vocabulary + len(self.rules)), self.rules, self.vocabulary)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate((np.ones(self.vocabulary, np.int64), self.lengths))))).astype(np.int64) * 4
        known = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(terminals.tobytes() + rules.tobytes())])
        data = known.take(pa.array(self.seq)).buffers()[2]
        return np.frombuffer(data, np.uint32, self.n_ids) if self.n_ids else np.zeros(0, np.uint32)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard's document ``k``; only the symbols they lie in are expanded."""
        a, b = int(self.seq_ends[k - 1]) if k else 0, int(self.seq_ends[k])
        symbols = self.seq[a:b].astype(np.int64)
        sizes = np.ones(len(symbols), dtype=np.int64)
        nonterminal = symbols >= self.vocabulary
        sizes[nonterminal] = self.lengths[symbols[nonterminal] - self.vocabulary]
        upto = np.cumsum(sizes)
        n = int(upto[-1]) if len(upto) else 0
        start, stop = min(start, n), n if stop is None else min(stop, n)
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        i, j = int(np.searchsorted(upto, start, "right")), int(np.searchsorted(upto, stop, "left")) + 1
        before = int(upto[i - 1]) if i else 0
        return expand(symbols[i:j], self.rules, self.vocabulary)[start - before : stop - before]
