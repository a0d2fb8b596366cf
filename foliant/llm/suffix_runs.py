"""Sorted, front-coded runs of suffixes, their merge by a loser tree that knows common prefixes, and what it shows.

A *window* is one of a text's strings of ``length`` bytes. Each has an anchor: among its ``GRAM``-byte strings the one with
the smallest hash, the leftmost of equal ones. So equal windows have their anchors at the same place, and windows
with one anchor follow each other. An *entry* is an anchor with all its windows: the suffix that begins at the
anchor as far as the last window reaches, a mark that no UTF-8 text has, and the bytes before the anchor, backwards,
as far as the first window reaches. Sorted entries with equal anchors stand together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import zstandard

from .shingles import mix, window_hashes

GRAM = 40
PIECE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
Entry = tuple[bytes, int, list[tuple[bytes, int]]]  # string, bytes before the anchor, (text, start of the first window)


def pieces(text: bytes, length: int) -> list[tuple[int, bytes]]:
    """A text in parts of bounded size that share no window and leave none out."""
    if len(text) <= PIECE + length:
        return [(0, text)]
    return [(a, text[a : a + PIECE + length - 1]) for a in range(0, len(text) - length + 1, PIECE)]


def groups(parts: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """The parts (text, offset, bytes), in order, in groups that ``anchors`` has places for."""
    own, size = [], 0
    for part in parts:
        if own and size + len(part[2]) > int(_PLACE) + 1:
            yield own
            own, size = [], 0
        own.append(part)
        size += len(part[2])
    if own:
        yield own


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every anchor, in order: its text, place, first and last window, and the hash of its gram."""
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) > int(_PLACE) + 1:
        raise ValueError("more bytes than places")
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    value = mix(window_hashes(data, GRAM))
    least = (value & ~_PLACE) | np.arange(len(value), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    first = np.concatenate(([0], ends[:-1]))
    sizes = np.maximum(0, ends - first - length + 1)
    at = np.repeat(first, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if not len(at):
        return none, none, none, none, none.astype(np.uint64)
    place = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    low, high, place = at[new], at[np.append(new[1:], len(at)) - 1], place[new]
    owner = np.searchsorted(ends, low, "right")
    return owner, place - first[owner], low - first[owner], high - first[owner], value[place]


def entry(text: bytes, place: int, low: int, high: int, length: int) -> bytes:
    return text[place : high + length] + b"\xff" + text[low:place][::-1]


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that are known to share ``known`` bytes."""
    n, step = min(len(a), len(b)), 8
    while known < n:
        if a[known : known + step] == b[known : known + step]:
            known, step = known + step, 2 * step
        elif step == 1:
            return known
        else:
            step //= 2
            if a[known : known + step] == b[known : known + step]:
                known += step
            step = max(1, step // 2)
    return n


def collapse(rows: list[tuple[bytes, int, bytes, int]]) -> list[Entry]:
    """Sorted distinct entries of (string, bytes before the anchor, text, start)."""
    rows.sort()
    out: list[Entry] = []
    for string, before, text, start in rows:
        if out and out[-1][0] == string:
            out[-1][2].append((text, start))
        else:
            out.append((string, before, [(text, start)]))
    return out


def encode_run(entries: list[Entry]) -> bytes:
    """A sorted run, front-coded: shared prefix lengths with the entry before, and the rest of each string."""
    shared = np.zeros(len(entries), np.uint16)
    rests, last = [], b""
    for k, (string, _, _) in enumerate(entries):
        shared[k] = _common(last, string, 0)
        rests.append(string[shared[k] :])
        last = string
    members = [m for _, _, ms in entries for m in ms]
    parts = [shared.tobytes(), np.array([len(r) for r in rests], "<u2").tobytes(), np.array([b for _, b, _ in entries], "<u2").tobytes(), np.array([len(ms) for _, _, ms in entries], "<u4").tobytes(), b"".join(t for t, _ in members), np.array([s for _, s in members], "<i8").tobytes(), b"".join(rests)]
    head = np.array([len(entries), len(members), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def decode_run(blob: bytes) -> Iterator[tuple[int, Entry]]:
    """Entries of a run with the length of the prefix that each shares with the one before."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, *sizes = np.frombuffer(raw, "<i8", 9).tolist()
    at, parts = 72, []
    for size in sizes:
        parts.append(raw[at : at + size])
        at += size
    shared, lengths, before, counts = (np.frombuffer(parts[k], kind).tolist() for k, kind in enumerate(("<u2", "<u2", "<u2", "<u4")))
    texts, starts, rests = parts[4], np.frombuffer(parts[5], "<i8").tolist(), parts[6]
    string, rest, member = b"", 0, 0
    for k in range(n):
        string = string[: shared[k]] + rests[rest : rest + lengths[k]]
        rest += lengths[k]
        own = [(texts[16 * j : 16 * j + 16], starts[j]) for j in range(member, member + counts[k])]
        member += counts[k]
        yield shared[k], (string, before[k], own)


def merge(runs: list[Iterator[tuple[int, Entry]]]) -> Iterator[tuple[int, Entry]]:
    """All runs as one: entries in order, equal ones joined, with the prefix each shares with the one before.

    A loser tree. Every contender knows how many bytes it shares with the last winner. Of two, the one that
    shares more is smaller, and what the loser shares with it is known; only when they share equally many are
    bytes compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[Entry | None] = [None] * size
    shares = [0] * size
    for k, run in enumerate(runs):
        heads[k] = next((e for _, e in run), None)
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes what it has in common with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        common = _common(x[0], y[0], shares[a])
        if x[0][common:] <= y[0][common:]:
            shares[b] = common
            return a, b
        shares[a] = common
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    held: Entry | None = None
    held_share = 0
    while (now := heads[winner]) is not None:
        share = shares[winner]
        if held is not None and share == len(held[0]) == len(now[0]):
            held[2].extend(now[2])
        else:
            if held is not None:
                yield held_share, held
            held, held_share = (now[0], now[1], list(now[2])), share
        following = next(runs[winner], None)
        shares[winner], heads[winner] = following if following is not None else (0, None)
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    if held is not None:
        yield held_share, held


def repeated(group: list[list[Entry]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """(text, start, end) of stretches whose windows all occur again, from groups of entries with equal anchors."""
    entries = [(g, e) for g, es in enumerate(group) for e in es if len(es) > 1]
    for es in group:
        if len(es) == 1 and len(es[0][2]) > 1:
            size = len(es[0][0]) - 1
            yield from ((text, start, start + size) for text, start in es[0][2])
    if not entries:
        return
    wholes = [s[len(s) - b :][::-1] + s[: len(s) - 1 - b] for _, (s, b, _) in entries]
    data = np.frombuffer(b"".join(wholes), np.uint8)
    sizes = np.array([len(w) for w in wholes], np.int64)
    counts, firsts = sizes - length + 1, np.cumsum(sizes) - sizes
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(firsts, counts) + inside
    of_group = mix(np.array([g for g, _ in entries], np.uint64) + np.uint64(1))
    value = mix(window_hashes(data, length)[at]) ^ np.repeat(of_group, counts)
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    again = np.zeros(len(value), bool)
    again[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    _prove(again, same, order, at, data, length)
    for k, (a, n) in enumerate(zip((np.cumsum(counts) - counts).tolist(), counts.tolist())):
        members = entries[k][1][2]
        runs = [(0, n)] if len(members) > 1 else _runs(again[a : a + n])
        for text, start in members:
            yield from ((text, start + x, start + y - 1 + length) for x, y in runs)


def _prove(again: np.ndarray, same: np.ndarray, order: np.ndarray, at: np.ndarray, data: np.ndarray, length: int) -> None:
    """Compare the bytes of windows with equal hashes; where some differ, ``again`` is set by bytes alone."""
    pairs, reach = np.flatnonzero(same), np.arange(length)
    for k in range(0, len(pairs), 20_000):
        part = pairs[k : k + 20_000]
        equal = np.ones(len(part), bool)
        x, y = at[order[part]], at[order[part + 1]]
        for a in range(0, length, 50):  # most windows that differ do so early; the rest is compared in steps
            step = reach[a : a + 50]
            equal &= (data[x[:, None] + step] == data[y[:, None] + step]).all(axis=1)
        for bad in part[~equal].tolist():
            low = high = bad
            while low and same[low - 1]:
                low -= 1
            while high < len(same) and same[high]:
                high += 1
            members = order[low : high + 1].tolist()
            strings = [data[at[m] : at[m] + length].tobytes() for m in members]
            often = Counter(strings)
            again[members] = [often[x] > 1 for x in strings]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def part_of(string: bytes, splitters: list[bytes]) -> int:
    """The range that an entry belongs to; entries with equal anchors have the same."""
    return bisect_right(splitters, string[:GRAM])
