"""NumPy kernels on bytes, words and word shingles of many texts at once, in memory bounded by pieces of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.multiply.accumulate(np.full(1 << 16, _MIX))
PIECE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no order or pattern in them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts as (bytes, end of each text in them, number of each text), about ``most`` bytes in each.

    A longer text comes in parts that end at white space (or where the word ends that passes the limit). A line feed stands
    behind every text or part.
    """
    own, numbers, size = [], [], 0

    def group() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"\n".join(own) + b"\n", np.uint8), np.cumsum([len(t) + 1 for t in own], dtype=np.int64), np.array(numbers, np.int64)

    for k, text in enumerate(texts):
        start = 0
        while True:
            stop = len(text)
            if stop - start > most:
                stop = start + most
                stop = next((at + 1 for at in range(stop - 1, max(start, stop - 4096), -1) if text[at] in b" \n\t\r\v\f"), stop)
                if text[stop - 1] not in b" \n\t\r\v\f":
                    ends = [x for x in (text.find(c, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if x >= 0]
                    stop = min(ends, default=len(text) - 1) + 1
            if own and size + stop - start > most:
                yield group()
                own, numbers, size = [], [], 0
            own.append(text[start:stop])
            numbers.append(k)
            size += stop - start
            start = stop
            if start >= len(text):
                break
    if own:
        yield group()


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and the place after the last of each run of true values."""
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, inside: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of bytes between ``first`` and ``last``, which ``inside`` marks."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    start = np.cumsum(size) - size
    value = data[inside].astype(np.uint64)
    value += np.uint64(1)
    place = np.arange(len(value), dtype=np.int64)
    place -= np.repeat(start, size)
    place &= len(_FACTORS) - 1
    value *= _FACTORS[place]
    return mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _MIX)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit polynomial hashes of all strings of ``length`` bytes."""
    block, size, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        factor = np.uint64(pow(int(_MIX), size, 1 << 64))
        if length & size:
            n = max(0, len(data) - size - done + 1)
            out = block if out is None else out[:n] * factor + block[done : done + n]
            done += size
        if done == length:
            return out
        n = max(0, len(data) - 2 * size + 1)
        block = block[:n] * factor + block[size : size + n]
        size *= 2


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words (runs of bytes but ASCII white space) of each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for data, ends, numbers in pieces(texts):
        solid = (data != 32) & ((data < 9) | (data > 13))
        first, last = spans(solid)
        value = span_hashes(data, solid, first, last)
        upto = np.searchsorted(first, ends, "left").tolist()
        for k, a, b in zip(numbers.tolist(), [0, *upto[:-1]], upto):
            out[k].append(value[a:b])
    return [x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, np.uint64)]) for x in out]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in text order; a shorter text that has words is one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        out = (out + words[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each value has occurred before."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    start = np.maximum.accumulate(np.where(np.concatenate(([True], s[1:] != s[:-1])), np.arange(len(s)), 0))
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(s)) - start
    return out


def common_in_order(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose pairs lie within ``band`` of the diagonal, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, width = full, (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b):
        found = where.get(x)
        if found is None:
            continue
        window = width << (j - band) if j >= band else width >> (band - j)
        hit = row & found & window
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def in_order_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shingles that two texts share in order, over those of both together; 0 where it can't reach ``least``.

    Texts that alike differ in few places, so no pair of an alignment that reaches ``least`` is further from the
    diagonal than the number of shingles it leaves out; that is the band.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    short = min(n, m)
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    tail = 0
    if short:
        same = a[::-1][:short] == b[::-1][:short]
        tail = short if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    both = np.intersect1d(a, b)
    possible = head + tail + min(int(np.isin(a, both).sum()), int(np.isin(b, both).sum()))
    if possible < least * (n + m - possible):
        return 0.0
    common = head + tail + (common_in_order(a.tolist(), b.tolist(), band) if len(both) else 0)
    return common / (n + m - common)
