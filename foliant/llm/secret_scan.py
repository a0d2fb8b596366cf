"""Operator 11: secrets in texts, by patterns and by the entropy of sliding windows.

Base patterns (``BASE``) find keys in assignments, access key ids and long hexadecimal strings. Besides, every maximal
run of a character class (``CLASSES``) that is as long as the class's window is a candidate string: the Shannon entropy
of each window over it follows from its neighbour's by the counts of the one sign that leaves and the one that comes. A
window counts if its entropy reaches the class's threshold and it holds enough signs of each kind (digits, lower case,
upper case); overlapping ones join to a span of kind ``entropy``. Spans that touch one of a base pattern are
reported once, as that; those that the allow-list knows (what stands before a span, such as a digest's name, or
inside it, such as an alphabet or a placeholder) are suppressed. The allow-list never removes base spans.

Entropies are sums of ``c log2 c`` over the counts in a window, as integers of 2**-20 bits, so that every order of
adding gives the same answer.

Scaling: one pass over the texts in Python, in slices of bounded bytes, no shuffle. Arrow's automaton passes over texts
that have nothing to look at.

Defined cases: a null or empty text has no spans; each row gives one row, whatever its id, so repeated rows repeat; texts
are read whole; letters of keywords are ASCII in either case; places are code points; columns besides the id and
the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The base patterns in the order in which their kinds are listed; the part and the length that a match needs.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", re.A, 0, 16),
    ("hex", r"[0-9a-f]{32,}", re.A, 0, 32),
)
_PATTERNS = [(kind, re.compile(pattern, flags), part, least) for kind, pattern, flags, part, least in BASE]
_LOOK = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}"
UNIT = 1 << 20
SPANS = "array<struct<kind:string,start:int,end:int,bits:double>>"


@dataclass(frozen=True)
class CharClass:
    """Signs of candidate strings, the window in signs, its least entropy in bits, and how many digits, lower-case and upper-case letters it needs."""

    signs: str
    window: int
    bits: float
    digits: int = 0
    lower: int = 0
    upper: int = 0

    @property
    def most(self) -> int:
        """The largest sum of ``c log2 c`` of a window that reaches the threshold."""
        return int(np.floor((np.log2(self.window) - self.bits) * self.window * UNIT))


CLASSES = (
    CharClass("A-Za-z0-9+/_=-", 24, 4.0, digits=2, lower=3, upper=3),
    CharClass("a-z0-9", 24, 3.5, digits=5, lower=4),
    CharClass("0-9A-F", 24, 3.0, digits=4, upper=4),
)
#: What may stand right before a harmless span, and what inside one.
ALLOWED_BEFORE = r"(?:sha(?:1|224|256|384|512)|md5|integrity)[\x20:=\"'-]{1,4}$|;base64,$"
ALLOWED_INSIDE = r"(?i)abcdefgh|01234567|qwerty|example|placeholder|xxxxxx|redacted|changeme"


def terms(window: int) -> np.ndarray:
    """``c log2 c`` for counts up to a window, in units."""
    c = np.arange(window + 2, dtype=np.float64)
    return np.round(c * np.log2(np.maximum(c, 1)) * UNIT).astype(np.int64)


def window_sums(signs: np.ndarray, window: int) -> np.ndarray:
    """The sum of ``c log2 c`` over the counts in every window of ``signs`` (bytes), each from the one before.

    How often the sign that leaves and the sign that comes stand in a window is told by their places: those of one
    sign are neighbours in the sorted list of (sign, place).
    """
    n = len(signs)
    if n < window:
        return np.zeros(0, np.int64)
    term, place, sign = terms(window), np.arange(n - window, dtype=np.int64), signs.astype(np.int64) * (n + 1)
    at = np.argsort(signs, kind="stable")
    keys = sign[at] + at
    rank = np.empty(n, np.int64)
    rank[at] = np.arange(n)  # of each place in the sorted list
    gone = np.searchsorted(keys, sign[: n - window] + place + window) - rank[: n - window]  # with the one that leaves
    come = rank[window:] - np.searchsorted(keys, sign[window:] + place + 1)  # without the one that comes
    step = term[gone - 1] - term[gone] + term[come + 1] - term[come]
    first = int(term[np.bincount(signs[:window], minlength=256)].sum())
    return np.concatenate(([first], first + np.cumsum(step)))


def _windows(strings: list[str], cls: CharClass) -> tuple[np.ndarray, np.ndarray]:
    """Which windows over the strings, one after the other, count, and all sums; windows across two strings don't."""
    signs, lengths = np.frombuffer("".join(strings).encode("ascii"), np.uint8), np.array([len(s) for s in strings])
    sums = window_sums(signs, cls.window)
    rest = np.repeat(np.cumsum(lengths), lengths)[: len(sums)] - np.arange(len(sums))  # signs left in each one's string
    good = (rest >= cls.window) & (sums <= cls.most)
    for low, high, least in ((48, 57, cls.digits), (97, 122, cls.lower), (65, 90, cls.upper)):
        if least:
            upto = np.concatenate(([0], np.cumsum((signs >= low) & (signs <= high))))
            good &= upto[cls.window :] - upto[: len(sums)] >= least
    return good, sums


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by start and kind."""
    found = [(m.start(), k, m.end()) for k, (_, pattern, part, least) in enumerate(_PATTERNS) for m in pattern.finditer(text) if m.end(part) - m.start(part) >= least]
    return [(BASE[k][0], start, end) for start, k, end in sorted(found)]


def entropy_spans(texts: Sequence[str], classes: Sequence[CharClass] = CLASSES) -> list[list[tuple[int, int, float]]]:
    """(start, end, highest entropy) of each text's spans of counting windows, classes joined; before any suppression."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    for cls in classes:
        run = re.compile(f"[{cls.signs}]{{{cls.window},}}")
        found = [(t, m.start(), m[0]) for t, text in enumerate(texts) for m in run.finditer(text)]
        if not found:
            continue
        good, sums = _windows([s for _, _, s in found], cls)
        offsets = np.cumsum([0, *(len(s) for _, _, s in found)])
        hits = np.flatnonzero(good)
        of = np.searchsorted(offsets, hits, "right") - 1
        new = np.flatnonzero((np.diff(hits, prepend=-cls.window - 2) > cls.window) | (np.diff(of, prepend=-1) > 0))
        for a, b in zip(new, [*new[1:], len(hits)]):
            t, start, _ = found[of[a]]
            shift = start - int(offsets[of[a]])
            out[t].append((int(hits[a]) + shift, int(hits[b - 1]) + shift + cls.window, float(np.log2(cls.window) - sums[hits[a:b]].min() / UNIT / cls.window)))
    return [_joined(spans) for spans in out]


def _joined(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int, float]] = []
    for start, end, bits in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), max(bits, out[-1][2]))
        else:
            out.append((start, end, bits))
    return out


def spans_of(texts: Sequence[str], classes: Sequence[CharClass] = CLASSES, before: str = ALLOWED_BEFORE, inside: str = ALLOWED_INSIDE) -> list[list[tuple[str, int, int, float | None]]]:
    """All spans of each text by start, then kind as listed; added ones that are reported already or allowed are left out."""
    known_before, known_inside = re.compile(before), re.compile(inside)
    out = []
    for text, added in zip(texts, entropy_spans(texts, classes)):
        base = base_spans(text)
        spans = [(kind, start, end, None) for kind, start, end in base]
        for start, end, bits in added:
            told = any(a < end and start < b for _, a, b in base)
            if not told and not known_before.search(text, max(0, start - 32), start) and not known_inside.search(text, start, end):
                spans.append(("entropy", start, end, bits))
        out.append(sorted(spans, key=lambda s: s[1]))
    return out


def secret_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", classes: Sequence[CharClass] = CLASSES, before: str = ALLOWED_BEFORE, inside: str = ALLOWED_INSIDE) -> DataFrame:
    """(id, spans) of every row; a span has its kind, start, end (exclusive, code points) and, if added, its highest entropy."""
    look = "|".join([_LOOK, *(f"[{c.signs}]{{{c.window}}}" for c in classes)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        for part in slices(batches):
            texts = part.column(1).fill_null("")
            at = np.flatnonzero(pc.match_substring_regex(texts, look).to_numpy(zero_copy_only=False))
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for k, spans in zip(at, spans_of(texts.take(pa.array(at)).to_pylist(), classes, before, inside)):
                found[k] = [dict(zip(("kind", "start", "end", "bits"), s)) for s in spans]
            yield pa.record_batch([part.column(0), pa.array(found, kind)], names=["id", "spans"])

    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_column)


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """Per row: numbers of base spans by kind, the digest of the base spans, and all spans as a text."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    number = [count(kind).alias(f"n_{kind}") for kind, *_ in BASE]
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    return found.select(*[c for c in found.columns if c != "spans"], *number, F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(spans).alias("spans"))


def redacted(documents: DataFrame, mark: str = "[SECRET]", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text) with every span replaced by a mark; overlapping spans by one."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            for k, spans in enumerate(spans_of([t or "" for t in texts])):
                pieces, at = [], 0
                for start, end, _ in _joined([(s, e, 0.0) for _, s, e, _ in spans]):
                    pieces += [texts[k][at:start], mark]
                    at = end
                texts[k] = "".join([*pieces, texts[k][at:]]) if pieces else texts[k]
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(clean, rows.schema).withColumnsRenamed({"id": id_column, "text": text_column})
