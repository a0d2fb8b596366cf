"""Suffix deduplication, near duplicates and their kernels against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliant.llm.near_duplicates import _grams, label, near_duplicate_classes, parities, without_near_duplicates
from foliant.llm.shingles import common_in_order, in_order_similarity, shingles, word_hashes
from foliant.llm.suffix_dedup import remove_repeats


def brute_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("hot", [50_000, 1])
def test_removal_like_brute_force(odd, odd_rows, hot):
    want = sorted(((r[0], *x) for r, x in zip(odd_rows, brute_removal([(r[1] or "").encode() for r in odd_rows], 200))), key=str)
    got = sorted(((*r[:5], bytes(r[5])) for r in remove_repeats(odd, hot=hot, with_kept=True).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("hot", [50_000, 2])
def test_removal_of_mixed_passages(spark, hot):
    rng = random.Random(11)
    base = "".join(rng.choices("abcd ", k=2500))
    texts = []
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 2300)
            parts.append(base[a : a + rng.randint(50, 600)] if rng.random() < 0.7 else "".join(rng.choices("abcdeé", k=rng.randint(0, 200))))
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = [(i, *x[:4]) for i, x in enumerate(brute_removal([t.encode() for t in texts], 200))]
    assert sorted(map(tuple, remove_repeats(df, hot=hot).collect())) == want


def test_nothing_to_remove(none):
    assert remove_repeats(none).count() == 0 and near_duplicate_classes(none).count() == 0 and without_near_duplicates(none).count() == 0


def similarity(a, b):
    """In-order similarity by plain dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1]) if len(a) + len(b) else 0.0


def test_alignment_like_plain_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randint(0, 60) for _ in range(rng.randint(1, 80))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(b) or 1)
            b[k : k + rng.randint(0, 2)] = [rng.randint(0, 60) for _ in range(rng.randint(0, 2))]
        want, got = similarity(a, b), in_order_similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8
    assert common_in_order([1, 2, 3], [9, 9, 9, 9, 1, 2, 3], 2) == 0 and common_in_order([1, 2, 3], [9, 1, 2, 3], 1) == 3


def test_shingles():
    a, b, c = word_hashes([b"the  cat\nsat", b"", b"cat the cat sat on"])
    assert len(a) == 3 and len(b) == 0 and a[1] == c[0] == c[2] and a[0] == c[1]
    assert len(shingles(a, 5)) == 1 and len(shingles(b, 5)) == 0 and len(shingles(c, 5)) == 1 and shingles(a, 5)[0] != shingles(c, 5)[0]


def test_parity_maps_never_differ_more_than_texts():
    rng = random.Random(8)
    for _ in range(200):
        a = [rng.randint(0, 400) for _ in range(rng.randint(0, 900))]
        b = [x if rng.random() < 0.8 else rng.randint(0, 10_000) for x in a] + [1] * rng.randint(0, 3)
        x, y = (label(np.array(v, np.uint64)) for v in (a, b))
        apart = len(set(x.tolist()) ^ set(y.tolist()))
        differ = int(np.bitwise_count((parities(x) ^ parities(y)).view(np.uint64)).sum())
        assert differ <= apart and (apart - differ) % 2 == 0
        if similarity(a[:80], b[:80]) >= 0.8:
            u, v = (label(np.array(w[:80], np.uint64)) for w in (a, b))
            assert int(np.bitwise_count((parities(u) ^ parities(v)).view(np.uint64)).sum()) * 9 <= len(u) + len(v)


def brute_classes(rows):
    """Class of each row: components over equal texts and pairs of similarity 0.8."""
    texts = list(dict.fromkeys(r[1] or "" for r in rows))
    grams, parent = [g.tolist() for g in _grams(texts)], list(range(len(texts)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            short, long = sorted((len(grams[i]), len(grams[j])))
            if short and short >= 0.8 * long and set(grams[i]) & set(grams[j]) and similarity(grams[i], grams[j]) >= 0.8:
                parent[top(i)] = top(j)
    place = {t: top(k) for k, t in enumerate(texts)}
    return [place[r[1] or ""] for r in rows]


def check_classes(df, rows):
    found = near_duplicate_classes(df).collect()
    assert len(found) == len(rows)
    members = defaultdict(list)
    for row, k in zip(rows, brute_classes(rows)):
        members[k].append(row[0])
    want = Counter((d, min((x for x in ids if x is not None), default=None)) for ids in members.values() for d in ids)
    assert Counter((r.doc_id, r.class_id) for r in found) == want
    assert len({(r.doc_id, bytes(r.node)) for r in found if r.kept}) == len(members)
    assert without_near_duplicates(df).count() == len(members)


def test_odd_rows(odd, odd_rows):
    check_classes(odd, odd_rows)


def test_chains_and_large_groups(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, base = [], [word() for _ in range(150)]
    rows.append((0, " ".join(base)))
    for i in range(1, 60):  # edits of one original, unlike each other
        copy = list(base)
        for k in rng.sample(range(150), 2):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    chain = [word() for _ in range(120)]
    for i in range(100, 112):  # each like the one before, not like the first
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((i, " ".join(chain)))
    passage = [word() for _ in range(60)]
    rows += [(200 + i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for i in range(40)]
    rows += [(300, "tiny text of six words here"), (301, "tiny text of six words here"), (302, "x"), (303, "x "), (304, "eight words are just enough to be alike"), (305, "eight words are just enough to be alike now")]
    check_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_links_in_a_bucket_too_large_for_drawn_centres(spark, monkeypatch):
    """One bucket of texts that share a passage, each just unlike the others, and a few pairs among them that are links."""
    from foliant.llm import near_duplicates as nd

    monkeypatch.setattr(nd, "sketches", lambda labelled: np.ones(1, np.uint64))
    monkeypatch.setattr(nd, "DRAWN", 1)
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, rows = [word() for _ in range(125)], []
    for i in range(60):
        own = [word() for _ in range(26)]
        rows.append((i, " ".join(own[:13] + passage + own[13:])))
        if i % 15 == 0:
            rows.append((1000 + i, " ".join(own[:13] + passage + [word() for _ in range(5)] + own[18:])))
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(2 + i)])) for i in range(3)]
    check_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_anchors_of_a_text_longer_than_their_places(monkeypatch):
    from foliant.llm import suffix_dedup, suffix_runs

    monkeypatch.setattr(suffix_runs, "PIECE", 1 << 10)
    monkeypatch.setattr(suffix_runs, "_PLACE", np.uint64((1 << 11) - 1))
    rng = random.Random(41)
    passage = bytes(rng.choices(b"abcdefgh", k=300))
    text = b"".join(bytes(rng.choices(b"abcdefgh", k=700)) + passage for _ in range(12))
    place_of = {}
    for _, _, place, low, high, _ in suffix_dedup._text_anchors([text, b"short"], 200):
        for p, a, b in zip(place.tolist(), low.tolist(), high.tolist()):
            for w in range(a, b + 1):
                assert w not in place_of and 0 <= p - w <= 200 - suffix_runs.GRAM
                place_of[w] = p
    assert len(place_of) == len(text) - 199
    assert {place_of[1000 * k + 750] - 1000 * k for k in range(12)} == {place_of[750]}


def test_windows_with_equal_hashes_are_compared_by_bytes(monkeypatch):
    """With a hash that tells nothing apart, the bytes alone decide."""
    from foliant.llm import suffix_runs

    rng = random.Random(14)
    anchor = bytes(rng.choices(b"xyz", k=suffix_runs.GRAM))
    wholes = [bytes(rng.choices(b"ab", k=150)) + anchor + bytes(rng.choices(b"ab", k=150)) for _ in range(4)]
    wholes += [wholes[0][:230] + bytes(rng.choices(b"cd", k=110)), bytes(rng.choices(b"cd", k=110)) + wholes[1][110:]]
    entries = [(suffix_runs.entry(w, 150, 0, len(w) - 200, 200), 150, [(bytes([k]) * 16, 0)]) for k, w in enumerate(wholes)]
    want = sorted(suffix_runs.repeated([entries], 200))
    monkeypatch.setattr(suffix_runs, "window_hashes", lambda data, length: np.zeros(len(data) - length + 1, np.uint64))
    assert sorted(suffix_runs.repeated([entries], 200)) == want
    assert {(t[0], a, b) for t, a, b in want} == {(0, 0, 230), (4, 0, 230), (1, 110, 340), (5, 110, 340)}


def test_a_text_longer_than_a_batch_and_a_passage_behind_8_mib(spark):
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, 9_500_000, dtype=np.uint8).tobytes().decode()
    passage = long[9_000_000:9_000_500]
    rows = [(0, long), (1, "short " + passage + " end"), (2, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (9_500_000, 500, 1), 1: (510, 500, 1), 2: (0, 0, 0)}


def test_window_and_span_hashes():
    from foliant.llm.shingles import pieces, span_hashes, spans, window_hashes

    rng = random.Random(4)
    data = np.array(rng.choices([97, 98], k=400), np.uint8)
    for length in (1, 2, 5, 40, 200, 400):
        value, seen = window_hashes(data, length), {}
        assert len(value) == 400 - length + 1
        for i, v in enumerate(value.tolist()):
            assert seen.setdefault(data[i : i + length].tobytes(), v) == v
        assert len(set(seen.values())) == len(seen)
    texts = [b"ab cd  ab", b"", b"a" * 30 + b" bc", b"cd\tab"]
    for most in (5, 1000):
        got = [[] for _ in texts]
        for raw, ends, numbers in pieces(texts, most):
            inside = raw > 32
            first, last = spans(inside)
            for a, b, v in zip(first.tolist(), last.tolist(), span_hashes(raw, inside, first, last).tolist()):
                got[numbers[np.searchsorted(ends, a, "right")]].append((raw[a:b].tobytes(), v))
        assert [[w for w, _ in x] for x in got] == [t.split() for t in texts] and len({v for x in got for _, v in x}) == 4


def test_recall_of_links_between_0_8_and_0_95(spark):
    """600 pairs with random edits: nine of ten links at least are found (all, but for one in 1e5)."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, linked = [], 0
    for i in range(600):
        base = [word() for _ in range(rng.choice([40, 120, 300]))]
        copy = list(base)
        for _ in range(rng.randint(1, 1 + len(base) // 50)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    grams = [g.tolist() for g in _grams([t for _, t in rows])]
    want = [i for i in range(600) if 0.8 <= similarity(grams[2 * i], grams[2 * i + 1]) < 0.95]
    found = {r.doc_id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = sum(found[2 * i] == found[2 * i + 1] for i in want)
    assert len(want) > 150 and linked >= 0.9 * len(want)
    assert all(found[2 * i] != found[2 * i + 1] for i in range(600) if similarity(grams[2 * i], grams[2 * i + 1]) < 0.8)


def test_links_are_counted(spark):
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near = lambda k: " ".join([*base[:k], "changed", *base[k + 1 :]])
    rows = [(0, " ".join(base)), (1, near(50)), (2, near(20)), (3, "something else that nobody else has written so far"), (4, " ".join(base)), (5, None)]
    found = {r.doc_id: r for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[k].class_id for k in range(6)] == [0, 0, 0, 3, 0, 5]
    assert found[3].n_links == found[5].n_links == 0 and found[3].linked_id is None and found[5].similarity is None
    assert all(found[k].n_links >= 1 and 0.8 <= found[k].similarity < 1 for k in (0, 1, 2, 4)) and found[0].n_links == found[4].n_links
    assert sum(found[k].n_links for k in (0, 1, 2)) >= 4 and found[1].linked_id in (0, 2) and found[2].linked_id in (0, 1)
    grams = [set(zip(*(t.split()[k:] for k in range(5)))) for t in (rows[0][1], rows[1][1])]
    if found[1].linked_id == 0:
        assert found[1].similarity == pytest.approx(len(grams[0] & grams[1]) / len(grams[0] | grams[1]))
