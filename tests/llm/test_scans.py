"""Secret scan, hard negatives and spelling variants, against brute force."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import hard_negatives as hn
from foliant.llm import secret_scan, spelling


def plain_spans(text):
    """Every window counted anew."""
    base = []
    for rank, (kind, pattern, flags, part, least) in enumerate(secret_scan.BASE):
        base += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text, flags) if len(m[part]) >= least]
    covered = []
    for cls in secret_scan.CLASSES:
        for run in re.finditer(f"[{cls.signs}]+", text):
            for i in range(run.start(), run.end() - cls.window + 1):
                window = text[i : i + cls.window]
                entropy = math.log2(cls.window) - sum(c * math.log2(c) for c in collections.Counter(window).values()) / cls.window
                kinds = sum(c.isdigit() for c in window), sum(c.islower() for c in window), sum(c.isupper() for c in window)
                if entropy >= cls.bits and kinds[0] >= cls.digits and kinds[1] >= cls.lower and kinds[2] >= cls.upper:
                    covered.append((i, i + cls.window))
    added = []
    for start, end in sorted(covered):
        if added and start <= added[-1][1]:
            added[-1] = (added[-1][0], max(end, added[-1][1]))
        else:
            added.append((start, end))
    spans = [(start, rank, end) for start, rank, end in base]
    for start, end in added:
        told = any(a < end and start < b for a, _, b in base)
        allowed = re.search(secret_scan.ALLOWED_BEFORE, text[max(0, start - 32) : start]) or re.search(secret_scan.ALLOWED_INSIDE, text[start:end])
        if not told and not allowed:
            spans.append((start, 3, end))
    names = [kind for kind, *_ in secret_scan.BASE] + ["entropy"]
    return [f"{names[rank]}:{start}:{end}" for start, rank, end in sorted(spans)]


def hostile_texts(rng, n):
    letters = string.ascii_letters + string.digits
    make = [
        lambda: "".join(rng.choices(letters, k=rng.randint(10, 70))), lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(10, 60))), lambda: "".join(rng.choices("0123456789ABCDEF", k=rng.randint(10, 60))),
        lambda: rng.choice(["toKen", "SECRET", "passwd", "ſecret", "toKen", "api_key", "ApiKey"]) + rng.choice([":", "=", "' = '", '": "', "  :  ", "=="]) + "".join(rng.choices(letters + "=.", k=rng.randint(5, 20))),
        lambda: "AKIA" + "".join(rng.choices("ABCXYZ0123", k=rng.randint(8, 20))), lambda: "é漢😀 word", lambda: "sha256: ", lambda: "example", lambda: "".join(rng.choices("abc1", k=30)), lambda: string.ascii_letters + string.digits,
    ]
    return [rng.choice(["", " ", "\n"]).join(rng.choice(make)() for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_secret_spans_like_plain_code(spark, odd, odd_rows, none):
    texts = hostile_texts(random.Random(7), 300)
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string, id int").repartition(3)
    found = {r.doc_id: r for r in secret_scan.span_digests(secret_scan.secret_spans(table)).collect()}
    wanted = {i: plain_spans(t) for i, t in enumerate(texts)}
    assert {i: r.spans for i, r in found.items()} == {i: ",".join(w) for i, w in wanted.items()}
    for i, w in wanted.items():
        base = [s for s in w if not s.startswith("entropy")]
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
    assert sum(s.startswith("entropy") for w in wanted.values() for s in w) > 100
    assert secret_scan.secret_spans(odd).count() == len(odd_rows) and secret_scan.secret_spans(none).count() == 0


def test_window_sums_are_counts():
    rng = np.random.default_rng(1)
    signs = rng.choice(np.frombuffer(b"abcd1F", np.uint8), 4000)
    term = secret_scan.terms(24)
    assert secret_scan.window_sums(signs, 24).tolist() == [sum(int(term[c]) for c in collections.Counter(signs[i : i + 24].tolist()).values()) for i in range(len(signs) - 23)]
    assert len(secret_scan.window_sums(signs[:23], 24)) == 0


def test_secrets_in_a_long_text_and_prose(spark, sample):
    rng, secret = random.Random(2), "zQ8vN2kLr5TxWc7JbHd3MfYp9Gs4Ae6U"
    prose = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(1_300_000))
    got = secret_scan.secret_spans(spark.createDataFrame([(1, prose + f" 漢 {secret} é " + "z" * 100)], "doc_id long, text string")).first().spans
    assert [(s.kind, s.start, s.end) for s in got] == [("entropy", len(prose) + 3, len(prose) + 3 + len(secret))] and got[0].bits > 4
    clean = secret_scan.redacted(spark.createDataFrame([(1, f"a token={secret} b {secret}"), (2, None), (3, "x")], "doc_id long, text string"))
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["a [SECRET] b [SECRET]", None, "x"]
    spans = secret_scan.secret_spans(sample).where(F.exists("spans", lambda s: s["kind"] == "entropy"))
    assert spans.count() == 0  # invented prose and its planted keys have none besides the base ones


def plain_negatives(rows, is_anchor, positives=5, negatives=10):
    rows = [(i, label, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, np.pad(v, (0, width - len(v)))) for i, label, v in rows]
    out = []
    for i, label, v in rows:
        if is_anchor(i):
            scored = sorted(((-int(v @ w), j, other) for j, other, w in rows if j != i))
            for s, j, _ in [x for x in scored if x[2] == label][:positives]:
                fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
                out += [(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, group", [(8, 4), (2048, 512)])
def test_hard_negatives_like_brute_force(spark, block, group):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in centres[rng.integers(0, 6)] + 0.2 * rng.normal(size=5)]) for i in range(300)]
    copies = [(300 + i, i % 3, rows[0][2]) for i in range(120)]  # one vector holds a third of all rows
    odd = [(None, 1, rows[1][2]), (900, None, rows[1][2]), (901, 1, None), (902, 1, [1.0, None, 0.0]), (903, 2, [float("nan")] * 5), (904, 2, [float("inf"), 0.0]), (905, 1, [0.5]), (906, 0, []), (20, 1, rows[2][2]), (21, 1, rows[2][2]), (21, 1, rows[2][2])]
    table = rows + copies + odd
    frame = spark.createDataFrame([(*r, "clash", 7) for r in table], "vec_id long, label int, embedding array<float>, leaf string, rank int").repartition(4)
    single = [(i, label, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in table]
    wanted = plain_negatives(single, lambda i: i % 10 == 0)
    got = hn.hard_negatives(hn.quantized(frame), F.col("vec_id") % 10 == 0, block=block, group=group)
    assert sorted(tuple(r) for r in got.collect()) == wanted and len(wanted) > 500
    assert hn.hard_negatives(hn.quantized(frame.limit(0)), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(hn.quantized(frame), F.lit(False)).count() == 0


def test_node_pairs_are_pruned_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = 40 * rng.normal(size=(8, 6))
    rows = np.floor(centres[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 6))).astype(np.float64)
    tree = hn.fit_tree(rows, 4)
    leaf = tree.leaves(rows)
    balls = np.full(32, -1.0)
    for k in range(16):
        own = rows[leaf == k]
        balls[16 + k] = np.linalg.norm(own - tree.centres[16 + k], axis=1).max() if len(own) else -1
    for node in range(15, 0, -1):
        balls[node] = max(np.linalg.norm(tree.centres[node] - tree.centres[c]) + balls[c] for c in (2 * node, 2 * node + 1))
    scores = rows @ rows.T
    best = scores.max()
    low, high = np.full(32, 0.8 * best), np.full(32, np.inf)
    pairs = set(zip(*(x.tolist() for x in hn.descend(tree, (4, 4), (balls, balls), low, high))))
    needed = {(int(leaf[a]), int(leaf[b])) for a, b in zip(*np.nonzero(scores >= 0.8 * best))}
    assert needed <= pairs and len(pairs) < 0.5 * 256  # whole groups are left out


def test_large_numbers_stay_exact():
    a = np.array([[2**40, 3], [1, 2**30]], np.int64)
    assert hn.inner_products(a, a).tolist() == [[2**63 - 1, 2**40 + 3 * 2**30], [2**40 + 3 * 2**30, 2**60 + 1]]
    r, c = hn.best_places(np.array([[2**62, 5, 2**62], [1, 1, 1]], np.int64), np.ones((2, 3), bool), 2)
    assert list(zip(r, c)) == [(0, 0), (0, 2), (1, 0), (1, 1)]


def plain_variants(rows, slip=31, shortest=7, least=2):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    shared, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shared[w[:i] + w[i + 1 :], i].add(w)
    for (rest, _), group in shared.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}
    out = set()
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c, len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelled(rng, n):
    """Texts of few stems with edits, so that words have many near ones and chains of forms."""
    stems = ["".join(rng.choices("abéÿ", k=rng.randint(6, 10))) for _ in range(25)]
    def word():
        w = rng.choices(stems, weights=[4**-k for k in range(25)])[0]
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(["", w[k] * 2, "a", "b", "É"]) + w[k + rng.randint(0, 1) :]
        return w.upper() if rng.random() < 0.02 else w
    return [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("shard, broadcast", [(16, 200), (32768, 32 << 20)])
def test_spelling_like_brute_force(spark, monkeypatch, shard, broadcast):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "BROADCAST", broadcast)
    rng = random.Random(11)
    long = "ab" * 3000
    texts = [*spelled(rng, 150), None, "", "×÷ 123", f"{long} {long}x {long[:9]}x{long[9:]}", f"{long} {long}x x{long} {long[:9]}x{long[9:]}", "one-two,THREEFOLD_threefold"]
    rows = [(None if i == 7 else i, t, "clash", 1) for i, t in enumerate(texts)]
    rows += rows[:3]
    table = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(4)
    got = {tuple(r) for r in spelling.spelling_variants(table).collect()}
    wanted = plain_variants([r[:2] for r in rows])
    assert got == wanted and any(r[1] and r[2] != r[1] for r in wanted) and any(len(r[0]) > 5000 and r[4] for r in wanted)
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_tries_meet_each_neighbour_once():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(6, 9))).encode() for _ in range(300)})
    trie, exact = spelling.Trie(words), np.array([len(w) // 2 for w in words])
    w, v = trie.near(words, exact)
    got = list(zip(w.tolist(), v.tolist()))
    wanted = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if a[: exact[i]] == b[: exact[i]] and spelling.one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == wanted
    assert [spelling.one_edit(*x) for x in ((b"abc", b"abc"), (b"abc", b"ab"), (b"abc", b"axc"), (b"", b"a"), (b"abc", b"acb"), (b"aab", b"ab"), (b"abc", b"a"))] == [False, True, True, True, False, True, False]


def test_counts_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in spelling.spelling_variants(odd).collect()} == plain_variants(rows)
    assert spelling.word_counts(none).count() == 0
