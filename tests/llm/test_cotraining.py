"""Co-training rounds and scores against plain NumPy over dense features."""

import math

import numpy as np
import pytest

from foliant.llm import cotraining as ct
from foliant.llm.common import table

OPTIONS = dict(rounds=2, a_round=15, sure=0.9)


def chance(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def dense_fit(x, y, weight):
    """Adam over a dense matrix, as the operator documents it."""
    n, weight = len(y), weight / weight.sum()
    x = np.concatenate((x, np.ones((n, 1))), 1)
    w, mean, square = (np.zeros(x.shape[1]) for _ in range(3))
    for k in range(1, 151):
        gradient = x.T @ (weight * (chance(x @ w) - y))
        gradient[:-1] += (1e-4 + 0.3 / n) * w[:-1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w - 0.2 * (1 - k / 151) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return w


def newton(x, y, ridge):
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    penalty = np.diag([*[ridge] * (x.shape[1] - 1), 1e-9])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = chance(x @ w)
        change = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x / len(x) + penalty, x.T @ (p - y) / len(x) + penalty @ w)
        w = w - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-9:
            break
    return w


def test_rounds_and_scores_like_plain_numpy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    source, marks = ct._source(docs, "doc_id"), ct._marks(labels)
    place = ct.choose_words(source, marks)
    rows = sorted(ct.features(source, place).collect(), key=lambda r: r.row)
    told = {r.marked: r for r in marks.collect()}
    known = [r for r in rows if r.id in told]
    y = {f: np.array([float(told[r.id][f]) for r in known]) for f in ct.FAULTS}
    fold = np.array([bool(told[r.id].fold) for r in known])
    shapes = np.array([r["shape"] for r in known], np.float32)
    borders = np.quantile(shapes[~fold], np.linspace(0, 1, ct.BINS + 1)[1:-1], axis=0).T

    def dense(some):
        width = 2 * ct.SHAPES * ct.BINS
        text, meta = np.zeros((len(some), width + int(place.max()) + 1)), np.zeros((len(some), ct.META))
        for i, r in enumerate(some):
            shape = np.array(r["shape"], np.float32)
            for k, v in enumerate(shape):
                text[i, 2 * k * ct.BINS + (ct.BINS if shape[0] < math.log(25) else 0) + sum(b <= v for b in borders[k])] = 1
            text[i, [width + w for w in r.words]] = 1
            for m in r.meta:
                meta[i, m] += 1
        return text, meta

    own, other = dense(known), [r for r in rows if r.id not in told]
    theirs = dense(other)
    extra = {(f, k): ([], []) for f in ct.FAULTS for k in (0, 1)}  # rows of ``other`` and their labels
    given, moved = set(), 0
    for left in range(OPTIONS["rounds"], -1, -1):
        margins = {}
        for f in ct.FAULTS:
            for k in (0, 1):
                more, marked = extra[f, k]
                x, target = np.concatenate((own[k][~fold], theirs[k][more])), np.concatenate((y[f][~fold], marked))
                w = dense_fit(x, target, np.concatenate((np.ones((~fold).sum()), np.full(len(more), 0.5))))
                on_fold, everywhere = own[k][fold] @ w[:-1] + w[-1], theirs[k] @ w[:-1] + w[-1]
                spread = on_fold.std() or 1.0
                a, b = newton((on_fold / spread)[:, None], y[f][fold], 1e-3)
                margins[f, k] = tuple(a / spread * m + b for m in (on_fold, everywhere, own[k] @ w[:-1] + w[-1]))
        if not left:
            break
        chosen = set()
        for f, k in margins:
            for label in (0, 1):
                sure = chance(margins[f, k][1])
                sure = sure if label else 1 - sure
                best = sorted((i for i in range(len(other)) if other[i].row not in given and sure[i] >= OPTIONS["sure"]), key=lambda i: (-sure[i], other[i].row))[: OPTIONS["a_round"]]
                extra[f, 1 - k][0].extend(best)
                extra[f, 1 - k][1].extend([float(label)] * len(best))
                chosen.update(other[i].row for i in best)
        given |= chosen
        moved += len(chosen)
    want = {}
    for which, group in ((1, other), (2, known)):
        out = []
        for f in ct.FAULTS:
            both = np.stack([margins[f, k][0] for k in (0, 1)], 1)
            a, b, c = newton(both, y[f][fold], 1e-4)
            out.append(chance(a * margins[f, 0][which] + b * margins[f, 1][which] + c))
        want |= {r.id: (p, q) for r, p, q in zip(group, *out)}
    got = {r.doc_id: r for r in ct.score_documents(docs, labels, **OPTIONS).collect()}
    assert moved > 30 and len(got) == len(want) == len(rows)
    for key, (low, toxic) in want.items():
        r = got[key]
        assert (r.low, r.toxic) == (pytest.approx(low, abs=2e-3), pytest.approx(toxic, abs=2e-3))
        assert r.score == pytest.approx((1 - r.low) * (1 - r.toxic)) and r.keep == (1 - r.score <= 0.6)
