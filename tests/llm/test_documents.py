"""URL filter, mixing, chat, classifier, fingerprints, decontamination and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import merkle
from foliant.llm.chat import CONTROL, TEMPLATE, digests, escape, format_conversations, read_back, unescape
from foliant.llm.cotraining import good_documents, score_documents
from foliant.llm.decontaminate import clean_documents, contaminated, smith_waterman
from foliant.llm.mixing import mix, mixed_documents, source_targets, training_order
from foliant.llm.templates import Literal, Print, TemplateError, compile_template, fold, parse
from foliant.llm.url_filter import judge_urls, propagate


def test_url_rules(spark):
    urls = ["https://A.Example.COM/en/7x?q#f", "http://x.com/en/1", "https://example.net/de/8", "b.example.net/de/8", None, "ftp://org/es/", "http://notcom/en/", "http://h.net", "http://com?/en/", "x://y.org/es", "http://z.org/es/a://b"]
    rows = {r.page_id: r for r in judge_urls(spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(len(urls))] == [
        ("a.example.com", "/en/7x", "example.com/en/7"), ("x.com", "/en/1", "com/en/"), ("example.net", "/de/8", "example.net/de/8"), ("", "", None), ("", "", None), ("org", "/es/", "org/es/"), ("notcom", "/en/", None), ("h.net", "", None), ("com", "", None), ("y.org", "/es", None), ("z.org", "/es/a://b", "org/es/"),
    ]
    assert [rows[i].verdict for i in (0, 1, 2, 4, 5)] == ["allow", "block", "allow", "allow", "block"]


def test_distrust_reaches_what_links_to_blocked_hosts(spark):
    link = lambda *hosts: "".join(f"<a class=x href='//{h}/p'>t</a>" for h in hosts)
    rows = [(0, "http://spam.com/en/1", ""), (1, "http://farm.info/a", link("spam.com", "SPAM.com")), (2, "http://good.info/a", link("fine.info")), (3, "http://example.com/en/7", link("fine.info")), (4, "http://fine.info/b", link("example.com"))]
    found = {r.host: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), threshold=0.3).collect()}
    assert {h: r.verdict for h, r in found.items()} == {"spam.com": "block", "farm.info": "block", "good.info": "allow", "example.com": "allow", "fine.info": "allow"}
    assert found["fine.info"].trust > found["fine.info"].distrust == 0
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_like_dense_iteration(spark):
    rng = np.random.default_rng(4)
    n, edges = 12, {(int(a), int(b)): int(c) for a, b, c in rng.integers(0, 12, (30, 3)) if a != b}
    edges = {k: v + 1 for k, v in edges.items()}
    flow = np.zeros((n, n))
    for (a, b), w in edges.items():
        flow[b, a] = w
    flow = flow / np.maximum(1, flow.sum(0))
    seed = np.zeros(n)
    seed[:2] = 0.5
    want = np.linalg.solve(np.eye(n) - 0.85 * flow, 0.15 * seed)
    frame = spark.createDataFrame([(str(a), str(b), w) for (a, b), w in edges.items()], "src string, dst string, n int")
    got = {int(r.host): r.score for r in propagate(frame, spark.createDataFrame([("0", 1, 0.5), ("1", 1, 0.5)], "host string, kind int, seed double"), iterations=100).collect()}
    assert np.allclose([got.get(k, 0) for k in range(n)], want / want.sum(), atol=1e-6)


def test_targets_like_repeated_resharing(spark):
    rng = random.Random(9)
    for _ in range(4):
        sizes = {(None if k == 0 and rng.random() < 0.5 else f"s{k}é"): rng.choice([0, 3, 50, 1000, 9000]) for k in range(rng.randint(1, 8))}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
        while free:
            total = sum(weight[s] for s in free)
            full = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
            if not full:
                target |= {s: left * weight[s] / total for s in free}
                break
            target |= {s: 2.0 * sizes[s] for s in full}
            left, free = left - sum(2 * sizes[s] for s in full), free - full
        rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert {r.source: pytest.approx(r.target) for r in rows} == target


@pytest.mark.parametrize("bucket_rows", [3, 4096])
def test_mix(odd, odd_rows, none, bucket_rows):
    rows = mix(odd, bucket_rows=bucket_rows).collect()
    assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in odd_rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].source_size == sum(r["size"] for r in own)
    assert all(0 <= r.taken <= 2 * r["size"] and (r.position is None) == (not r.first_words) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix(odd.repartition(2), bucket_rows=bucket_rows).collect()))
    order = [r.position for r in training_order(mix(odd)).collect()]
    assert order == sorted(order, key=lambda p: (p is None, p))
    documents = mixed_documents(odd)
    assert documents.columns == odd.columns and documents.count() > 0 and mix(none).count() == mixed_documents(none).count() == 0


def test_chat(spark):
    hostile = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "tool <|x|> [TEXT] ", hostile), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "[\\INST] \\[INST]"), (3, 0, "assistant", ""), (-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    formatted = format_conversations(turns)
    found = {r.conv_id: r for r in digests(formatted).collect()}
    assert set(found) == {1, 2, 3, None, -7}
    for key, got in found.items():
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1], str(r[2]), str(r[3])))
        learned = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        assert (got.n_turns, got.loss_chars, got.loss_sha256) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert format_conversations(turns.limit(0)).count() == 0
    parted = format_conversations(turns, part_chars=1)
    assert parted.count() == len(rows) + len(found) and {tuple(r) for r in digests(parted).collect()} == {tuple(r) for r in found.values()}


def test_escapes_are_reversible():
    rng = random.Random(1)
    render = compile_template(TEMPLATE, {"escape": escape})
    for _ in range(2000):
        text = "".join(rng.choices(["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "ROLE]", " ", "x", "\n"], k=rng.randint(0, 12)))
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)
        messages = [{"role": rng.choice(["user", "assistant", "system", "", text]), "text": text} for _ in range(3)]
        assert read_back(render({"messages": messages}).text()) == [(m["role"], m["text"]) for m in messages]


def test_templates():
    run = lambda t, **v: compile_template(t)(v).text()
    assert run("a{% for x in xs -%} {{ x.n | upper }}{% if x.n == 'b' %}!{% elif not x.m %}?{% else %}.{% endif %}{% endfor %}z", xs=[{"n": "a"}, {"n": "b"}, {"n": "c", "m": 1}]) == "aA?B!C.z"
    assert run("{% set y = 'p' + 1 %}{{ y }}{{ none }}{{ true }}{{ z | default('d') }}{{ xs | length }}{{ 'b' in xs }}", xs=["a", "b"]) == "p1trued2true"
    marked = compile_template("<{% generation %}{{ x }}{% endgeneration %}>{% generation %}{% endgeneration %}")({"x": "abc"})
    assert marked.text() == "<abc>" and marked.spans == [(1, 4), (5, 5)]
    assert fold(parse("a{{ 'b' + ('c' | upper) }}{% if 1 < 2 %}d{% else %}{{ x }}{% endif %}"), {"upper": str.upper}) == (Print(Literal("abCd")),)
    assert run("{{ x.__class__ }}{{ x['__init__'] }}", x="s") == ""
    for bad in ("{% if x %}", "{% endif %}", "{{ x( }}", "{{ f(1) }}", "{{ x | nope }}", "{% import os %}", "{{ x }%}", "{% for x %}{% endfor %}", "{{ }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_classifier(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept_back = F.crc32(F.concat(F.lit("held"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0  # never seen in training
    held = score_documents(docs, labels.where(~kept_back)).join(labels.where(kept_back).withColumnRenamed("toxic", "marked"), "doc_id").toPandas()
    clean, low = (held.quality == 1) & (held.marked == 0), held.quality == 0
    assert len(held) > 50 and held.keep[clean].mean() > 0.95 and held.keep[low].mean() < 0.2
    assert (held.keep == clean).mean() > 0.85
    assert good_documents(docs, labels).count() == score_documents(docs, labels).where("keep").count()
    rows = score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and good_documents(odd, labels).columns == odd.columns
    assert score_documents(none, labels).count() == 0
    strange = spark.createDataFrame([(None, 1, 1), (1, None, None), (10**9, 1, 0), (0, 1, None)], "doc_id long, quality int, toxic int")
    assert score_documents(docs.limit(5), strange).where("keep").count() == 5
    assert score_documents(docs.limit(5), strange.limit(0)).where("keep").count() == 5


def test_fingerprints(odd, odd_rows, none):
    rows = merkle.edit_fingerprints(odd).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    want = []
    for k, row in enumerate(order):
        text, after = row[1] or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        want.append((row[0], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((tuple(r)[:3] for r in rows), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    prints = {}
    for r in merkle.merkle_fingerprints(odd.withColumn("doc_id", F.coalesce("text", F.lit("")))).collect():
        assert prints.setdefault(r.doc_id, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert merkle.edit_fingerprints(none).count() == 0
    one = merkle.edit_fingerprints(odd.where("text = 'one'")).first()
    assert one.near_next == 1.0 and one.n_chars == 3


def test_fingerprints_find_edits():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    lines = [" ".join(word() for _ in range(12)) for _ in range(60)]
    changed = lines[:20] + ["new line", "another"] + lines[21:]
    a, b = "\n".join(lines).encode(), "\n".join(changed).encode()
    assert merkle.differences(a, b) == [(20, 21, 20, 22)] and merkle.differences(a, a) == []
    x, y, z = merkle.fingerprints([a, b, "\n".join(" ".join(word() for _ in range(12)) for _ in range(60)).encode()])
    assert merkle.likeness(x, x) == 1.0 and merkle.likeness(x, y) > 0.9 and merkle.likeness(x, z) < 0.1
    assert merkle.likeness(x, merkle.from_string(merkle.as_string(y))) == merkle.likeness(x, y)


def test_smith_waterman_like_plain_loops():
    rng = np.random.default_rng(6)
    items, passages = rng.integers(1, 5, (40, 9)).astype(np.int32), rng.integers(1, 5, (40, 15)).astype(np.int32)
    best, end = smith_waterman(items, passages)
    for a, b, score, at in zip(items, passages, best, end):
        h = np.zeros((10, 16), int)
        for i in range(1, 10):
            for j in range(1, 16):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert score == h.max() and (h[:, at] == h.max()).any()


def test_decontamination(spark, odd, none):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [[word() for _ in range(30)] for _ in range(6)]
    fill = lambda n: [word() for _ in range(n)]
    edited = [w if k % 6 else word() for k, w in enumerate(items[1])]
    texts = [fill(20) + items[0] + fill(10), fill(5) + edited + fill(50), fill(80), items[2][:8] + fill(40), items[3] + fill(9) + items[3], [w.upper() + "," for w in items[4]]]
    docs = spark.createDataFrame([(i, " ".join(t), None) for i, t in enumerate(texts)] + [(6, None, 1), (7, "", 1), (0, " ".join(texts[0]), 1)], "doc_id long, text string, score int")
    bench = spark.createDataFrame([(i, " ".join(t), 0) for i, t in enumerate(items)] + [(90, None, 0), (91, "too short", 0), (92, " ".join(items[0]), 0)], "item_id long, text string, doc_id int")
    for size in (1_000_000, 40):
        found = contaminated(docs, bench, block_words=size).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (0, 92), (1, 1), (4, 3), (5, 4)} and len(found) == 8
        exact = [r for r in found if r.item_id == 0]
        assert all((r.score, r.first_word, r.end_word) == (1.0, 20, 50) for r in exact)
        assert sorted(r.doc_id for r in clean_documents(docs, bench, block_words=size).collect()) == [2, 3, 6, 7]
    assert contaminated(docs, bench.limit(0)).count() == 0 and clean_documents(docs, bench.limit(0)).count() == 9
    assert contaminated(none, bench).count() == 0 and clean_documents(odd, bench).count() == odd.count()


def test_pipeline(spark, odd, none, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"] and p.ORACLE_SQL is None
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns and 0 < kept.count()
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = kept
    out = p.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (odd.select(columns), none.select(columns)):
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{t}.parquet").write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
        rows.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert p.run(spark, str(tmp_path)).count() >= 0


@pytest.mark.parametrize("often", [0, 400])
@pytest.mark.parametrize("every", [7, 6, 5, 4, 3])
def test_edited_copy_beside_exact_copies(every, often):
    """Also where the corpus is full of the item's words and word pairs."""
    import inspect

    import pyarrow as pa

    from foliant.llm.decontaminate import Block

    p = {k: v.default for k, v in inspect.signature(contaminated).parameters.items()}
    rng, found = random.Random(31), 0
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    for _ in range(20):
        item = [word() for _ in range(40)]
        edited = [word() if k % every == every - 1 else w for k, w in enumerate(item)]
        others = [[w for k in rng.sample(range(39), 8) for w in (*item[k : k + 2], word(), word())] for _ in range(often)]
        texts = pa.array([" ".join([word(), *t, word()]) for t in (item, item, edited, *others)])
        block = Block([(0, " ".join(item))], p["n"])
        counts = np.bincount(block.count(texts), minlength=len(block.keys))
        block.set_seeds(counts, len(texts), p["fan"])
        hits = {h[0] for h in block.hits(texts, p["threshold"], p["copied"])}
        assert hits >= {0, 1} and not hits & set(range(3, len(texts)))
        found += 2 in hits
    assert found >= 18


def test_short_items_are_asked_for_nearly_whole(spark):
    items = [(0, "alpha beta gamma delta"), (1, "what is two"), (2, "one two three four five six"), (3, "Eins zwei drei vier fünf sechs sieben")]
    docs = ["x y alpha beta q r", "alpha beta gamma", "says what is new", "what is, two?", "so alpha beta gamma delta", "one two three xx five six", "one two three four xx xx", "a one two three five six", "eins zwei drei vier", "eins zwei drei und vier fünf sechs sieben", "four five six"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(3, 1), (4, 0), (5, 2), (7, 2), (9, 3)]
    assert clean_documents(frame, spark.createDataFrame(items, "item_id long, text string")).count() == len(docs) - 5


def test_decontamination_like_all_pairs(spark):
    """Every document is aligned to every item whole; hits are the pairs that reach the threshold, 9 of 10 of them at least."""
    from foliant.llm.decontaminate import words_of
    import pyarrow as pa

    rng = random.Random(44)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=4))
    common = [word() for _ in range(60)]
    fill = lambda n: [rng.choice(common) for _ in range(n)]
    items = [[word() if rng.random() < 0.6 else rng.choice(common) for _ in range(rng.choice([12, 30, 60, 400]))] for _ in range(25)]
    items += [["zwei", "worte"], ["einzeln"]]
    docs = []
    for i in range(150):
        item, rate = items[rng.randrange(25)], rng.choice([0.0, 0.1, 0.2, 0.3])
        part = item if len(item) < 100 else item[(a := rng.randrange(300)) : a + rng.choice([30, 70])]
        copy = [w for w in (rng.choice(common) if rng.random() < rate else w for w in part) if rng.random() > rate / 4]
        docs.append(fill(rng.randrange(40)) + (copy if i % 3 else []) + fill(rng.randrange(40)))
    docs += [["ein", "zwei", "worte", "drei"], ["zwei", "andere", "worte"], ["einzeln"], ["vereinzeln"]]
    ids: dict[int, int] = {}
    coded = [np.array([ids.setdefault(int(h), len(ids) + 1) for h in words_of(pa.array([" ".join(x)]))[1]], np.int32) for x in (*items, *docs)]
    want = set()
    for k, item in enumerate(coded[: len(items)]):
        for d, doc in enumerate(coded[len(items) :]):
            if len(item) < 3:
                found = any(np.array_equal(doc[a : a + len(item)], item) for a in range(len(doc) - len(item) + 1))
            else:
                found = len(doc) and smith_waterman(item[None], doc[None])[0][0] >= min(len(item), 100)
            if found:
                want.add((d, k))
    frame = lambda xs, name: spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(xs)], f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got <= want and len(want) > 60 and len(got) >= 0.9 * len(want)
    assert {p for p in want if p[1] >= 25} == {(150, 25), (152, 26)} <= got


def test_words_with_signs_beyond_ascii():
    import pyarrow as pa

    from foliant.llm.decontaminate import words_of

    owner, value = words_of(pa.array(["Ärger—“ÉTÉ”, naïve\u00a0x_1", None, "ärger été NAÏVE X_1 漢字!", ""]))
    assert owner.tolist() == [0, 0, 0, 0, 2, 2, 2, 2, 2] and value[:4].tolist() == value[4:8].tolist()


def test_texts_are_read_like_plain_python():
    import math

    import pyarrow as pa

    from foliant.llm import shingles
    from foliant.llm.cotraining import read_texts

    rng = random.Random(12)
    texts = ["".join(rng.choices(["a", "B", "c9", " ", "\n", ".", "word ", "UP ", "up ", "é", "\t", "longerword "], k=rng.randint(0, 60))) for _ in range(300)] + ["", " ", None, "x " * 300]
    for piece in (40, 1 << 20):
        shingles.pieces.__defaults__ = (piece,)
        read = read_texts(pa.array(texts))
        for k, text in enumerate(texts):
            words, lines = re.findall(r"[^ \t\n\r\v\f]+", text or ""), [x for x in (text or "").split("\n") if x]
            n, raw = len(words), (text or "").encode()
            if not n:
                assert not read.shapes[k].any()
                continue
            solid = sum(len(w.encode()) for w in words)
            lower = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
            want = [math.log(n), solid / n, sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words) / n, sum(bool(re.fullmatch("[A-Za-zé]+", w)) for w in words) / n, sum(w[-1] == "." for w in words) / n, sum(map(str.__eq__, lower, lower[1:])) / n, len(set(lower)) / n, len(set(lines)) / max(1, len(lines)), 1 - solid / len(raw)]
            shape = read.shapes[k].tolist()
            if piece < 100 and len(raw) > piece:  # words and lines are cut apart at pieces
                want[5:8] = shape[5:8]
            assert shape == pytest.approx(want, abs=1e-5)
            found = re.findall(r"[a-z0-9é]+", " ".join(lower)) if piece > 100 else None
            if found is not None:
                assert len(set(read.words[read.owner == k].tolist())) == len({*found, *(("s", w.encode()[:j]) for w in found if len(w.encode()) > 5 for j in (4, 5))})
    shingles.pieces.__defaults__ = (shingles.PIECE,)


def test_words_chosen_like_brute_force(spark):
    from foliant.llm import cotraining

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["one", "two", "three"], k=8) + (["awful"] if i % 4 == 0 else []) + (["rare"] if i == 4 else []))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "s", "l", 1) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    place = cotraining.choose_words(cotraining._source(docs, "doc_id"), cotraining._marks(labels))
    import pyarrow as pa

    word = lambda w: int(cotraining.read_texts(pa.array([w])).words[0])
    assert place[word("awful")] >= 0 and all(place[word(w)] < 0 for w in ("one", "two", "three", "rare")) and place.max() == 0


def plain_tree(text):
    """Levels of nodes and root by loops over bytes."""
    M = (1 << 64) - 1
    k = 0x9E3779B97F4A7C15

    def mix(x):
        x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & M
        x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & M
        return x ^ (x >> 33)

    data, phrases, start = text + b"\n", [], 0
    for i in range(len(data)):
        h, line = 0, data.rfind(b"\n", 0, i) + 1
        for x in data[max(0, i - 5) : i + 1]:
            h = (h * 0x01000193 + x) & 0xFFFFFFFF
        if data[i] == 10 or i - line >= 5 and (h * 0x9E3779B1 & 0xFFFFFFFF) >> 20 & 15 == 0:
            part = data[start : i + 1]
            phrases.append((mix((sum((x + 1) * pow(k, j + 1, 1 << 64) for j, x in enumerate(part)) + len(part) * k) & M), part))
            start = i + 1
    up = lambda xs: mix((sum(mix(x) * pow(k, j + 1, 1 << 64) for j, x in enumerate(xs)) + len(xs)) & M)

    def grouped(nodes, ends):
        out, own = [], []
        for n, end in zip(nodes, ends):
            own.append(n)
            if end:
                out, own = [*out, own], []
        return [*out, own] if own else out

    in_line, ends = 0, []
    for value, part in phrases:
        ends.append(part[-1] == 10 or in_line >= 64 and value % 32 == 0)
        in_line = 0 if part[-1] == 10 else in_line + 1
    groups = grouped(phrases, ends)
    levels = [[v for v, _ in phrases], [up([v for v, _ in g]) for g in groups]]
    ends = [len(g) == 1 and g[0][1] == b"\n" or v % 8 == 0 for g, v in zip(groups, levels[1])]
    while len(levels) < 8:
        levels.append([up(g) for g in grouped(levels[-1], ends)])
        ends = [v % 8 == 0 for v in levels[-1]]
    import xxhash

    return levels, xxhash.xxh3_128(b"".join(v.to_bytes(8, "little") for v in levels[2]) + text).hexdigest()


def test_trees_and_likeness_like_plain_loops():
    rng = random.Random(6)
    texts = [b"", b"a", b"\n\n", b"one line", "é漢字 ".encode() * 40] + ["\n".join(" ".join("".join(rng.choices("abcdef", k=4)) for _ in range(rng.choice([0, 3, 12, 400]))) for _ in range(rng.randint(1, 30))).encode() for _ in range(12)]
    texts += [t[: len(t) // 2] + b"changed" + t[len(t) // 2 :] for t in texts[5:]] + [texts[7]]
    found, marks = merkle.trees(texts), []
    for text, tree in zip(texts, found):
        levels, root = plain_tree(text)
        assert [x.tolist() for x in tree.levels] == levels and tree.root == root
        marks.append(merkle.fingerprint(tree))
        again = merkle.from_string(merkle.as_string(marks[-1]))
        assert (again.root, again.phrases, again.finest) == (root, marks[-1].phrases, marks[-1].finest) and all(np.array_equal(x, y) for x, y in zip((again.lowest, *again.levels), (marks[-1].lowest, *marks[-1].levels)))
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            a, b = ({int(v) >> 32 for v in found[n].levels[0]} for n in (i, j))
            want, got = 2 * len(a & b) / (len(a) + len(b)), merkle.likeness(marks[i], marks[j])
            exact = max(len(a), len(b)) <= merkle.NODES and a != b
            assert got == pytest.approx(want) if exact else abs(got - want) < 0.1
            assert (got == 1.0) == (x == y)


@pytest.mark.parametrize("kind", ["word a line", "one word", "a third"])
def test_likeness_is_steady_in_length(kind):
    """The same kind of edit gets the same answer on both sides of the number of phrases that a fingerprint holds."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    got = []
    for n in (20, 60, 100, 130, 160, 250, 400, 1500):
        lines = [[word() for _ in range(9)] for _ in range(n)]
        edited = [list(x) for x in lines]
        if kind == "word a line":
            for x in edited:
                x[4] = word()
        elif kind == "one word":
            edited[n // 2][4] = word()
        else:
            edited[n - n // 3 :] = [[word() for _ in range(9)] for _ in range(n // 3)]
        x, y = (["\n".join(" ".join(w) for w in t).encode()] for t in (lines, edited))
        (a,), (b,) = merkle.trees(x), merkle.trees(y)
        p, q = set(a.levels[0].tolist()), set(b.levels[0].tolist())
        found = merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b))
        assert found < 1 and abs(found - 2 * len(p & q) / (len(p) + len(q))) < 0.06
        got.append(found)
    assert max(got) - min(got) < 0.12 and (kind != "one word" or min(got) > 0.97 or got[0] > 0.9)


def test_differences_lists_every_range():
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(9))
    for _ in range(40):
        lines = [line() if rng.random() < 0.9 else "" for _ in range(120)]
        changed, want, shift = list(lines), [], 0
        for at in sorted(rng.sample(range(3, 115, 8), 3)):
            kind = rng.choice(["change", "delete", "insert"])
            new = {"change": [line()], "delete": [], "insert": [line(), lines[at]]}[kind]
            changed[at + shift : at + shift + 1] = new
            shift += len(new) - 1
        ranges = merkle.differences("\n".join(lines).encode(), "\n".join(changed).encode())
        rebuilt, i = [], 0
        for a, b, c, d in ranges:
            rebuilt += lines[i:a] + changed[c:d]
            i = b
            want.append((b - a) + (d - c))
        assert rebuilt + lines[i:] == changed and sum(want) <= 12


def test_pipeline_stages_like_their_operators(spark):
    """What each stage keeps, against brute force or the operator's own decisions, and the last one against the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from foliant.llm.near_duplicates import near_duplicate_classes

    folder = "/root/testdata/sf0.001"
    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = stages["quality"](spark, docs, folder).persist()
    assert ids(good) == ids(score_documents(docs, labels).where("keep"))
    single = stages["near_duplicates"](spark, good, folder).persist()
    classes = {r.doc_id: r.class_id for r in near_duplicate_classes(good).collect()}
    assert ids(single) == sorted(set(classes.values()))
    clean = stages["decontamination"](spark, single, folder).persist()
    assert ids(clean) == sorted(set(ids(single)) - {r.doc_id for r in contaminated(single, benchmark).collect()})
    mixed = stages["mixing"](spark, clean, folder).persist()
    taken = {r.doc_id: (int(2 * r.first_words >= r["size"] > 0) + int(2 * r.second_words >= r["size"] > 0)) for r in mix(clean).collect()}
    assert ids(mixed) == sorted(i for i, n in taken.items() for _ in range(n))
    texts, library = {r.doc_id: r.text for r in docs.collect()}, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for row in sorted(stages["tokens"](spark, mixed, folder).collect(), key=lambda r: r.start):
        own = np.array([*library.encode(texts[row.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
