"""Every stage of the pipeline, each on what the one before kept, against plain code."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from foliant.llm.common import table
from foliant.llm.cotraining import score_documents
from foliant.llm.decontaminate import smith_waterman, words_of
from foliant.llm.mixing import source_targets
from test_duplicates import brute_classes

FOLDER = "/root/testdata/sf0.001"


def coded(texts):
    import pyarrow as pa

    ids = {}
    owner, value = words_of(pa.array(texts))
    out = [[] for _ in texts]
    for o, v in zip(owner.tolist(), value.tolist()):
        out[o].append(ids.setdefault(v, len(ids) + 1))
    return [np.array(x, np.int32) for x in out]


def needed(n):
    """The least score for an item of n words, from three on."""
    return 2 * n if n < 5 else 2 * n - 3 if n < 8 else min(n, 100)


def test_stages_like_plain_code(spark):
    docs = table(spark, FOLDER, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in p.quality(spark, docs, FOLDER).collect()}
    assert good == {r.doc_id for r in score_documents(docs, table(spark, FOLDER, "labels")).collect() if r.keep}

    kept = docs.where(docs.doc_id.isin(sorted(good)))
    single = {r.doc_id for r in p.near_duplicates(spark, kept, FOLDER).collect()}
    listed = [(i, rows[i].text) for i in sorted(good)]
    classes = defaultdict(set)
    for (i, _), k in zip(listed, brute_classes(listed)):
        classes[k].add(i)
    assert single == {min(own) for own in classes.values()} and len(single) < len(good)

    kept = docs.where(docs.doc_id.isin(sorted(single)))
    clean = {r.doc_id for r in p.decontamination(spark, kept, FOLDER).collect()}
    items = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    words = coded([*items, *(rows[i].text or "" for i in sorted(single))])
    leaked = set()
    for i, text in zip(sorted(single), words[len(items) :]):
        wide = [w for w in words[: len(items)] if len(w) >= 3]
        if len(text) and any(smith_waterman(w[None], text[None])[0][0] >= needed(len(w)) for w in wide):
            leaked.add(i)
    assert not (single - clean) - leaked and len(leaked & clean) <= 0.1 * len(leaked)

    kept = docs.where(docs.doc_id.isin(sorted(clean)))
    mixed = p.mixing(spark, kept, FOLDER).collect()
    size = {i: len((rows[i].text or "").split()) for i in clean}
    targets = source_targets(spark.createDataFrame([(rows[i].source, size[i]) for i in clean], "source string, size long")).collect()
    taken, largest = Counter(), Counter()
    for r in mixed:
        taken[r.source] += size[r.doc_id]
    for i in clean:
        largest[rows[i].source] = max(largest[rows[i].source], size[i])
    assert {r.doc_id for r in mixed} <= clean and max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert all(abs(taken[t.source] - t.target) <= largest[t.source] for t in targets)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = spark.createDataFrame([tuple(r) for r in mixed], docs.schema)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in p.tokens(spark, last, FOLDER).collect())
    want, start = [], 0
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    run = p.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run) == got
