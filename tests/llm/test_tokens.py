"""Token counts and token shards against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm.grammar import Shard, pack
from foliant.llm.token_counts import token_counts
from foliant.llm.token_shards import read_shards, token_shards, write_shards

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("table_size", [4, 65_536])
def test_counts(odd, odd_rows, sample, library, table_size):
    got = sorted(map(tuple, token_counts(odd, PATH, limit=100, table_size=table_size).collect()), key=str)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(ids_of(library, r[1])), n > 100) for r in odd_rows), key=str)
    assert got == want
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(sample, PATH, table_size=table_size).collect()} == {k: len(ids_of(library, t)) for k, t in texts.items()}


def test_nothing_to_count(none):
    assert token_counts(none, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and token_counts(none, PATH).count() == 0
    assert token_shards(none, PATH).count() == 0


def test_shards(odd, odd_rows, library):
    rows = sorted(map(tuple, token_shards(odd, PATH).collect()), key=lambda r: r[1])
    start = 0
    for row, want in zip(rows, sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))):
        ids = np.array([*ids_of(library, want[1]), 1], "<u4")
        assert row == (want[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(odd_rows)


@pytest.mark.parametrize("shard_ids", [1, 300, 1 << 20])
def test_any_shard_size_reads_the_same(spark, sample, tmp_path, shard_ids):
    write_shards(sample, PATH, str(tmp_path / "s"), shard_ids=shard_ids, parts=3)
    assert sorted(map(tuple, read_shards(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, token_shards(sample, PATH).collect()))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n_docs, letters in ((0, 3), (1, 2), (40, 2), (40, 30), (7, 1)):
        docs = [rng.integers(0, letters, int(rng.integers(0, 400))).astype(np.uint16) for _ in range(n_docs)]
        ids, ends = np.concatenate([*docs, np.zeros(0, np.uint16)]), np.cumsum([len(d) for d in docs], dtype=np.int64)
        shard = Shard(pack(ids, ends, 30))
        assert np.array_equal(shard.all_ids(), ids)
        for k, d in enumerate(docs):
            assert np.array_equal(shard.document(k), d)
            a, b = sorted(rng.integers(0, len(d) + 2, 2).tolist())
            assert np.array_equal(shard.document(k, a, b), d[a:b])
        if letters == 2 and n_docs > 1:
            assert len(shard.seq) < len(ids) / 3 and len(shard.rules)


SIGNS = [" ", "\n", "\x0b", "\x1c", "\x1d", "\x1f", "\x85", "\xa0", "\u3000", "\0", "\x01", "'", "'s", "'LL", "a", "B", "é", "É", "ß", "ÿ", "Ÿ", "ſ", "K", "Å", "Σ", "ΣΑΣ", "İ", "1", "²", "٣", "!", "?!", "<|endoftext|>", "<|", "|>", "漢", "😀", "\u0301", "e\u0301", "ª", "×", "\u200b", "the", "and"]


def test_any_signs_encode_as_in_the_library(library):
    import random

    import pyarrow as pa

    from foliant.llm.pretokens import encoder

    rng, e = random.Random(17), encoder(PATH)
    assert e.by_words
    texts = ["\x1f", " \x1c ", "a\x1fb", "", None, " ", "a" * 70, *("".join(rng.choices(SIGNS, k=rng.randint(0, 14))) for _ in range(5000))]
    want = [ids_of(library, t) for t in texts]
    ids, n = e.document_ids(pa.array(texts))
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    for bound in (0, 50, 10_000):
        e.bound = bound
        assert e.document_lengths(pa.array(texts), pa.array(["a", "the"]), np.array([1, 1])).tolist() == n.tolist()


def test_files_of_another_make_are_encoded_whole(library, tmp_path):
    import json

    import pyarrow as pa

    from foliant.llm.pretokens import WordEncoder

    made = json.load(open(PATH))
    made["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    (tmp_path / "other.json").write_text(json.dumps(made))
    e = WordEncoder(str(tmp_path / "other.json"))
    texts = ["a b  c", "", None, "the end"]
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, n = e.document_ids(pa.array(texts))
    assert not e.by_words and ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    assert e.document_lengths(pa.array(texts), pa.array([], pa.string()), np.zeros(0, np.int64)).tolist() == n.tolist()


def test_grammar_goes_on_until_nothing_pays():
    """A passage of 64 ids that many documents share ends as one symbol, and no frequent pair is left."""
    from collections import Counter

    from foliant.llm.grammar import compress

    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1000, 64)
    docs = [np.concatenate((rng.integers(0, 40_000, 20), passage, rng.integers(0, 40_000, 20))) for _ in range(200)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    rules, seq, seq_ends = compress(ids, ends, 40_000, gain=0)
    assert len(seq) <= 200 * 41 and Shard(pack(ids, ends, 40_000)).all_ids().tolist() == ids.tolist()
    pairs = Counter()
    for a, b in zip([0, *seq_ends[:-1].tolist()], seq_ends.tolist()):
        pairs.update(zip(seq[a : b - 1].tolist(), seq[a + 1 : b].tolist()))
    assert max(pairs.values()) < 6
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)
