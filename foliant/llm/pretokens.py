"""Token ids of texts by their white-space words, for `tokenizers` files.

A vocabulary whose pre-tokenizer drops white space (``word_bpe_49k.json``) encodes every word on its own, so texts are
split at ASCII white space by Arrow, equal words of a batch are encoded once, and ids are dealt back by word. Words
of ASCII signs and Latin-1 letters, nearly all, go through `tiktoken`'s merges, which get the file's merges as ranks;
others, and any sign whose class or lower case might be in doubt, go to the library itself. Files of any other make are
encoded by the library text by text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer words are encoded by the library and never cached.
LONGEST_KEPT = 64
#: The make of files that is encoded by words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [("NFC", None), ("Replace", " "), ("Lowercase", None)]
#: Words that the merges take: visible ASCII but apostrophes, and Latin-1 letters. Their units are runs of one class of
#: signs, digits being units of their own.
_PLAIN = rf"^[!-&(-~À-ÖØ-öø-ÿ]{{1,{LONGEST_KEPT}}}$"
_SPECIAL_SIGN = "<|"
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[10, *range(48, 58), *range(97, 123), *range(128, 256)]] = [0] + [2] * 10 + [1] * (26 + 128)

_loaded: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encoder of one tokenizer file, kept as long as the Python worker lives."""

    def __init__(self, path: str, bound: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        highest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.width = np.dtype("<u2" if highest < 1 << 16 else "<u4")
        self.words, self.lengths = pa.array([], pa.string()), np.zeros(0, np.int64)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_words = _splits_at_space(made)
        if self.by_words:
            self._set_merges(made)

    def _set_merges(self, made: dict) -> None:
        """Ranks over bytes: a unit ends with a zero byte, which is merged with the byte before it first of all."""
        import tiktoken

        vocab, byte_of = made["model"]["vocab"], _bytes_of_letters()
        letter_of = {b: x for x, b in byte_of.items()}
        ranks, ids = {}, []

        def add(key: bytes, token: int) -> None:
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(token)

        for b in range(1, 256):
            add(bytes([b, 0]), vocab[letter_of[b] + "</w>"])
        for b in range(256):
            add(bytes([b]), vocab[letter_of[b]])
        for pair in made["model"]["merges"]:
            token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
            body = token.removesuffix("</w>")
            add(bytes(map(byte_of.__getitem__, body)) + b"\0" * (token != body), vocab[token])
        self.ids_of_ranks = np.array(ids, self.width)
        self.ends_unit = np.zeros(len(ids), bool)
        self.ends_unit[[rank for key, rank in ranks.items() if key[-1] == 0 and len(key) > 1]] = True
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for words that the merges take: their units, each ended by a zero byte, as one string."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pc.utf8_lower(words)), "\n")[0].as_py()
        data = np.frombuffer(joined.encode() + b"\n", np.uint8)
        kind = _CLASS[data]
        last = np.flatnonzero(((kind[:-1] != kind[1:]) | (kind[:-1] == 2)) & (kind[:-1] > 0))  # of each unit
        keep = kind > 0
        step = keep.astype(np.int32)  # a unit's last byte takes its zero byte with it
        step[last] = 2
        upto = np.cumsum(step, dtype=np.int64)
        marked = np.zeros(int(upto[-1]), np.uint8)
        marked[(upto - step)[keep]] = data[keep]
        ranks = self.merges.encode_to_numpy(marked.tobytes().decode(), disallowed_special=())
        unit_ends = np.flatnonzero(self.ends_unit[ranks]) + 1
        units = np.searchsorted(last, np.flatnonzero(kind == 0))  # of all words up to each
        return self.ids_of_ranks[ranks], np.diff(unit_ends[units - 1], prepend=0)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, _SPECIAL_SIGN))
        taken = words.filter(plain)
        ids, counts = self._plain(taken) if len(taken) else (np.zeros(0, self.width), np.zeros(0, np.int64))
        if len(taken) == len(words):
            return ids, counts
        others = [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        is_plain, size = plain.to_numpy(zero_copy_only=False), np.zeros(len(words), np.int64)
        size[is_plain], size[~is_plain] = counts, [len(x) for x in others]
        out, of_plain = np.zeros(int(size.sum()), self.width), np.repeat(is_plain, size)
        out[of_plain], out[~of_plain] = ids, np.concatenate(others)
        return out, size

    def document_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; nulls have none."""
        texts = texts.fill_null("")
        if not self.by_words:
            found = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate([*found, np.zeros(0, self.width)]), np.array([len(x) for x in found], np.int64)
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        ids, counts = self.encode(each.dictionary)
        offsets = np.concatenate(([0], np.cumsum(counts * self.width.itemsize))).astype(np.int32)
        known = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
        dealt = known.take(each.indices)
        _, at, data = dealt.buffers()
        at = np.frombuffer(at, np.int32, len(dealt) + 1) if at is not None and at.size else np.zeros(1, np.int32)
        size = np.diff(at[np.asarray(words.offsets) - words.offsets[0].as_py()]).astype(np.int64) // self.width.itemsize
        n = int(size.sum())
        return np.frombuffer(data, self.width, n) if n else np.zeros(0, self.width), size

    def _lengths(self, words: pa.Array, frequent: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Number of ids of each of some distinct words.

        Words come from the table of frequent ones, else from the worker's cache; what neither has is encoded and cached.
        A cache that grows over its bound begins anew with the words at hand.
        """
        out = np.full(len(words), -1, np.int64)
        for known, numbers in ((frequent, sizes), (self.words, self.lengths)):
            open_at = np.flatnonzero(out < 0)
            at = pc.index_in(words.take(pa.array(open_at)), value_set=known).fill_null(-1).to_numpy()
            out[open_at[at >= 0]] = numbers[at[at >= 0]]
        missed = np.flatnonzero(out < 0)
        new = words.take(pa.array(missed))
        out[missed] = lengths = self.encode(new)[1]
        short = pc.less_equal(pc.utf8_length(new), LONGEST_KEPT)
        new, lengths = new.filter(short), lengths[short.to_numpy(zero_copy_only=False)]
        if len(self.words) + len(new) > self.bound:
            self.words, self.lengths = new[: self.bound], lengths[: self.bound]
        else:
            self.words, self.lengths = pa.concat_arrays([self.words, new]), np.concatenate((self.lengths, lengths))
        return out

    def document_lengths(self, texts: pa.Array, frequent: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Number of ids of each text: the frequent words' table first, then the worker's cache, then the merges."""
        texts = texts.fill_null("")
        if not self.by_words:
            return np.array([len(self.whole(t)) for t in texts.to_pylist()], np.int64)
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        lengths = self._lengths(each.dictionary, frequent, sizes)
        total = np.concatenate(([0], np.cumsum(lengths[each.indices.to_numpy()])))
        return np.diff(total[np.asarray(words.offsets) - words.offsets[0].as_py()])


def _splits_at_space(made: dict) -> bool:
    """Whether a tokenizer file drops white space between units, and makes its units by ``_SPLIT`` and byte merges."""
    model, normal, before = made.get("model") or {}, made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
    steps, units = normal.get("normalizers") or [], before.get("pretokenizers") or []
    return (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and [(s.get("type"), s.get("content")) for s in steps] == _NORMALIZERS
        and [u.get("type") for u in units] == ["Split", "ByteLevel"] and units[0].get("pattern") == {"Regex": _SPLIT} and units[0].get("behavior") == "Removed" and units[0].get("invert") is True
        and not units[1].get("add_prefix_space") and not units[1].get("use_regex")
        and all(x["content"].startswith(_SPECIAL_SIGN) and not re.search(r"\s", x["content"]) and not x["lstrip"] and not x["rstrip"] for x in made.get("added_tokens") or [])
    )


def _bytes_of_letters() -> dict[str, int]:
    """The byte behind each letter of byte-level vocabularies: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(others)}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
