"""Arrow batches in tasks: slices of bounded bytes, and places of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each, one row at least."""
    for batch in batches:
        start, n, size = 0, batch.num_rows, batch.column(column).nbytes
        if size <= max_bytes or n == 1:
            if n:
                yield batch
            continue
        total = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)), dtype=np.int64)
        while start < n:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def token_places(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray, pa.ListArray]:
    """(row, token, places) of every distinct token of every text; tokens stand between single spaces."""
    split = pc.split_pattern(pc.utf8_trim(texts.fill_null(""), " "), " ")
    offsets = np.asarray(split.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    each = split.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    place = np.arange(len(row)) - offsets[:-1][row]
    kept = np.flatnonzero(pc.not_equal(each, "").to_numpy(zero_copy_only=False)) if len(each) else np.zeros(0, np.int64)
    key = row[kept] * max(1, len(each.dictionary)) + each.indices.to_numpy()[kept]
    order = np.argsort(key, kind="stable")
    key, at = key[order], kept[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[at], pa.int32()))
    row, code = np.divmod(key[first], max(1, len(each.dictionary)))
    return row, pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), each.dictionary), lists


def joined(batches: Iterator[pa.RecordBatch], column: int = 1, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices put together until they have about ``max_bytes``, rows without a text included."""
    held, size = [], 0
    for part in slices(batches, column, max_bytes):
        held.append(part)
        size += part.nbytes
        if size >= max_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def by_token(tokens: pa.DictionaryArray, row: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The order of postings by token (as bytes) and the id of their row, nulls first; distinct tokens and rows are sorted, and postings by their ranks."""
    rank = np.empty(len(tokens.dictionary), np.int64)
    rank[pc.sort_indices(tokens.dictionary).to_numpy()] = np.arange(len(rank))
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((ids.fill_null(0).to_numpy(), known))] = np.arange(len(ids))
    key = rank[tokens.indices.to_numpy()]
    key *= max(1, len(ids))
    key += place[row]
    return np.argsort(key, kind="stable")


def posting_runs(batches: Iterator[pa.RecordBatch], run_bytes: int = 8 << 20, slice_bytes: int = 512 << 10) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray, pa.ListArray]]:
    """(rows, row, token, places) of about ``run_bytes`` of rows at a time, of batches of (key, text, id); rows come without their texts.

    Texts are split by slices of ``slice_bytes``, whose lists of all words are the largest arrays here. Of a slice only its postings are kept,
    with tokens as codes, until they are a run.
    """
    held, size = [], 0
    for part in joined(batches, 1, slice_bytes):
        row, token, places = token_places(part.column(1))
        size += part.nbytes
        keys = pa.record_batch([pc.take(part.column(k), pa.array(np.arange(part.num_rows))) for k in (0, 2)], names=["key", "id"])  # copies: a slice keeps its batch
        held.append((keys, row.astype(np.int32), token, places))
        del part, row, token, places, keys
        if size >= run_bytes:
            yield _run(held)
            size = 0
    if held:
        yield _run(held)


def _run(held: list) -> tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray, pa.ListArray]:
    """Slices' postings as one run's; ``held`` is empty after that."""
    rows, row, token, places = (list(x) for x in zip(*held))
    held.clear()
    before = np.cumsum([0, *(r.num_rows for r in rows[:-1])], dtype=np.int32)
    tokens = pa.chunked_array(token).unify_dictionaries().combine_chunks()
    return pa.concat_batches(rows), np.concatenate([r + b for r, b in zip(row, before)]), tokens, pa.concat_arrays(places)
