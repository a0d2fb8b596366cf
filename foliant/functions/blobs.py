"""Contents as older shards store them: zlib-compressed UTF-8, or plain text.

The column functions bound the batches of the session's Python workers by bytes, so memory doesn't grow with the sizes of texts.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import small_batches


def inflate(blob: bytes | str | None) -> str | None:
    if blob is None or isinstance(blob, str):
        return blob
    try:
        return zlib.decompress(blob).decode("utf-8")
    except (zlib.error, UnicodeDecodeError):
        return bytes(blob).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def _decompress_content(blobs: pd.Series) -> pd.Series:
    return blobs.map(inflate)


@F.pandas_udf(T.BinaryType())
def _compress_content(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else zlib.compress(t.encode("utf-8"), 9))


def readable(blob: bytes | str | None) -> str | None:
    """Like ``inflate``, but nothing for bytes that are neither packed nor plain UTF-8."""
    if blob is None or isinstance(blob, str):
        return blob
    try:
        raw = zlib.decompress(blob)
    except zlib.error:
        raw = bytes(blob)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


@F.pandas_udf(T.StringType())
def _readable_content(blobs: pd.Series) -> pd.Series:
    return blobs.map(readable)


_readable_content = _readable_content.asNondeterministic()  # evaluated once, though a filter and a selection ask for it


def decompress_content(blobs: Column | str) -> Column:
    small_batches(SparkSession.active())
    return _decompress_content(blobs)


def compress_content(texts: Column | str) -> Column:
    small_batches(SparkSession.active())
    return _compress_content(texts)


def readable_content(blobs: Column | str) -> Column:
    small_batches(SparkSession.active())
    return _readable_content(blobs)
