"""Helpers shared by the corpus operators: tables, staging, byte-level words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.staging import stage, unstage

__all__ = ["Words", "id_crc", "mix", "offsets", "plain", "shingles", "slices", "stage", "table", "unstage", "without"]

#: Bytes of text that one vectorised step takes at most (a longer text makes a step of its own).
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names) -> DataFrame:
    """``df`` less the columns that a result will add (results replace clashing inputs, in any letter case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def id_crc(col: str | Column) -> Column:
    """crc32 of an id written as text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary"))


def slices(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array whose bytes stay within ``limit`` (one row at least)."""
    off = offsets(texts)
    n, lo = len(texts), 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(texts.buffers()[1], dtype=kind) if texts.buffers()[1] is not None and len(texts) else np.zeros(1, kind)
    return raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def plain(col: pa.Array) -> pa.Array:
    """A text column with nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.fill_null("") if col.null_count else col


_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOW = np.arange(256, dtype=np.uint64)
_LOW[0x41:0x5B] += np.uint64(32)
_LOW += np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_P, _PINV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _POW[k] = a
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, A-Z lower-cased: byte spans, document index, 64-bit hash."""

    __slots__ = ("data", "doc", "ends", "first", "hash", "n_docs", "starts")

    def __init__(self, texts: pa.Array):
        off = offsets(texts)
        self.n_docs = len(texts)
        buf = texts.buffers()[2]
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        self.data = data
        n = len(data)
        word = _WORD[data]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        edge = off[:-1][off[:-1] < n]
        before[edge] = False
        edge = off[1:][off[1:] > 0] - 1
        after[edge] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        p, inv = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOW[data] * p[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * inv[self.starts] + (self.ends - self.starts).astype(np.uint64))


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word ``size``-grams and the first index of each document's; shorter documents give their whole sequence as one."""
    h, first = words.hash, words.first
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    last = np.repeat(first[1:], count)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for j in range(size):
        w = padded[at + j]
        w[at + j >= last] = 0
        out = (out ^ w) * _STEP[j % 5] + _STEP[(j + 1) % 5]
        out ^= out >> np.uint64(29)
    return mix(out), begin
