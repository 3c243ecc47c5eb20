"""Sequence packing: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import plain, stage, table

SEQUENCE = 2048
END_ID = 1


class Encoder:
    """Little-endian unsigned 32-bit ids of texts by a tokenizers file.

    A byte-level BPE whose merges rank as their ids do is run by tiktoken, which gives the same ids several times
    faster; other files, and texts that hold one of the file's added tokens, are run by tokenizers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        import public_tokenizers
        import tiktoken

        model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        plain_bytes = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if model.get("type") != "BPE" or not plain_bytes or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.added}
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in merged or merged != sorted(merged) or any(c not in letter for t in vocabulary for c in t):
            return None
        ranks = {bytes(letter[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.asarray(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.added):
            return self.whole(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_MADE: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", sequence=SEQUENCE, end_id=END_ID, keep_ids=False) -> DataFrame:
    """A row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if asked for, ``ids``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.  Documents of more than
    ``sequence`` ids are cut at its multiples.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.LongType()))] if keep_ids else fields)
    end = np.asarray([end_id], "<u4").tobytes()
    width = 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _MADE:
            _MADE[tokenizer] = Encoder(tokenizer)
        encode = _MADE[tokenizer]
        for b in batches:
            texts = plain(b.column(1))
            for lo in range(0, len(texts), 256):
                at, rows = [], []
                for i, text in enumerate(texts[lo : lo + 256]):
                    ids = encode(text.as_py()) + end
                    for s in range(0, len(ids), width):
                        part = ids[s : s + width]
                        at.append(lo + i)
                        rows.append((s // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, *([np.frombuffer(part, "<u4")] if keep_ids else ())))
                cols = list(zip(*rows, strict=True))
                arrays = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:4])]
                if keep_ids:
                    arrays.append(pa.array([c.astype(np.int64) for c in cols[4]], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Packing patterns (count, lengths): lengths longest first, each into the emptiest open packs that have room."""
    open_: list[tuple[int, int, int, tuple]] = []  # (-room, serial, count, linked lengths)
    done: list[tuple[int, tuple]] = []
    serial = 0

    def put(room: int, count: int, pack: tuple) -> None:
        nonlocal serial
        if room == 0:
            done.append((count, pack))
        else:
            serial += 1
            heapq.heappush(open_, (-room, serial, count, pack))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            if not open_ or -open_[0][0] < length:
                # Open new packs; where several pieces fit in one, the packs come back as the emptiest ones.
                each = max(1, capacity // length)
                full, rest = divmod(n, each)
                if full:
                    pack: tuple = ()
                    for _ in range(each):
                        pack = (length, pack)
                    put(capacity - each * length, full, pack)
                if rest:
                    pack = ()
                    for _ in range(rest):
                        pack = (length, pack)
                    put(capacity - rest * length, 1, pack)
                break
            room, _, count, pack = heapq.heappop(open_)
            used = min(count, n)
            if count > used:
                put(-room, count - used, pack)
            put(-room - length, used, (length, pack))
            n -= used
    out = []
    for count, pack in [*done, *((c, p) for _, _, c, p in sorted(open_))]:
        lengths = []
        while pack:
            lengths.append(pack[0])
            pack = pack[1]
        out.append((count, lengths[::-1]))
    return out


def placements(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of intervals, ascending, with their first sequence and offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            found.setdefault(length, []).append((rank, base, offset))
            used[length] = rank + count
            offset += length
        base += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def ranked(parts: DataFrame, by: str, order: list[str], buckets: int) -> DataFrame:
    """Adds ``rank``, from 0 within each value of ``by``; a frequent value is counted in buckets, not in one task."""
    parts = parts.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = parts.groupBy(by, "__bucket").count()
    # A row per value and bucket: the running sum takes no more rows than buckets for a value.
    before = F.sum("count").over(Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(by, "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(*order))
    return parts.withColumn("__own", own).join(counts, [by, "__bucket"]).withColumn("rank", F.col("__own") - 1 + F.col("__before")).drop("__own", "__before", "__bucket")


def pack(docs: DataFrame, tokenizer: str, *, id_col="doc_id", text_col="text", sequence=SEQUENCE, end_id=END_ID, keep_ids=False) -> DataFrame:
    """Pack whole documents into sequences of at most ``sequence`` ids.

    Returns a row per piece: id (as ``doc_id``), ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset`` (and ``ids``).  An empty table gives no rows; repeated rows and null ids are packed
    as documents of their own.  Pieces of equal length are interchangeable: they take the places of their length by
    rank, in hash buckets of (id, start).
    """
    spark = docs.sparkSession
    parts = stage(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, sequence=sequence, end_id=end_id, keep_ids=keep_ids))
    # At most `sequence` rows reach the driver.
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(placements(shortest_pack_first(histogram, sequence)))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ranked(parts, "length", ["doc_id", "start", "ids_crc32"], buckets)
    kept = [n for n in parts.columns]
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows_ in np.split(order, edges) if len(order) else []:
                first, base, offset = at[int(length[rows_[0]])]
                k = np.searchsorted(first, rank[rows_], "right") - 1
                seq[rows_] = base[k] + rank[rows_] - first[k]
                off[rows_] = offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(seq), pa.array(off)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
