"""Language ID by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_crc, plain, table, without

#: Bounds of the training sample: bytes of a language's dictionary, made of pieces of so many bytes.
DICT_BYTES, PIECE_BYTES = 96 << 10, 1 << 10
#: A text is compressed in blocks of so many bytes, so that each meets the dictionary and not the text before it.
BLOCK_BYTES = 1024
LEVEL = 6
#: Zeros after each block: else one that hardly shrinks is stored as it is, under every language alike.
CARRIER = bytes(64)
#: Margins (second smallest less smallest, by second smallest) below this are rejected.
MIN_MARGIN = 0.004
NEW = ("lang_pred", "score", "rejected", "lang_sizes")


_ASCII, _OTHER = re.compile("[A-Za-z]"), re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return bool(_ASCII.search(text)) or (not text.isascii() and any(c.isalpha() for c in text))


def folded(text: str) -> bytes:
    """Lower-cased letters, with one space for each run of anything else: case and punctuation say nothing of language."""
    return (_OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


def pieces(docs: DataFrame, most: int, piece_bytes: int) -> DataFrame:
    """``lang, h, piece``: of each task's whole folded (lang, text) rows, each language's ``most`` distinct pieces of least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, bytes]] = {}
        limit: dict[str, int] = {}

        def prune(lang: str) -> None:
            least = sorted(held[lang])[:most]
            held[lang] = {h: held[lang][h] for h in least}
            if len(least) == most:
                limit[lang] = least[-1]

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if not has_letter(text):
                    continue
                raw, own = folded(text), held.setdefault(lang, {})
                bound = limit.get(lang, 1 << 63)
                for i in range(0, len(raw), piece_bytes):
                    piece = raw[i : i + piece_bytes]
                    h = xxhash.xxh3_64_intdigest(piece) >> 1
                    if h < bound:
                        own[h] = piece
                if len(own) > 8 * most:
                    prune(lang)
        for lang in sorted(held):
            prune(lang)
            if held[lang]:
                h, found = zip(*held[lang].items(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h, pa.int64()), pa.array(found, pa.binary())], names=["lang", "h", "piece"])

    return docs.mapInArrow(run, "lang string, h bigint, piece binary")


def train(labelled: DataFrame, *, text_col="text", lang_col="lang", dict_bytes=DICT_BYTES, piece_bytes=PIECE_BYTES) -> dict[str, bytes]:
    """One raw-content dictionary per language, from a bounded sample of labelled rows.

    Whole texts are cut into pieces of ``piece_bytes``, and a language's dictionary takes its ``dict_bytes /
    piece_bytes`` distinct pieces of least hash, so copies count once and every part of a text counts alike.  Rows
    with a null language or text, or without letters, are not used.  A task sends on as many pieces as a dictionary
    takes, and the least of them are found in two steps, the first split by hash; only dictionaries reach the driver.
    """
    most = max(1, dict_bytes // piece_bytes)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    found = pieces(rows, most, piece_bytes).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    salts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for by in (["lang", F.pmod("h", F.lit(salts))], ["lang"]):
        found = found.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("__n") <= most).drop("__n")
    got: dict[str, list[tuple[int, bytes]]] = {}
    for r in found.collect():
        got.setdefault(r.lang, []).append((r.h, bytes(r.piece)))
    return {lang: b"".join(piece for _, piece in sorted(own)) for lang, own in sorted(got.items())}


_MADE: dict[str, list[tuple[str, zstandard.ZstdCompressor]]] = {}


def _coders(key: str, dicts: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    if key not in _MADE:
        _MADE.clear()
        made = []
        for lang, blob in dicts.items():
            d = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _MADE[key] = made
    return _MADE[key]


def sizes(text: str, coders) -> list[int]:
    """Compressed bytes of the whole folded text under each language."""
    raw = folded(text)
    blocks = [raw[i : i + BLOCK_BYTES] + CARRIER for i in range(0, len(raw), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for _, c in coders]


def decide(text: str, coders, min_margin: float) -> tuple[str, float, bool, list[int]]:
    if not coders or not has_letter(text):
        return "und", 0.0, True, []
    found = sizes(text, coders)
    order = sorted(range(len(found)), key=lambda i: (found[i], coders[i][0]))
    best = coders[order[0]][0]
    if len(order) == 1:
        return best, 1.0, False, found
    a, b = found[order[0]], found[order[1]]
    margin = (b - a) / b
    return best, margin, margin < min_margin, found


def identify(docs: DataFrame, dicts: dict[str, bytes], *, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (the margin, 0 to 1), ``rejected`` and ``lang_sizes`` to documents.

    ``lang_pred`` is ``und``, with score 0 and rejected, for a null text or one without letters, or if there are no
    dictionaries.  Margins under ``min_margin`` keep their language and are rejected.  Equal sizes go to the first
    language by name.  The new columns replace those of the same names; each repeated row gets its result.  A long
    text is compressed in blocks, each beside the dictionary alone.
    """
    docs = without(docs, NEW)
    names = docs.columns
    sent, key = docs.sparkSession.sparkContext.broadcast(dicts), uuid.uuid4().hex
    more = T.StructType.fromDDL("lang_pred string, score double, rejected boolean, lang_sizes array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(key, sent.value)
        for b in batches:
            rows = [decide(t.as_py(), coders, min_margin) for t in plain(b.column(names.index(text_col)))]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*names, *more.fieldNames()])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more.fields]))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id has no remainder: its row is not held out and, its remainder unknown, trains nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False))
    dicts = train(docs.where(id_crc("doc_id") % 4 != 2))
    return identify(docs.select("doc_id", "text"), dicts).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
