"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark's words."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import plain, table, without

#: Words are runs of digits, letters and non-ASCII bytes, A-Z lower-cased.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: Benchmark words that one automaton takes (a node and a vocabulary entry each at most, some 250 bytes in all); a
#: larger benchmark is split over several passes.
AUTOMATON_WORDS = 1 << 20
NEW = ("n_words", "n_hit", "items", "spans", "contaminated")
_RUNS, _SEEN = "__tessera_runs", "__tessera_seen"


def fold(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


class Automaton:
    """Aho-Corasick over sequences of numbers from 1 to ``symbols``: one table of transitions, for alphabets of any size."""

    def __init__(self, patterns: Iterable[tuple[int, ...]], symbols: int):
        self.width = width = symbols + 1
        self.go: dict[int, int] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        parent, symbol, levels = array("I", [0]), array("I", [0]), []
        for pattern in patterns:
            state = 0
            for depth, w in enumerate(pattern):
                key = state * width + w
                state = self.go.get(key, 0)
                if not state:
                    state = self.go[key] = len(parent)
                    parent.append(key // width)
                    symbol.append(w)
                    if depth == len(levels):
                        levels.append(array("I"))
                    levels[depth].append(state)
            self.ends[state] = pattern
        self.fail = array("I", bytes(4 * len(parent)))
        #: The longest pattern that ends in a state: its own or that of a shorter suffix; and the next shorter one.
        self.found = array("I", bytes(4 * len(parent)))
        for level in levels:
            for state in level:
                back = self.fail[parent[state]] if parent[state] else None
                while back is not None:
                    to = self.go.get(back * width + symbol[state])
                    if to is not None:
                        self.fail[state] = to
                        break
                    back = self.fail[back] if back else None
                self.found[state] = state if state in self.ends else self.found[self.fail[state]]

    def matches(self, seq: Iterable[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Every occurrence of a pattern: the index after it, and the pattern.  A 0 matches nothing."""
        go, fail, found, width = self.go, self.fail, self.found, self.width
        state = 0
        for i, w in enumerate(seq, 1):
            if not w:
                state = 0
                continue
            while True:
                to = go.get(state * width + w)
                if to is not None:
                    state = to
                    break
                if not state:
                    break
                state = fail[state]
            end = found[state]
            while end:
                yield i, self.ends[end]
                end = found[fail[end]]


class Matcher:
    """An Aho-Corasick automaton over words that finds every occurrence of an item's windows.

    Whatever holds a window of ``window`` consecutive item words holds one of the item's blocks of ``(window + 1) // 2``
    words that begin at its multiples, so blocks are the patterns, a state a word, and a found block is widened to the
    whole run of equal words.  An item of fewer words than a window is a pattern of its own.  Items of equal words are
    one text with several ids.
    """

    def __init__(self, items: Iterable[tuple[str, str]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        texts: dict[bytes, set[str]] = {}
        for item, text in items:
            words = fold(text).split()
            if words:
                texts.setdefault(b" ".join(words), set()).add(item)
        block = (window + 1) // 2
        self.ids: list[tuple[str, ...]] = []
        self.words: list[array] = []
        self.places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for line, own in texts.items():
            n = array("I", (self.number.setdefault(w, len(self.number) + 1) for w in line.split()))
            k = len(self.words)
            self.words.append(n)
            self.ids.append(tuple(sorted(own)))
            for i in range(0, len(n) - block + 1, block) if len(n) >= window else (0,):
                self.places.setdefault(tuple(n[i : i + block]) if len(n) >= window else tuple(n), []).append((k, i))
        self.automaton = Automaton(self.places, len(self.number))

    def scan(self, text: str) -> tuple[int, list[int], set[str]]:
        """Words of the text, hit word ranges (start, end, start, end, ...; disjoint, ascending) and items found."""
        words = fold(text).split()
        number = self.number
        if not words or not number:
            return len(words), [], set()
        doc = [number.get(w, 0) for w in words]
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        done: dict[tuple[int, int], int] = {}
        for end, pattern in self.automaton.matches(doc):
            first = end - len(pattern)
            for k, at in self.places[pattern]:
                item = self.words[k]
                if len(item) < self.window:
                    found.append((first, end))
                    items.update(self.ids[k])
                    continue
                if done.get((k, first - at), 0) >= end:  # a run already widened over this block
                    continue
                lo, i = first, at
                while lo and i and doc[lo - 1] == item[i - 1]:
                    lo, i = lo - 1, i - 1
                hi, j = end, at + len(pattern)
                while hi < len(doc) and j < len(item) and doc[hi] == item[j]:
                    hi, j = hi + 1, j + 1
                done[k, first - at] = hi
                if hi - lo >= self.window:
                    found.append((lo, hi))
                    items.update(self.ids[k])
        return len(words), _joined(found), items


def _joined(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for x, y in sorted(spans):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


_MADE: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[str, str]], window: int) -> Matcher:
    """Built once in a worker."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Matcher(items, window)
    return _MADE[key]


def original_spans(text: str, runs: list[int]) -> list[dict[str, int]]:
    """Code-point spans in the text of word ranges."""
    raw = np.frombuffer(fold(text), np.uint8)
    word = raw != 0x20
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    ends = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    source = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    points = np.concatenate([[0], np.cumsum((source & 0xC0) != 0x80)])
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(runs[::2], runs[1::2], strict=True)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 13, share: int = 20, automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Mark the words of whole documents that lie in any occurrence of a benchmark window.

    Adds ``n_words``, ``n_hit``, ``items`` (sorted ids of the items with occurring windows), ``spans`` (code-point
    ranges of hit text, ends exclusive) and ``contaminated`` (``n_hit > 0`` and ``share * n_hit >= n_words``); these
    replace columns of the same names.  A null or empty text has no words and no hits.  Items with a null id, or
    without words, match nothing; items that share an id count as one.  Repeated rows are each scanned.  An empty
    benchmark hits nothing.  No row moves between executors; one automaton takes about ``automaton_words`` words, and a
    benchmark of more is sent out in several passes over the documents.
    """
    spark = docs.sparkSession
    docs = without(docs, NEW)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    passes = max(1, -(-size // automaton_words))
    out = docs
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        out = _pass(spark, out, [tuple(r) for r in part.collect()], docs.schema, text_col, window, share, k == 0, k == passes - 1)
    return out


def _pass(spark, docs, items, kept: T.StructType, text_col, window, share, first: bool, final: bool) -> DataFrame:
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    names = kept.fieldNames()
    if final:
        more = T.StructType.fromDDL("n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>, contaminated boolean")
    else:
        more = T.StructType.fromDDL(f"{_RUNS} array<bigint>, {_SEEN} array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, sent.value, window)
        for b in batches:
            texts = plain(b.column(names.index(text_col)))
            rows = []
            old = [([], [])] * b.num_rows if first else zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True)
            for text, (runs0, seen0) in zip(texts, old, strict=True):
                text = text.as_py()
                n, runs, seen = matcher.scan(text)
                if runs0 or seen0:
                    runs, seen = _joined([*zip(runs0[::2], runs0[1::2], strict=True), *zip(runs[::2], runs[1::2], strict=True)]), seen | set(seen0)
                if final:
                    hit = sum(runs[1::2]) - sum(runs[::2])
                    rows.append((n, hit, sorted(seen), original_spans(text, runs) if runs else [], hit > 0 and share * hit >= n))
                else:
                    rows.append((runs, sorted(seen)))
            cols = list(zip(*rows, strict=True)) or [[] for _ in more]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()] if final else [pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*names, *more.fieldNames()])

    return docs.mapInArrow(run, T.StructType([*kept.fields, *more.fields]))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)
), hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hw ON w.doc_id = hw.doc_id LEFT JOIN hi ON w.doc_id = hi.doc_id
"""
