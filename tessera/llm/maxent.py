"""LM scoring: a hashed maximum-entropy model of word classes, and each word's count within its class.

A token's class is predicted from n-gram and skip features of its history by one softmax, whose weights start at zero
and are trained by gradients alone: each task takes steps over its documents, and weights are averaged between rounds.
A token within its class has its smoothed share of the class's count.  Frequent tokens are classes of their own;
others share classes of endings that keep like company.  Counts of all training tokens lie in a table sharded by token.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import _LOW, Words, id_crc, mix, plain, slices, stage, table

#: Classes: this many frequent tokens, and clusters of endings.
SINGLE, CLUSTERS = 12, 28
CLASSES = SINGLE + CLUSTERS
#: Hashed endings of three letters that are clustered, and of two letters that make their company.
ENDINGS, COMPANY = 8192, 128
#: Rows of the features: last word, last two classes, the word before the last (a skip), the classes before those (a skip).
WORD_ROWS, PAIR_ROWS = 8192, (CLASSES + 1) ** 2
SHAPE = (WORD_ROWS, PAIR_ROWS, WORD_ROWS, PAIR_ROWS)
ROWS = sum(SHAPE)
#: Rounds over all training documents, tokens of a step, and the step's rate.
ROUNDS, STEP, RATE = 2, 4096, 0.3
#: Tokens whose counts are sent to every task; the counts of others are joined.
SENT = 1 << 17
#: Parts of a table that tasks send, and tasks whose parts are summed at once.
BLOCKS, FAN = 32, 1024
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class Tokens:
    """Tokens of some texts: words, then an end for each text; hashes, endings, company, and each one's place in its text."""

    def __init__(self, texts: pa.Array):
        w = Words(texts)
        n, docs = len(w.hash), w.n_docs
        at = np.arange(n) + w.doc
        self.doc_first = w.first[:-1] + np.arange(docs)
        self.n = np.diff(w.first) + 1
        self.hash = np.full(n + docs, END, np.uint64)
        self.hash[at] = w.hash
        code = np.zeros(n, np.uint64)
        for k in range(1, 4):
            code = code * np.uint64(263) + np.where(w.ends - w.starts >= k, _LOW[w.data[np.maximum(w.ends - k, 0)]] if n else code, np.uint64(0))
            if k == 2:
                self.company = self._hashed(code, at, n + docs, COMPANY)
        self.ending = self._hashed(code, at, n + docs, ENDINGS)
        self.doc = np.repeat(np.arange(docs), self.n)
        self.place = np.arange(n + docs) - self.doc_first[self.doc] if docs else np.zeros(0, np.int64)

    @staticmethod
    def _hashed(code: np.ndarray, at: np.ndarray, n: int, size: int) -> np.ndarray:
        """Codes of words as numbers under ``size``; the last is that of ends."""
        out = np.full(n, size - 1, np.int64)
        out[at] = (mix(code) % np.uint64(size - 1)).astype(np.int64)
        return out

    def before(self, values: np.ndarray, k: int, none):
        """The value ``k`` tokens back, or ``none`` before the text."""
        out = np.full(len(values), none, values.dtype)
        out[k:] = values[:-k] if k < len(values) else out[k:]
        out[self.place < k] = none
        return out


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    for lo, hi in slices(texts, 1 << 18):
        yield lo, hi, Tokens(texts.slice(lo, hi - lo))


def count_tokens(docs: DataFrame) -> DataFrame:
    """``h, ending, c`` of all tokens of (text) rows."""

    def merged(parts):
        h = np.concatenate([p[0] for p in parts])
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        return h[first], np.concatenate([p[1] for p in parts])[first], np.bincount(back, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit(h, e, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e), pa.array(c)], names=["h", "ending", "c"])

        for b in batches:
            for _, _, t in _blocks(plain(b.column(0))):
                h, first, c = np.unique(t.hash, return_index=True, return_counts=True)
                held.append((h, t.ending[first], c.astype(np.float64)))
                size += len(h)
                if size > 400_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 250_000:  # bounded: summed again after the shuffle
                        yield emit(*held[0])
                        held, size = [], 0
        if held:
            yield emit(*merged(held))

    return stage(docs.select("text").mapInArrow(run, "h bigint, ending bigint, c bigint").groupBy("h", "ending").agg(F.sum("c").alias("c")))


def company(docs: DataFrame) -> np.ndarray:
    """Counts of the company before and after each ending (``ENDINGS`` x 2 ``COMPANY``), over all (text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, ENDINGS * COMPANY), np.int64)
        for b in batches:
            for _, _, t in _blocks(plain(b.column(0))):
                before = t.before(t.company, 1, COMPANY - 1)
                after = np.full(len(before), COMPANY - 1, np.int64)
                after[:-1] = t.company[1:]
                after[np.append(t.doc_first[1:], len(after)).astype(np.int64) - 1] = COMPANY - 1
                for k, other in enumerate((before, after)):
                    np.add.at(seen[k], t.ending * COMPANY + other, 1)
        yield _payload(np.concatenate([x.reshape(ENDINGS, COMPANY) for x in seen], 1))

    return _summed(docs.select("text").mapInArrow(run, PAYLOAD), (ENDINGS, 2 * COMPANY))


def cluster_endings(seen: np.ndarray, clusters: int, seed: int = 5) -> np.ndarray:
    """A cluster of each ending, by the company that it keeps."""
    weight = seen.sum(1) / 2
    if not weight.sum():
        return np.zeros(len(weight), np.int64)
    x = np.sqrt(seen / np.maximum(weight[:, None], 1))
    x -= (x * weight[:, None]).sum(0) / weight.sum()
    scaled = x * np.sqrt(weight)[:, None]
    _, axes = np.linalg.eigh(scaled.T @ scaled)
    x = x @ axes[:, -16:]
    rng = np.random.default_rng(seed)
    p = weight / weight.sum()
    centre = x[rng.choice(len(x), clusters, p=p)]

    def nearest() -> np.ndarray:
        return ((x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)[None]).argmin(1)

    for _ in range(40):
        own = nearest()
        mass = np.bincount(own, weights=weight, minlength=clusters)
        for k in range(clusters):
            centre[k] = (x[own == k] * weight[own == k, None]).sum(0) / mass[k] if mass[k] > 0 else x[rng.choice(len(x), p=p)]
    return nearest()


class Classes:
    def __init__(self, single: np.ndarray, cluster: np.ndarray):
        self.single, self.cluster = single, cluster

    def of(self, t: Tokens) -> np.ndarray:
        out = SINGLE + self.cluster[t.ending]
        for k, h in enumerate(self.single):
            out[t.hash == h] = k
        return out

    def rows(self, t: Tokens, cls: np.ndarray) -> list[np.ndarray]:
        """The active row of each feature."""
        b1, b2, b3, b4 = (t.before(cls, k, CLASSES) for k in (1, 2, 3, 4))
        word = (mix(t.hash) >> np.uint64(51)).astype(np.int64)
        begin = int(BEGIN % np.uint64(WORD_ROWS))
        found = [t.before(word, 1, begin), b1 * (CLASSES + 1) + b2, t.before(word, 2, begin), b3 * (CLASSES + 1) + b4]
        at = 0
        for k, n in enumerate(SHAPE):
            found[k] = found[k] + at
            at += n
        return found


def logits(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += bias
    return np.clip(z, -60.0, 60.0, out=z)  # keeps exp finite without a maximum of each row


def softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = logits(weights, bias, rows)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def log_probs(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
    """Natural logs of the classes' probabilities, a bounded number of tokens at a time."""
    out = np.empty(len(cls))
    for lo in range(0, len(cls), 4 * STEP):
        hi = min(lo + 4 * STEP, len(cls))
        z = logits(weights, bias, [r[lo:hi] for r in rows])
        own = z[np.arange(hi - lo), cls[lo:hi]]
        np.exp(z, out=z)
        out[lo:hi] = own - np.log(z @ np.ones(z.shape[1], z.dtype))
    return out


PAYLOAD = "task int, block int, payload binary"


def _payload(whole: np.ndarray, *more: float) -> pa.RecordBatch:
    """A task's table in ``BLOCKS`` parts of rows (float32), and a last part of further figures."""
    size = -(-len(whole) // BLOCKS)
    parts = [whole[k * size : (k + 1) * size].astype(np.float32).tobytes() for k in range(BLOCKS)] + [np.array(more, np.float32).tobytes()]
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    return pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["task", "block", "payload"])


def _summed(frame: DataFrame, shape: tuple[int, int], more: int = 0):
    """Sums tasks' parts by block, at most ``FAN`` tasks' at once and then their sums, and returns the bounded whole."""

    def add(key, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in part["payload"])
        return pd.DataFrame({"task": [key[0]], "block": [key[1]], "payload": [total.astype(np.float32).tobytes()]})

    frame = frame.groupBy(F.floor(F.col("task") / FAN).cast("int").alias("task"), "block").applyInPandas(add, PAYLOAD)
    frame = frame.groupBy(F.lit(0).alias("task"), "block").applyInPandas(add, PAYLOAD)
    out, rest = np.zeros(shape, np.float64), np.zeros(more)
    size = -(-shape[0] // BLOCKS)
    for r in frame.collect():
        if r.block == BLOCKS:
            rest[:] = np.frombuffer(r.payload, np.float32)
        elif len(r.payload):
            out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.payload, np.float32).reshape(-1, shape[1])
    return (out, rest) if more else out


def descend(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], cls: np.ndarray, rate: float, seen: np.ndarray) -> float:
    """One step, in place, down the gradient of the tokens' negative log likelihood; returns that before the step.

    Each weight's gradient is divided by the root of its summed squares (``squares``), so rare rows move as well as
    frequent ones.  ``seen`` counts the uses of each row.  Features take their steps in turn from one softmax.
    """
    error = softmax(weights, bias, rows)
    at = np.arange(len(cls))
    loss = -float(np.log(error[at, cls]).sum())
    error[at, cls] -= 1
    for r in rows:
        order = np.argsort(r.astype(np.uint16), kind="stable")  # a radix sort
        sorted_ = r[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        own = sorted_[first]
        step = np.add.reduceat(error[order], first, axis=0)
        past = squares[own]
        past += step * step
        squares[own] = past
        np.sqrt(past, out=past)
        step /= past
        step *= np.float32(rate)
        weights[own] -= step
        seen[own] += np.diff(np.append(first, len(r)))
    return loss


def _round(docs: DataFrame, classes: Classes, weights: np.ndarray, bias: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
    """Weights after every task's own steps over its (text) rows, and the mean loss of a token as tasks met it.

    A row's change is the mean of the tasks' changes, weighted by their uses of it, so that tasks that never met a
    feature do not hold it back.
    """
    sent = docs.sparkSession.sparkContext.broadcast((classes, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start, b0 = sent.value
        w, squares, seen, loss, n = start.copy(), np.ones_like(start), np.zeros(len(start), np.int64), 0.0, 0
        for b in batches:
            for _, _, t in _blocks(plain(b.column(0))):
                cls = own.of(t)
                rows = own.rows(t, cls)
                for lo in range(0, len(cls), STEP):
                    loss += descend(w, squares, b0, [r[lo : lo + STEP] for r in rows], cls[lo : lo + STEP], rate, seen)
                n += len(cls)
        yield _payload(np.concatenate([(w - start) * seen[:, None], seen[:, None]], 1), loss, n)

    total, (loss, n) = _summed(docs.select("text").mapInArrow(run, PAYLOAD), (ROWS, CLASSES + 1), 2)
    change = total[:, :-1] / np.maximum(total[:, -1:], 1)
    return (weights + change).astype(np.float32), loss / max(n, 1)


class Model:
    """Classes and weights, the shares of tokens within classes, and the loss of each round as it was met."""

    def __init__(self, classes, weights, bias, class_total, tokens, distinct, losses):
        self.classes, self.weights, self.bias = classes, weights, bias
        self.class_total, self.tokens, self.distinct, self.losses = class_total, tokens, distinct, losses


def train(docs: DataFrame, *, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Model, DataFrame]:
    """The model of all (text) rows, and the staged counts ``h, ending, c`` of all their tokens.

    Without rows every class is alike and every token unknown.  A null text is its end alone; repeated rows each
    train; a very long text takes as many steps as it needs.
    """
    docs = docs.select("text")
    counts = count_tokens(docs)
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = [r.h for r in counts.where(F.col("h") != int(END.view(np.int64))).orderBy(F.desc("c"), "h").limit(SINGLE - 1).collect()]
    single = np.array([int(END.view(np.int64)), *top], np.int64).view(np.uint64)
    classes = Classes(single, cluster_endings(company(docs), CLUSTERS))
    clusters = "cast(split('" + ",".join(str(int(k)) for k in classes.cluster) + "', ',') as array<int>)"
    which = F.expr(f"get({clusters}, cast(ending as int)) + {SINGLE}")
    for k, h in enumerate(single.view(np.int64).tolist()):
        which = F.when(F.col("h") == h, F.lit(k)).otherwise(which)
    by = {r.k: (r.n, r.v) for r in counts.groupBy(which.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n = np.array([by.get(k, (0, 0))[0] for k in range(CLASSES)], np.float64)
    v = np.array([by.get(k, (0, 0))[1] for k in range(CLASSES)], np.float64)
    bias = np.log((n + 1) / (n + 1).sum()).astype(np.float32)
    weights, losses = np.zeros((ROWS, CLASSES), np.float32), []
    for _ in range(rounds):
        weights, loss = _round(docs, classes, weights, bias, rate)
        losses.append(float(loss))
    return Model(classes, weights, bias, n + v + 1, int(totals.n or 0), int(totals.v or 0), losses), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, *, id_col="doc_id", text_col="text", sent: int = SENT) -> DataFrame:
    """Scores of every row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    A null text is empty and has its end alone.  Repeated rows, and rows of a null id, are each scored: rows are told
    apart by a number of their own.  Unknown tokens of a class count as one further token of it, of count 0.  Other
    columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    whole = model.distinct <= sent
    hot = counts.select("h", "c") if whole else counts.select("h", "c").orderBy(F.desc("c"), "h").limit(sent)
    got = hot.toArrow()
    h = got.column(0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    held = spark.sparkContext.broadcast((model, h[order], got.column(1).to_numpy()[order], uuid.uuid4().hex))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("row bigint, n_tokens bigint, n_known bigint, logs double, classed double, rest array<bigint>, tf array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, keys, c, _ = held.value
        # Numbers that a repeated attempt gives again; the result is written before they are used.
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        inside = np.log10(m.class_total)
        for b in batches:
            for lo, hi, t in _blocks(plain(b.column(1))):
                docs_ = hi - lo
                cls = m.classes.of(t)
                z = log_probs(m.weights, m.bias, m.classes.rows(t, cls), cls) / np.log(10) - inside[cls]
                at = np.minimum(np.searchsorted(keys, t.hash), max(len(keys) - 1, 0))
                ok = keys[at] == t.hash if len(keys) else np.zeros(len(cls), bool)
                logs = np.where(ok, np.log10(c[at] + 1.0), 0.0) if len(keys) else np.zeros(len(cls))
                rest, tf = [None] * docs_, [None] * docs_
                if not whole:
                    left = np.flatnonzero(~ok)
                    edge = np.searchsorted(left, np.concatenate([t.doc_first, [len(cls)]]))
                    for d in range(docs_):
                        if edge[d] < edge[d + 1]:
                            rest[d], tf[d] = np.unique(t.hash[left[edge[d] : edge[d + 1]]].view(np.int64), return_counts=True)
                sums = [np.bincount(t.doc, weights=w, minlength=docs_) for w in (ok, logs, z)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, docs_), pa.array(np.arange(row, row + docs_)), pa.array(t.n.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(rest, pa.list_(pa.int64())), pa.array(tf, pa.list_(pa.int64()))],
                    names=schema.fieldNames(),
                )
                row += docs_

    got = rows.mapInArrow(run, schema)
    if not whole:
        got = stage(got)
        pairs = got.where("rest is not null").select("row", F.explode(F.arrays_zip("rest", "tf")).alias("p")).select("row", F.col("p.rest").alias("h"), F.col("p.tf").alias("tf"))
        # Tokens without a count add nothing, so an inner join keeps all that matters.
        late = pairs.join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("late"))
        got = got.drop("rest", "tf").join(late, "row", "left")
        got = got.withColumn("n_known", F.col("n_known") + F.coalesce("more", F.lit(0))).withColumn("logs", F.col("logs") + F.coalesce("late", F.lit(0.0)))
    base = float(np.log10(model.tokens + model.distinct + 1))
    return got.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * base).alias("base_score"), (F.col("logs") + F.col("classed")).alias("score"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id has no remainder: its row is not held out and, its remainder unknown, trains nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.where(id_crc("doc_id") % 7 != 2))
    out = score(docs, model, counts)
    held = F.coalesce(id_crc("doc_id") % 7 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
