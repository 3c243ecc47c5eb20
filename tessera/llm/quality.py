"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, by characters.

The count tables are made and joined by n-gram, in shards.  The most frequent n-grams, up to a fixed number of each
order, are sent to the scoring tasks; what these cannot settle is counted by document and joined with the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import STEP_BYTES, id_crc, mix, plain, slices, stage, table

ORDER = 5
#: Entries of each order's table that are sent to every task.
SENT = 1 << 18
#: Trusted rows (ids) up to which they are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1 << 20
#: Quantiles of trusted perplexities, by language, between which a document is kept.
LOW, HIGH = 0.001, 0.995
#: One trusted document in so many sets the quantiles and is not trained on: a model likes its own training text too well.
CALIBRATE = 5
BEGIN, END = "\x02", "\x03"
_A = np.random.default_rng(7).integers(1, 1 << 63, ORDER + 1, dtype=np.uint64) | np.uint64(1)


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ``order - 1`` begin marks and before an end mark, and each one's first index."""
    pad = BEGIN * (order - 1)
    points = np.frombuffer("".join(pad + t + END for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + order for t in texts], out=first[1:])
    return points, first


def keys(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` symbols that end at each index."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out += (points[at - k].astype(np.uint64) + np.uint64(1)) * _A[k]
    return mix(out)


class Sent:
    """A hash table of n-grams: values by key, with a mark for absent ones."""

    def __init__(self, grams: list[str], values: np.ndarray):
        n = len(grams[0]) if grams else 0
        points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4")
        key = keys(points, np.arange(n - 1, len(points), n) if n else np.zeros(len(grams), np.int64), n)
        order = np.argsort(key)
        self.key, self.value = key[order], values[order]
        self._slots()

    def _slots(self):
        bits = max(4, int(max(1, len(self.key)) - 1).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.zeros(1 << bits, np.uint64)
        self.slot_value = np.zeros(1 << bits, np.float32)
        at = (self.key >> self.shift).astype(np.int64)
        self.slot_key[at], self.slot_value[at] = self.key, self.value
        self.full = np.zeros(1 << bits, bool)
        self.full[at] = True

    def __getstate__(self):
        return self.key, self.value

    def __setstate__(self, state):
        self.key, self.value = state
        self._slots()

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether the keys are there."""
        if not len(self.key):
            return np.zeros(len(key), np.float32), np.zeros(len(key), bool)
        at = (key >> self.shift).astype(np.int64)
        value, ok = self.slot_value[at], self.slot_key[at] == key
        ok &= self.full[at]
        rest = np.flatnonzero(~ok & self.full[at])
        if len(rest):
            k = np.minimum(np.searchsorted(self.key, key[rest]), len(self.key) - 1)
            hit = self.key[k] == key[rest]
            value[rest[hit]] = self.value[k[hit]]
            ok[rest[hit]] = True
        return value, ok


def count_grams(trusted: DataFrame, order: int) -> DataFrame:
    """``gram, c`` of the whole texts (column ``text``)."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        key = np.concatenate([h[0] for h in held])
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        c = np.bincount(back, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
        return key[first], c, np.concatenate([h[2] for h in held])[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def emit(part):
            grams = [g.decode("utf-32-le", "surrogatepass") for g in part[2].view(f"V{4 * order}").reshape(-1).tolist()] if len(part[0]) else []
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(part[1], pa.int64())], names=["gram", "c"])

        for b in batches:
            texts = plain(b.column(0))
            for lo, hi in slices(texts, STEP_BYTES // 2):
                points, first = symbols(texts.slice(lo, hi - lo).to_pylist(), order)
                at = np.delete(np.arange(len(points)), (first[:-1, None] + np.arange(order - 1)).ravel())
                key, where, back = np.unique(keys(points, at, order), return_index=True, return_inverse=True)
                grams = np.lib.stride_tricks.sliding_window_view(points, order)[at[where] - order + 1]
                held.append((key, np.bincount(back).astype(np.float64), np.ascontiguousarray(grams)))
                size += len(key)
                if size > 400_000:
                    held = [flush(held)]
                    size = len(held[0][0])
                    if size > 250_000:  # what a task holds stays bounded; sums are made again after the shuffle
                        yield emit(held[0])
                        held, size = [], 0
        if held:
            yield emit(flush(held))

    return trusted.select("text").mapInArrow(run, "gram string, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


def train(trusted: DataFrame, *, order: int = ORDER) -> DataFrame:
    """The model of (text) rows: ``kind, n, gram, value, weight``.

    Kind ``p``: the natural log of an n-gram's interpolated probability.  Kind ``g``: the log of the weight that a
    context leaves to shorter ones (order ``n`` has contexts of ``n - 1`` symbols).  Kind ``u``: the log probability
    of a symbol under no context at all.  Lower orders count distinct left neighbours.
    """
    tables = {order: stage(count_grams(trusted, order))}
    for n in range(order - 1, 0, -1):
        tables[n] = stage(tables[n + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")))
    spark = trusted.sparkSession
    vocabulary = tables[1].count() + 1
    out = [spark.createDataFrame([("u", 0, "", float(-np.log(vocabulary)), 1)], "kind string, n int, gram string, value double, weight bigint")]
    lower = None
    for n in range(1, order + 1):
        t = tables[n]
        r = t.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5))).first()
        y = r.n1 / (r.n1 + 2 * r.n2) if r.n1 and r.n2 else 0.5
        d = [min(k - 0.01, max(0.01, k - (k + 1) * y * r[f"n{k + 1}"] / r[f"n{k}"])) if r[f"n{k}"] and r[f"n{k + 1}"] else k * 0.5 for k in (1, 2, 3)]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("ctx", F.expr(f"substring(gram, 1, {n - 1})"))
        total = t.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(off).alias("off"))
        t = t.join(total, "ctx").withColumn("own", (F.col("c") - off) / F.col("total")).withColumn("left", F.col("off") / F.col("total"))
        if lower is None:
            t = t.withColumn("p", F.col("own") + F.col("left") / float(vocabulary))
        else:
            t = t.withColumn("short", F.expr("substring(gram, 2)")).join(lower, "short").withColumn("p", F.col("own") + F.col("left") * F.col("pl"))
        t = stage(t.select("gram", "c", "p"))
        lower = t.select(F.col("gram").alias("short"), F.col("p").alias("pl"))
        out.append(t.select(F.lit("p"), F.lit(n), "gram", F.log("p"), "c"))
        out.append(total.select(F.lit("g"), F.lit(n), "ctx", F.log(F.col("off") / F.col("total")), "total"))
    return stage(reduce(DataFrame.unionAll, out))


def _send(model: DataFrame, order: int, sent: int) -> dict:
    """The most frequent entries of each table, whether that is all of them, and the symbol's floor."""
    sizes = {(r.kind, r.n): r.s for r in model.groupBy("kind", "n").agg(F.count("*").alias("s")).collect()}
    out: dict = {"u": model.where("kind = 'u'").first()["value"]}
    for kind in "pg":
        for n in range(1, order + 1):
            rows = model.where((F.col("kind") == kind) & (F.col("n") == n)).select("gram", "value", "weight")
            if sizes.get((kind, n), 0) > sent:
                rows = rows.orderBy(F.desc("weight"), "gram").limit(sent)
            got = rows.select("gram", F.col("value").cast("float").alias("value")).toArrow()
            out[kind, n] = Sent(got.column(0).to_pylist(), got.column(1).to_numpy()), sizes.get((kind, n), 0) <= sent
    return out


def log_probs(points: np.ndarray, at: np.ndarray, tables: dict, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities at the indices, and which of them the sent tables settle."""
    value = np.zeros(len(at), np.float64)
    known = np.ones(len(at), bool)
    open_ = np.arange(len(at))
    for n in range(order, 0, -1):
        held, whole = tables["p", n]
        v, ok = held.get(keys(points, at[open_], n))
        value[open_[ok]] += v[ok]
        open_ = open_[~ok]
        if not whole:
            known[open_] = False
            return value, known
        held, whole = tables["g", n]
        v, ok = held.get(keys(points, at[open_] - 1, n - 1))
        value[open_[ok]] += v[ok]
        if not whole:
            known[open_[~ok]] = False
            open_ = open_[ok]
    value[open_] += tables["u"]
    return value, known


def score(docs: DataFrame, model: DataFrame, *, text_col="text", keep: Sequence[str] = ("doc_id",), order: int = ORDER, sent: int = SENT) -> DataFrame:
    """The columns to ``keep``, ``log_prob`` (natural) and ``n_symbols`` of whole texts, the end included.

    What the sent tables leave open is joined back by a number that each row gets when it is first scored and that is
    staged with it, so rows of one id, or of none, stay apart.
    """
    spark = docs.sparkSession
    tables, key = spark.sparkContext.broadcast(_send(model, order, sent)), uuid.uuid4().hex
    whole = all(t[1] for k, t in tables.value.items() if k != "u")
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kept = rows.schema.fields[:-1]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *T.StructType.fromDDL("__row bigint, log_prob double, n_symbols bigint, __gram string, __tf bigint").fields])
    nothing = [pa.field(f.name, t) for f, t in zip(kept, to_arrow_schema(T.StructType(kept)).types, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tables.value
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for b in batches:
            texts = plain(b.column(len(kept)))
            for lo, hi in slices(texts, STEP_BYTES // 2):
                points, first = symbols(texts.slice(lo, hi - lo).to_pylist(), order)
                at = np.delete(np.arange(len(points)), (first[:-1, None] + np.arange(order - 1)).ravel())
                value, known = log_probs(points, at, held, order)
                n = np.diff(first) - (order - 1)
                doc = np.repeat(np.arange(hi - lo), n)
                total = np.bincount(doc, weights=np.where(known, value, 0.0), minlength=hi - lo)
                m = hi - lo
                own = [b.column(k).slice(lo, m) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(row, row + m)), pa.array(total), pa.array(n, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names=schema.fieldNames())
                rest = np.flatnonzero(~known)
                if len(rest):
                    grams = np.lib.stride_tricks.sliding_window_view(points, order)[at[rest] - order + 1]
                    pair = np.concatenate([doc[rest, None].astype("<u4"), grams], 1)
                    seen, tf = np.unique(np.ascontiguousarray(pair).view(f"V{4 * order + 4}").reshape(-1), return_counts=True)
                    flat = np.frombuffer(seen.tobytes(), "<u4").reshape(-1, order + 1)
                    text = [g.tobytes().decode("utf-32-le", "surrogatepass") for g in flat[:, 1:]]
                    m = len(flat)
                    none = [pa.nulls(m, f.type) for f in nothing]
                    yield pa.RecordBatch.from_arrays([*none, pa.array(row + flat[:, 0].astype(np.int64)), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()), pa.array(text, pa.string()), pa.array(tf, pa.int64())], names=schema.fieldNames())
                row += hi - lo

    got = rows.mapInArrow(run, schema)
    out = [*keep, "log_prob", "n_symbols"]
    if whole:
        return got.select(*out)
    got = stage(got)
    # Each n-gram that the sent tables left open is settled once, against the sharded tables.
    p = model.where("kind = 'p'").select(F.col("n").alias("pn"), F.col("gram").alias("pg"), F.col("value").alias("pv"))
    g = model.where("kind = 'g'").select(F.col("n").alias("gn"), F.col("gram").alias("gg"), F.col("value").alias("gv"))
    late = got.where("__gram is not null").select("__row", F.col("__gram").alias("gram"), F.col("__tf").alias("tf"))
    asked = late.select("gram").distinct().select("gram", F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n"))
    asked = asked.withColumn("tail", F.expr("right(gram, n)")).withColumn("ctx", F.expr(f"substring(gram, {order + 1} - n, n - 1)"))
    asked = asked.join(p, (F.col("n") == F.col("pn")) & (F.col("tail") == F.col("pg")), "left").join(g, (F.col("n") == F.col("gn")) & (F.col("ctx") == F.col("gg")), "left")
    found = asked.groupBy("gram").agg(F.max(F.when(F.col("pv").isNotNull(), F.struct("n", "pv"))).alias("top"), F.collect_list(F.when(F.col("gv").isNotNull(), F.struct("n", "gv"))).alias("gs"))
    floor = float(tables.value["u"])
    settled = found.select("gram", (F.coalesce("top.pv", F.lit(floor)) + F.expr("aggregate(gs, 0D, (s, x) -> if(x.n > coalesce(top.n, 0), s + x.gv, s))")).alias("lp"))
    late = late.join(settled, "gram").groupBy("__row").agg(F.sum(F.col("lp") * F.col("tf")).alias("__late"))
    got = got.where("__gram is null").join(late, "__row", "left")
    return got.withColumn("log_prob", F.col("log_prob") + F.coalesce("__late", F.lit(0.0))).select(*out)


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", quality_col="quality", order=ORDER, sent=SENT, low=LOW, high=HIGH,
    calibrate=CALIBRATE, broadcast_ids=BROADCAST_IDS,
) -> DataFrame:
    """Perplexity of each whole document and whether it lies between its language's quantiles of trusted documents.

    Returns a row per input row: id, lang, ``log_prob``, ``n_symbols``, ``perplexity`` (by symbol), ``low``, ``high`` and ``keep``.
    Trusted documents are those that some row of ``labels`` gives quality 1; one in ``calibrate`` of them, by crc32 of the
    id, sets the quantiles and the others train the model.  A document at a threshold is kept.  A null text is empty:
    its end alone is scored.  A null language counts as ``und``; a language without trusted documents takes the
    quantiles of all of them; without any trusted text every document is kept and thresholds are null.  Rows that
    share an id, or have none, are each scored by themselves, whatever their number; a null id is never trusted.
    Columns of other names are not read.
    """
    spark = docs.sparkSession
    good = labels.where(F.col(quality_col) == 1).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct()
    small = good.count() <= broadcast_ids
    semi = lambda rows: rows.join(F.broadcast(good) if small else good, F.col("__own") == F.col("__id"), "left_semi")
    rows = docs.select(F.col(id_col).alias("__own"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = train(semi(rows.where(id_crc("__own") % calibrate != 0)).select("text"), order=order)
    got = stage(score(rows, model, keep=["__own", "lang"], order=order, sent=sent))
    got = got.withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_symbols")))
    known = semi(got.where(id_crc("__own") % calibrate == 0))
    cut = known.groupBy("lang").agg(F.percentile_approx("perplexity", [low, high], 10000).alias("q"))
    # A row per language, and one for all.
    cuts = {r.lang: r.q for r in cut.collect()}
    every = known.agg(F.percentile_approx("perplexity", [low, high], 10000)).first()[0] or [None, None]
    table_ = spark.createDataFrame([(k, float(v[0]), float(v[1])) for k, v in cuts.items()], "lang string, low double, high double")
    lit = lambda v: F.lit(v).cast("double")
    out = got.join(F.broadcast(table_), "lang", "left").withColumn("low", F.coalesce("low", lit(every[0]))).withColumn("high", F.coalesce("high", lit(every[1])))
    keep = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select(F.col("__own").alias(id_col), "lang", "log_prob", "n_symbols", "perplexity", "low", "high", keep.alias("keep"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
