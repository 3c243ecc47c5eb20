"""Secret scans: known patterns, and character Markov models of random strings against ordinary identifiers.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, without

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is matched whole or not at all, so the least length may stand in the pattern (it may not for ``assign``,
#: whose failing matches still hide what they cover).
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST = 20
RUN = "[A-Za-z0-9+/_-]{%d,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 1
#: A run is taken for random if its log-likelihood ratio reaches both, in nats: in all, and for each character.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.45
NEW = ("spans",)
_EMPTY = "cast(array() as array<struct<start: int, kind: int, end: int>>)"

_PARTS = (
    "user account name index value table count total first last next size time date file path line page list item node data base "
    "client server request response session config option param result error status message event handler service manager factory "
    "builder parser reader writer buffer stream cache queue worker thread process query column record schema field type class object "
    "string number integer float double array vector matrix image video audio text html json config test build version release update "
    "delete insert select create remove start stop open close read write send receive load store save export import default local global "
    "public private static final return while this that from with into over under between the and for not all any only more most high low "
    "information transport international development management communication application government representation"
).split()


def default_samples(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """Labelled samples (``text``, ``random``): ``rows`` random strings of several alphabets and ``rows`` joined identifiers."""
    ids = spark.range(rows)
    blob = F.concat(F.unhex(F.sha2(F.concat(F.lit("r"), "id"), 256)), F.unhex(F.sha2(F.concat(F.lit("s"), "id"), 256)))
    b64 = F.base64(blob)
    text = F.element_at(F.array(b64, F.translate(b64, "+/=", ""), F.lower(F.hex(blob)), F.translate(b64, "+/=", "-_"), F.upper(F.translate(b64, "+/=", ""))), (F.col("id") % 5 + 1).cast("int"))
    random = ids.select(F.substring(text, 1, 48).alias("text"), F.lit(True).alias("random"))
    words = F.split(F.lit(" ".join(_PARTS)), " ")
    picks = [F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_PARTS))) + 1).cast("int")) for k in range(4)]
    glue = F.element_at(F.split(F.lit("_ - /  _"), " "), (F.col("id") % 5 + 1).cast("int"))
    styles = [F.array_join(F.array(*picks), ""), F.concat(*[F.initcap(p) for p in picks]), F.upper(F.array_join(F.array(*picks), "_"))]
    joined = F.when(F.col("id") % 4 < 2, F.concat_ws("", picks[0], glue, picks[1], glue, picks[2], glue, picks[3])).when(F.col("id") % 4 == 2, styles[1]).otherwise(F.when(F.col("id") % 3 == 0, styles[2]).otherwise(styles[0]))
    dated = F.when(F.col("id") % 10 == 0, F.concat_ws("-", joined, F.expr("date_format(date_add(date'2001-01-01', cast(id as int)), 'yyyy-MM-dd')"))).otherwise(joined)
    return random.unionAll(ids.select(dated, F.lit(False)))


def _indices(text: str) -> str:
    return f"transform(split({text}, ''), c -> instr('{ALPHABET}', c))"


def train(samples: DataFrame, *, text_col="text", label_col="random", add: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of a character after another, ``STATES`` x ``STATES``, row by row.

    Rows with a null text or label, or an empty text, teach nothing.  Counts of pairs are made where the samples lie; at most 2 x ``STATES``
    squared rows reach the driver.  A label without samples gives a uniform model.
    """
    rows = samples.select(F.col(text_col).alias("t"), F.col(label_col).alias("r")).where("t is not null and t <> '' and r is not null")
    pairs = rows.select("r", F.expr(f"explode(transform(array({_indices('t')}), i -> zip_with(slice(concat(array(0), i), 1, size(i)), i, (a, b) -> named_struct('a', a, 'b', b)))[0])").alias("p"))
    counts = {(r.r, r.a, r.b): r.n for r in pairs.groupBy("r", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}
    totals: dict = {}
    for (r, a, _), n in counts.items():
        totals[r, a] = totals.get((r, a), 0) + n
    p = lambda r, a, b: (counts.get((r, a, b), 0) + add) / (totals.get((r, a), 0) + add * STATES)
    return [math.log(p(True, a, b) / p(False, a, b)) for a in range(STATES) for b in range(STATES)]


def _ratio(text: str, model: str) -> str:
    """Log-likelihood ratio of a string expression."""
    return (
        f"aggregate(transform(array({_indices(text)}), i -> zip_with(slice(concat(array(0), i), 1, size(i)), i, (a, b) -> get({model}, a * {STATES} + b)))[0], "
        "cast(0 as double), (s, x) -> s + x)"
    )


def _let(value: str, name: str, body: str) -> str:
    """Evaluates ``value`` once and binds it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: A fold that lengthens an array copies it at each step, so folds go over chunks of about the root of an array's size.
_CHUNK = "cast(greatest(1, ceil(sqrt(size({0})))) as int)"


def _chunks(array: str, size: str) -> str:
    return f"transform(sequence(0, (size({array}) - 1) div {size}), k -> slice({array}, k * {size} + 1, {size}))"


def _before(values: str, step: str) -> str:
    """For each value, what folding ``step`` (of ``s`` and ``x``) from 0 over those before it gives."""
    return f"aggregate({values}, named_struct('at', 0, 'out', cast(array() as array<int>)), (f, x) -> transform(array(f.at), s -> named_struct('at', {step}, 'out', concat(f.out, array(s))))[0], f -> f.out)"


def _spans(kind: int, pattern: str, keep: str, group: int = 0) -> str:
    """Spans of the leftmost non-overlapping matches for which ``keep`` (of ``x.`2```, the group) holds.

    Java's split and find see the same matches, so the pieces between them give their places.  Work grows with the
    matches' number to the power of 1.5 at most.
    """
    r = "r" + repr(pattern) if "'" not in pattern else 'r"' + pattern.replace('"', "\\x22") + '"'
    at = "s.at + length(x.`0`)"
    fold = (
        f"aggregate(q, named_struct('at', a, 'out', {_EMPTY}), "
        f"(s, x) -> if(x.`1` is null, s, named_struct('at', {at} + length(x.`1`), 'out', "
        f"if({keep}, concat(s.out, array(named_struct('start', {at}, 'kind', {kind}, 'end', {at} + length(x.`1`)))), s.out))), s -> s.out)"
    )
    lengths = "transform(c, q -> aggregate(q, 0, (s, x) -> s + length(x.`0`) + coalesce(length(x.`1`), 0)))"
    body = f"flatten(zip_with(c, {_before(lengths, 's + x')}, (q, a) -> {fold}))"
    zipped = f"arrays_zip(split(__t, {r}, -1), regexp_extract_all(__t, {r}, 0), regexp_extract_all(__t, {r}, {group}))"
    return _let(zipped, "z", _let(_CHUNK.format("z"), "b", _let(_chunks("z", "b"), "c", body)))


def scan(docs: DataFrame, model: list[float] | None = None, *, text_col: str = "text", least: int = LEAST, least_ratio: float = LEAST_RATIO, least_mean: float = LEAST_MEAN) -> DataFrame:
    """Adds ``spans``: array of (start, kind, end), code points, ends exclusive, by start and then kind, kinds as indices of ``KINDS``.

    Known patterns come first; the method adds runs of ``least`` or more characters that the models take for random
    and that overlap none of those.  Without a model only the patterns are used.  A null or empty text has no spans;
    repeated rows are each scanned; an input column ``spans`` is replaced.  Rows stay where they are.  A long text of n
    matches takes work of n to the power of 1.5 at most.
    """
    docs = without(docs, NEW)
    run = "[A-Za-z0-9+/_-]{%d}" % least
    out = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    # One cheap look decides which of the dearer steps a text needs.
    out = out.withColumn("__run", F.expr(f"__t rlike '{run}'")).withColumn("__low", F.expr("lower(__t)"))
    words = " or ".join(f"contains(__low, '{w}')" for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
    hex_ = _spans(2, HEX, "true")
    base = f"concat(if({words}, {_spans(0, ASSIGN, 'length(x.`2`) >= 6', 2)}, {_EMPTY}), if(contains(__t, 'AKIA'), {_spans(1, ACCESS, 'true')}, {_EMPTY}), if(__run{' and __t rlike ' + repr('[0-9a-f]{24}')}, {hex_}, {_EMPTY}))"
    if least > 24:
        base = base.replace("if(__run and ", "if(")
    out = out.withColumn("__base", F.expr(f"array_sort({base})"))
    if model is None:
        return out.withColumn("spans", F.col("__base")).drop("__t", "__run", "__low", "__base")
    # A foldable literal: parsed once.
    table_ = "cast(split('" + ",".join(f"{x:.5f}" for x in model) + "', ',') as array<double>)"
    keep = f"transform(array({_ratio('x.`1`', table_)}), v -> v >= {float(least_ratio)}D and v >= {float(least_mean)}D * length(x.`1`))[0]"
    # Base spans in chunks, each with its least start and greatest end, so that a run looks into few of them.
    ranges = "transform(bc, q -> named_struct('lo', q[0].start, 'hi', array_max(transform(q, x -> x.end)), 'all', q))"
    meets = "exists(br, r -> r.lo < m.end and m.start < r.hi and exists(r.all, x -> m.start < x.end and x.start < m.end))"
    free = _let(_CHUNK.format("__base"), "bs", _let(_chunks("__base", "bs"), "bc", _let(ranges, "br", f"filter(ms, m -> not {meets})")))
    added = f"if(__run, {_let(_spans(3, RUN % least, keep), 'ms', f'if(size(ms) = 0 or size(__base) = 0, ms, {free})')}, {_EMPTY})"
    return out.withColumn("spans", F.expr(f"array_sort(concat(__base, {added}))")).drop("__t", "__run", "__low", "__base")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The text of scanned documents with each span replaced by ``mark``; overlapping spans are taken as one.

    A text is cut at chunks of its spans first, so that looking for a code point never goes through all of it.
    """
    quoted = "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"
    fold = (
        "aggregate(q, named_struct('at', e.lo, 'out', cast(array() as array<string>)), (s, x) -> if(x.start < s.at, named_struct('at', greatest(s.at, x.end), 'out', s.out), "
        f"named_struct('at', x.end, 'out', concat(s.out, array(substring(p, s.at - e.lo + 1, x.start - s.at), {quoted})))), s -> s.out)"
    )
    part = _let(f"substring(`{text_col}`, e.lo + 1, greatest(e.hi - e.lo, 0))", "p", fold)
    parts = f"flatten(zip_with(c, zip_with({_before('tops', 'greatest(s, x)')}, tops, (lo, hi) -> named_struct('lo', lo, 'hi', hi)), (q, e) -> {part}))"
    whole = f"concat(array_join({parts}, ''), substring(`{text_col}`, array_max(tops) + 1, length(`{text_col}`)))"
    tops = _let("transform(c, q -> array_max(transform(q, x -> x.end)))", "tops", whole)
    folded = F.expr(_let(_CHUNK.format("spans"), "b", _let(_chunks("spans", "b"), "c", tops)))
    return docs.withColumn(text_col, F.when(F.size("spans") > 0, folded).otherwise(F.col(text_col)))


def span_text(spans: str) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(get({kinds}, s.kind), ':', s.start, ':', s.end)), ',')")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), train(default_samples(spark)))
    found = found.select("doc_id", "spans").withColumn("base", F.expr("filter(spans, s -> s.kind < 3)"))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"),
    )
